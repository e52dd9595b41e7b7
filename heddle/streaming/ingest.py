"""Extension: landed registry pages and change observations as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.state import upsert
from heddle.sources.configs import registry_targets
from heddle.sources.snapshots import SnapshotStore

#: A row per entry of a page; a page without entries has one row with a null raw_json.
PAGE_SCHEMA = "run_id string, page_no int, next_cursor string, fetched_at timestamp, position int, raw_json string"
KEYS = ["name", "version", "registry_type", "identifier"]
ATTRIBUTES = ["transport", "url", "sha256", "status"]


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Registry entries from Parquet files as they land."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_poll(store: SnapshotStore, entries: DataFrame) -> int:
    """Upsert one complete poll into the store: what is missing from it becomes delisted.

    The run's instant is the poll's own latest fetch, so a repeated poll gives the same state.
    A poll older than the state changes nothing. Returns the number of the snapshot.
    """
    run_at = entries.agg(F.max("fetched_at")).first()[0]
    if run_at is None:
        return store.version()
    rows = entries.where("raw_json IS NOT NULL").select(F.xxhash64("run_id", "page_no", "position").alias("entry_id"), "raw_json")
    poll = registry_targets(rows).select(*KEYS, *ATTRIBUTES)
    old = store.current()
    if old is None:
        old = poll.limit(0).select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at", "delisted_at")])
    elif (old.agg(F.max(F.greatest("last_seen_at", "delisted_at"))).first()[0] or run_at) > run_at:
        return store.version()
    return store.commit(upsert(old, poll, KEYS, ATTRIBUTES, F.lit(run_at)).drop("change"))


def complete_runs(staged: DataFrame) -> DataFrame:
    """(run, fetched_at) of the runs whose pages are all there, up to the one without a cursor."""
    last = F.max(F.when(F.coalesce("next_cursor", F.lit("")) == "", F.col("page_no")))
    runs = staged.groupBy("run").agg(last.alias("last"), F.count_distinct("page_no").alias("pages"), F.max("fetched_at").alias("fetched_at"))
    return runs.where("last = pages").select("run", "fetched_at")


def run_polls(stream: DataFrame, store: SnapshotStore, checkpoint: str):
    """Start a query that applies every poll once its last page has landed.

    Batches are staged under the store by run; a run is applied when the pages 1 to its last
    one are all staged, however many batches they came in, and its pages are then removed. A
    batch that is repeated after a failure is staged in its own place again.
    """
    staging = f"{store.path}/staging"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = batch.where("run_id IS NOT NULL").withColumn("run", F.xxhash64("run_id"))
        pages.write.mode("overwrite").partitionBy("run").parquet(f"{staging}/batch={number}")
        parts = [f.getPath().toString() for f in store._fs.globStatus(store._at("staging/batch=*/run=*"))]
        if not parts:
            return
        staged = spark.read.schema(f"{PAGE_SCHEMA}, batch long, run long").option("basePath", staging).parquet(*parts)
        for run in complete_runs(staged).orderBy("fetched_at", "run").collect():  # runs under way: a handful
            apply_poll(store, staged.where(F.col("run") == run["run"]))
            for f in store._fs.globStatus(store._at(f"staging/batch=*/run={run['run']}")):
                store._fs.delete(f.getPath(), True)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).start()


def change_counts(observations: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Observations per source and day, of a stream: repeats within the watermark count once."""
    return (
        observations.withWatermark("observed_at", late)
        .dropDuplicatesWithinWatermark(["id"])
        .groupBy(F.window("observed_at", window), "source")
        .agg(F.count("*").alias("observations"))
        .select(F.col("window.start").alias("day"), "source", "observations")
    )
