"""Session helpers shared by operators: lineage cuts and table access."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import zipfile
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hints to broadcast are given to sides whose measured size is at most this.
BROADCAST_BYTES = 64 << 20
#: Files sent to workers (vocabularies) are refused beyond this.
SHIP_BYTES = 256 << 20


def build_session(app: str = "heddle", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local master, whose executor is this process, may do without that setting: it gets
    a temporary folder that goes with the process. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_heddle_folder", None):
        sc._heddle_folder = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, sc._heddle_folder, ignore_errors=True)
    return sc._heddle_folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Its files are removed once no DataFrame refers to them any longer (Spark's own tracking,
    which is switched on here).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Rows with their number from one in a total order, without one task for all rows.

    Rows are range-partitioned and sorted; a row's id is then its partition and its place in
    it, which is shifted by the counts of the partitions before. One exchange, and the rows
    are written once. The order must have no ties.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id()))
    part, place = F.shiftright("at__", 33), F.col("at__").bitwiseAND((1 << 33) - 1)
    # One number per partition goes to the driver and comes back as a constant.
    counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    shift = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    return placed.withColumn(name, place + 1 + F.get(shift, part.cast("int"))).drop("at__")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a CPU-bound stage: an input in fewer splits than cores is dealt out to all.

    Such an input is small (at most a split per core), so the shuffle is too; inputs with
    enough splits, and those that only a shuffle makes, are left as they are.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # asking it for partitions would run it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context.

    Executors need not have it on their path: it is zipped into the shared folder and added
    as a Python file. Call it before a Python function is put into a plan.
    """
    sc = spark.sparkContext
    if getattr(sc, "_heddle_shipped", False):
        return
    root, buf = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(root.parent))), f.read_bytes())
    data = buf.getvalue()
    sc.addPyFile(_share(spark, f"heddle-{hashlib.sha256(data).hexdigest()[:12]}.zip", data))
    sc._heddle_shipped = True


def _share(spark: SparkSession, name: str, data: bytes) -> str:
    """Path of ``data`` under the shared folder; the name is its content's, so it is written once."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/{name}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).getLen() != len(data):
        out = fs.create(at, True)
        out.write(bytearray(data))
        out.close()
    return path


def ship_file(spark: SparkSession, path: str) -> str:
    """Give the workers a file of the driver's; they open it by the name returned (SparkFiles).

    It goes through the shared folder, once per context, so executors need no copy of their
    own. Files beyond ``SHIP_BYTES`` are refused.
    """
    sc = spark.sparkContext
    done = sc.__dict__.setdefault("_heddle_files", {})
    if path not in done:
        source = Path(path)
        if source.stat().st_size > SHIP_BYTES:
            raise ValueError(f"{path} is larger than {SHIP_BYTES} bytes")
        data = source.read_bytes()
        name = f"{hashlib.sha256(data).hexdigest()[:12]}-{source.name}"
        sc.addFile(_share(spark, name, data))
        done[path] = name
    return done[path]


def python_input(df: DataFrame) -> DataFrame:
    """``df`` as the input of a Python stage: package shipped, few splits dealt out."""
    ship(df.sparkSession)
    return spread(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
