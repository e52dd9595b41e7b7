"""The registry's runs over a snapshot store: poll, scan, export.

A run reads the store's tables, works out what changes and commits all of it at once, or
nothing: a dry run computes and counts the same and commits nothing. Servers are known by
name, versions by name, version, registry type and identifier.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import launch
from heddle.operators import pipeline, publish, rules, state, typosquat
from heddle.session import materialise
from heddle.sources.configs import registry_servers, registry_targets
from heddle.sources.snapshots import SnapshotStore

VERSION_KEYS = ["name", "version", "registry_type", "identifier"]
VERSION_ATTRIBUTES = [
    "is_latest", "transport", "sha256", "status", "published_at", "runtime_arguments", "package_arguments", "environment_variables",
    "raw_json",
]
SERVER_ATTRIBUTES = ["title", "description", "website_url", "repository_url", "raw_json"]
SEEN = "first_seen_at timestamp, last_seen_at timestamp, delisted_at timestamp"
METADATA = "ecosystem string, package string, unpublished boolean, repository string, project_urls map<string,string>, home_page string, scripts map<string,string>, created_at string"


def _or_empty(table: DataFrame | None, like: DataFrame | None = None, schema: str = "", spark=None) -> DataFrame:
    if table is not None:
        return table
    return spark.createDataFrame([], schema) if like is None else like.limit(0)


def _fresh(poll: DataFrame) -> DataFrame:
    """An empty state with a poll's columns."""
    return poll.limit(0).select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at", "delisted_at")])


def poll(store: SnapshotStore, entries: DataFrame, run_at: datetime, dry_run: bool = False) -> dict[str, int]:
    """Take one complete poll (entry_id, raw_json) into servers, versions and hashes.

    What the poll lacks is delisted, what comes back is listed again; a digest is appended
    where it differs from the version's last one. Returns the run's counters.
    """
    at = F.lit(run_at).cast("timestamp")
    targets = registry_targets(entries).where("name IS NOT NULL").withColumn("version", F.coalesce("version", F.lit("")))
    versions, servers = targets.select(*VERSION_KEYS, *VERSION_ATTRIBUTES), registry_servers(entries).where("name IS NOT NULL")
    old_versions, old_servers = store.table("versions"), store.table("servers")
    old_versions = _fresh(versions) if old_versions is None else old_versions
    old_servers = _fresh(servers) if old_servers is None else old_servers
    next_versions = materialise(state.upsert(old_versions, versions, VERSION_KEYS, VERSION_ATTRIBUTES, at))
    next_servers = materialise(state.upsert(old_servers, servers, ["name"], SERVER_ATTRIBUTES, at))
    ident = F.to_json(F.array(*VERSION_KEYS)).alias("version_id")
    seen = next_versions.where("last_seen_at = first_seen_at OR change <> 'absent'").where((F.col("last_seen_at") == at) & (F.coalesce("sha256", F.lit("")) != "")).select(ident, "sha256")
    hashes = store.table("hashes")
    if hashes is not None:
        last = hashes.groupBy("version_id").agg(F.max_by("sha256", "observed_at").alias("before"))
        seen = seen.join(last, "version_id", "left").where(~F.col("before").eqNullSafe(F.col("sha256"))).drop("before")
    added = materialise(seen.withColumn("source", F.lit("registry")).withColumn("observed_at", at))
    counts = {f"servers_{k}": n for k, n in state.poll_summary(next_servers).first().asDict().items()}
    counts |= {f"versions_{k}": n for k, n in state.poll_summary(next_versions).first().asDict().items()}
    counts["hashes_added"] = added.count()
    if not dry_run:
        store.commit(replace={"servers": next_servers.drop("change"), "versions": next_versions.drop("change")}, append={"hashes": added})
    return counts


def _tables(store: SnapshotStore) -> tuple[DataFrame, DataFrame]:
    versions, servers = store.table("versions"), store.table("servers")
    if versions is None or servers is None:
        raise ValueError(f"{store.path} has no poll yet")
    ident = F.to_json(F.array(*VERSION_KEYS)).alias("id")
    return versions.select(ident, F.col("name").alias("server_id"),
        *[c for c in versions.columns if c != "name"]), servers.select(F.col("name").alias("id"), "*")


def scan(store: SnapshotStore, run_at: datetime, rule_set: tuple[rules.Rule, ...] = rules.RULES, metadata: DataFrame | None = None,
    dry_run: bool = False) -> dict[str, int]:
    """Scan the stale versions and score every server; scans, findings and scores are appended."""
    spark, at = store.spark, F.lit(run_at).cast("timestamp")
    versions, servers = _tables(store)
    scans = _or_empty(store.table("scans"), schema=pipeline.SCAN.format(kind="string"), spark=spark)
    hashes = _or_empty(store.table("hashes"), schema="version_id string, sha256 string, source string, observed_at timestamp", spark=spark)
    metadata = _or_empty(metadata, schema=METADATA, spark=spark)
    fingerprint = rules.rules_fingerprint(rule_set)
    plan = materialise(pipeline.scan_plan(versions, scans, hashes, fingerprint))
    done, found = (materialise(df) for df in pipeline.scan(versions, servers, scans, hashes, metadata, at, rule_set))
    old = store.table("findings")
    findings = found if old is None else old.unionByName(found)
    scores = materialise(pipeline.server_scores(versions, scans.unionByName(done), findings, at, fingerprint))
    counts = pipeline.scan_summary(plan, done, found).first().asDict() | {"servers_scored": scores.count()}
    if not dry_run:
        store.commit(append={"scans": done, "findings": found, "scores": scores})
    return counts


def export(store: SnapshotStore, out: str, known: list[str] | None = None) -> dict[str, int]:
    """Write the artifacts of the store's latest scores under ``out``, as JSON lines.

    ``index`` in order of names, ``servers`` by shard of the name, ``typosquat-clusters`` by
    known name, ``newly-flagged`` latest first, ``totals``. Nothing is scanned again.
    """
    versions, servers = _tables(store)
    scores = store.table("scores")
    if scores is None:
        raise ValueError(f"{store.path} has no scores yet")
    last = state.latest(scores, "server_id", "computed_at", "rules_fingerprint", ["score", "finding_count", "computed_at"])
    index = materialise(publish.index(servers, last))
    found = pipeline.server_findings(versions, store.table("scans"), store.table("findings"))
    pages = publish.server_documents(index, pipeline.scoring.dedupe_findings(found, "server_id"))
    write = lambda df, name: df.write.mode("overwrite").json(f"{out}/{name}")
    write(_timed(index.drop("server_id")).withColumnRenamed("computed_at", "last_scanned_at").orderBy("name"), "index")
    publish.write_sharded(pages, "name", f"{out}/servers")
    configs = pipeline.registry_configs(pipeline.in_scope(versions), servers)
    named = configs.select(F.col("name").alias("server_name"),
        launch.package_name(F.col("command")).alias("identifier")).where("identifier IS NOT NULL")
    clusters = materialise(publish.clusters(named, index, known or typosquat.KNOWN_SERVERS))
    write(clusters.orderBy("known_name", "position"), "typosquat-clusters")
    pairs = state.score_pairs(scores.withColumn("id", F.col("rules_fingerprint")))
    flagged = materialise(publish.flagged_entries(state.newly_flagged(pairs), index))
    write(_timed(flagged).orderBy("ordinal").drop("ordinal"), "newly-flagged")
    write(publish.totals(index), "totals")
    return {"servers": index.count(), "clusters": publish.with_neighbours(clusters).count(), "newly_flagged": flagged.count()}


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("computed_at", publish.iso(F.col("computed_at")))


def load(spark, out: str, name: str) -> DataFrame | None:
    """An exported artifact; None where it was never written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.json(f"{out}/{name}") if fs.exists(at) else None


def by_instant(text: str | None) -> datetime:
    """A run's instant: now, or as told."""
    from datetime import UTC

    return datetime.now(UTC) if text is None else datetime.fromisoformat(text)


def server_detail(index: DataFrame, findings: DataFrame, where: Column) -> DataFrame:
    """The pages of the servers that ``where`` picks from the index (by slug or name)."""
    few = index.where(where)
    return publish.server_documents(few, findings.join(few.select("server_id"), "server_id", "left_semi"))
