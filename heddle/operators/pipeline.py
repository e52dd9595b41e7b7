"""Registry scans as tables: which versions are stale, their findings, their servers' scores.

Scans, findings and scores are only ever appended. A version is scanned again if the rules
changed since (their fingerprint is part of a scan) or if its content did; a server's score
is that of the findings of its listed latest versions, each from its last scan that worked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import rules as rule_set
from heddle.operators import scoring
from heddle.session import materialise
from heddle.sources.configs import version_configs

SCAN = "scan_id string, version_id {kind}, scanned_at timestamp, rules_fingerprint string, deep boolean, status string"
FINDING = ("rule_id", "title", "severity", "confidence", "owasp", "phase", "detail", "recommendation")


def in_scope(versions: DataFrame) -> DataFrame:
    """Latest versions that are listed; both filters reach the scan."""
    return versions.where(F.col("is_latest") & F.col("delisted_at").isNull())


def scan_plan(versions: DataFrame, scans: DataFrame, hashes: DataFrame, fingerprint: str) -> DataFrame:
    """(version_id, scanned_at, hash_at, stale) of the versions in scope.

    scanned_at is the last scan by these rules, whether it worked or not; a version without
    one is stale, as is one whose content was seen to change later.
    """
    last_scan = scans.where(F.col("rules_fingerprint") == fingerprint).groupBy("version_id").agg(F.max("scanned_at").alias("scanned_at"))
    last_hash = hashes.groupBy("version_id").agg(F.max("observed_at").alias("hash_at"))
    rows = in_scope(versions).select(F.col("id").alias("version_id")).join(last_scan, "version_id", "left").join(last_hash, "version_id",
        "left")
    return rows.withColumn("stale", F.col("scanned_at").isNull() | F.coalesce(F.col("hash_at") > F.col("scanned_at"), F.lit(False)))


def registry_configs(versions: DataFrame, servers: DataFrame) -> DataFrame:
    """What the rules see of a version: its launch configuration with its server's name and
    ``registry:name@version`` as its source. Versions of unknown servers have no name."""
    names = servers.select(F.col("id").alias("server_id"), "name")
    rows = version_configs(versions).join(versions.select(F.col("id").alias("version_id"), "server_id"), "version_id").join(names,
        "server_id", "left")
    return rows.withColumn("source", F.concat(F.lit("registry:"), F.coalesce("name", F.lit("")), F.lit("@"),
        F.coalesce("version", F.lit(""))))


def scan(
    versions: DataFrame, servers: DataFrame, scans: DataFrame, hashes: DataFrame, metadata: DataFrame, now: Column,
    rules: tuple[rule_set.Rule, ...] = rule_set.RULES,
) -> tuple[DataFrame, DataFrame]:
    """The scans and findings to append: every stale version by all rules.

    A version without an identifier can't be launched: its scan has the status error and no
    findings. Findings carry the id of their scan, which is the version's and the instant's.
    """
    fingerprint = rule_set.rules_fingerprint(rules)
    stale = scan_plan(versions, scans, hashes, fingerprint).where("stale").select("version_id")
    picked = versions.join(stale, versions["id"] == stale["version_id"], "left_semi")
    configs = materialise(registry_configs(picked, servers).withColumn("ok", F.col("command").isNotNull()))
    scan_id = F.concat(F.col("version_id").cast("string"), F.lit("@"), F.unix_micros(now).cast("string"))
    done = configs.select(
        scan_id.alias("scan_id"), "version_id", now.alias("scanned_at"), F.lit(fingerprint).alias("rules_fingerprint"),
            F.lit(True).alias("deep"), F.when(F.col("ok"), "ok").otherwise("error").alias("status")
    )
    good = configs.where("ok")
    found = rule_set.evaluate(good, "version_id", rules).unionByName(rule_set.evaluate_metadata(good, "version_id", metadata, now, rules))
    return done, found.select(scan_id.alias("scan_id"), "version_id", *FINDING)


def latest_ok(scans: DataFrame) -> DataFrame:
    """(version_id, scan_id) of each version's last scan that worked."""
    return scans.where("status = 'ok'").groupBy("version_id").agg(F.max_by("scan_id", F.struct("scanned_at", "scan_id")).alias("scan_id"))


def server_findings(versions: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the servers' versions in scope, from each version's last scan that worked."""
    scope = in_scope(versions).select(F.col("id").alias("version_id"), "server_id")
    return scope.join(latest_ok(scans), "version_id").join(findings.drop("version_id"), "scan_id").drop("scan_id")


def server_scores(versions: DataFrame, scans: DataFrame, findings: DataFrame, now: Column, fingerprint: str) -> DataFrame:
    """(server_id, computed_at, score, finding_count, rules_fingerprint) to append: one row per
    server with a version in scope, 100 without findings."""
    scope = in_scope(versions).select("server_id")
    scored = scoring.score(server_findings(versions, scans, findings), scope, "server_id")
    return scored.select("server_id", now.alias("computed_at"), "score", "finding_count", F.lit(fingerprint).alias("rules_fingerprint"))


def scan_summary(plan: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counters over a run: versions in scope, scanned, skipped, failed; findings."""
    seen = plan.agg(F.count("*").alias("versions_seen"), F.count_if(~F.col("stale")).alias("versions_skipped"))
    ran = scans.agg(F.count_if(F.col("status") == "ok").alias("versions_scanned"),
        F.count_if(F.col("status") == "error").alias("versions_errored"))
    wrote = findings.agg(F.count("*").alias("findings_written"))
    one = lambda df: df.withColumn("one__", F.lit(1))
    return one(seen).join(one(ran), "one__").join(one(wrote), "one__").drop("one__")
