"""Policy checks over launch configurations: allowlist, drift, blocked registries, baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import launch
from heddle.operators.publish import severity_at_least
from heddle.operators.rules import fingerprint

# ---- fixed values: kinds of violations ----
UNLISTED, DRIFT, BLOCKED, FINDING = "unlisted_server", "version_drift", "blocked_registry", "finding"
# ---- end of fixed values ----
COLUMNS = ("kind", "server", "rule_id", "severity", "detail")


def identified(configs: DataFrame) -> DataFrame:
    """configs with identity, resolved_version, resolved_digest, package and image_ref."""
    c, kept = F.col, configs.columns
    # Each part is a column of its own projection, computed once however often it is read.
    parts = configs.select("*", launch.package_spec(c("command")).alias("i__spec"), launch.oci_image_ref(c("command")).alias("i__image"))
    parts = parts.withColumn("i__package", launch.package_name_of(c("i__spec")))
    return parts.select(
        *kept,
        launch.identity_of(c("i__package"), c("i__image"), c("name"), c("transport"), c("url"), c("source")).alias("identity"),
        launch.package_version_of(c("i__spec"), c("i__package")).alias("resolved_version"),
        launch.oci_digest(c("i__image")).alias("resolved_digest"),
        c("i__package").alias("package"),
        c("i__image").alias("image_ref"),
    )


def unlisted(servers: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Servers whose identity is on no list (an anti join)."""
    out = servers.join(allowlist.select(F.col("name").alias("identity")), "identity", "left_anti")
    return out.select(F.lit(UNLISTED).alias("kind"), F.col("identity").alias("server"), F.lit(None).cast("string").alias("rule_id"),
        F.lit("high").alias("severity"), F.concat(F.col("identity"), F.lit(" is not on the allowlist")).alias("detail"))


def drifted(servers: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Listed servers that resolve to another version or digest than pinned, or to none."""
    listed = allowlist.select(F.col("name").alias("identity"), F.col("version").alias("p_version"), F.col("digest").alias("p_digest"))
    out = servers.join(listed, "identity").select(
        "identity", F.coalesce("p_digest", "p_version").alias("pinned"), F.when(F.col("p_digest").isNotNull(),
        F.col("resolved_digest")).otherwise(F.col("resolved_version")).alias("found")
    ).where(F.col("pinned").isNotNull() & ~F.col("pinned").eqNullSafe(F.col("found")))
    detail = F.concat(F.col("identity"), F.lit(" is pinned to "), F.col("pinned"), F.lit(" but resolves to "),
        F.coalesce("found", F.lit("nothing")))
    return out.select(F.lit(DRIFT).alias("kind"), F.col("identity").alias("server"), F.lit(None).cast("string").alias("rule_id"),
        F.lit("high").alias("severity"), detail.alias("detail"))


def blocked(servers: DataFrame, registries: list[str]) -> DataFrame:
    """Servers that name a blocked registry in command or url; the first of the list is told."""
    # Each text by itself: what ends one and begins the other is no match.
    command, url = launch.command_text(F.col("command")), F.coalesce("url", F.lit(""))
    hit = F.get(F.filter(F.array(*map(F.lit, registries)).cast("array<string>"), lambda b: F.contains(command, b) | F.contains(url, b)),
        F.lit(0))
    return servers.withColumn("hit", hit).where("hit IS NOT NULL").select(
        F.lit(BLOCKED).alias("kind"), F.col("identity").alias("server"), F.lit(None).cast("string").alias("rule_id"),
            F.lit("critical").alias("severity"), F.concat(F.lit("uses blocked registry "), F.col("hit")).alias("detail")
    )


def finding_violations(findings: DataFrame, fail_on: str, baseline: DataFrame | None = None) -> DataFrame:
    """Findings at or above a severity whose fingerprint is in no baseline."""
    server = F.substring_index("location", " :: ", -1)
    rows = findings.withColumn("server", server).withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("server"),
        F.col("location")))
    if baseline is not None:
        rows = rows.join(baseline.select("fingerprint"), "fingerprint", "left_anti")
    return rows.where(severity_at_least(F.col("severity"), fail_on)).select(F.lit(FINDING).alias("kind"), "server", "rule_id", "severity",
        "detail")


def violations(configs: DataFrame, findings: DataFrame, allowlist: DataFrame, registries: list[str], fail_on: str,
    baseline: DataFrame | None = None) -> DataFrame:
    """All violations, with the list each comes from as ``part`` (their order)."""
    servers = identified(configs)
    parts = (unlisted(servers, allowlist).unionByName(drifted(servers, allowlist)), blocked(servers, registries),
        finding_violations(findings, fail_on, baseline))
    out = None
    for i, p in enumerate(parts):
        p = p.select(*COLUMNS).withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def allowlist_of(configs: DataFrame) -> DataFrame:
    """A first allowlist: each identity with its digest, else its version."""
    s = identified(configs)
    digest = F.max("resolved_digest")
    return s.groupBy(F.col("identity").alias("name")).agg(F.when(digest.isNull(), F.max("resolved_version")).alias("version"),
        digest.alias("digest"))


def baseline_of(findings: DataFrame) -> DataFrame:
    server = F.substring_index("location", " :: ", -1)
    return findings.select(fingerprint(F.col("rule_id"), server, F.col("location")).alias("fingerprint")).distinct()
