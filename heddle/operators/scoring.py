"""Findings to a 0-100 score: one finding per rule, multiplied down, with the cascade shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.rules import CONFIDENCE_RANK, SEVERITY_RANK, fired, rank, with_hits

# ---- fixed values: weights ----
SEVERITY_WEIGHT = {"critical": 0.55, "high": 0.35, "medium": 0.15, "low": 0.05}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.7, "low": 0.4}
# ---- end of fixed values ----


def multiplier(severity: Column, confidence: Column) -> Column:
    """What a finding leaves of the score; unknown words take nothing away."""
    pick = lambda c, table: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()], F.lit(0.0))
    return F.lit(1.0) - pick(severity, SEVERITY_WEIGHT) * pick(confidence, CONFIDENCE_FACTOR)


def dedupe_findings(findings: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Per key and rule the finding of greatest severity, then confidence, then least ``order``.

    A partial aggregate (``max_by``): no rows are sorted, and hot keys combine before the shuffle.
    """
    tie = -F.col(order) if order else F.lit(0)
    best = F.struct(F.coalesce(rank(F.col("severity"), SEVERITY_RANK), F.lit(0)).alias("s"),
        F.coalesce(rank(F.col("confidence"), CONFIDENCE_RANK), F.lit(0)).alias("c"), tie.alias("t"))
    rest = [c for c in findings.columns if c not in (key, "rule_id")]
    return findings.groupBy(key, "rule_id").agg(F.max_by(F.struct(*rest), best).alias("f")).select(key, "rule_id", "f.*")


def score(findings: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """(key, score, finding_count) for every key of ``scope``; without findings 100 and 0.

    The product runs in rule order, so that its rounding is the same in any plan; halves
    round to even.
    """
    # Only what the score needs is shuffled.
    one = dedupe_findings(findings.select(key, "rule_id", "severity", "confidence"), key)
    mults = F.array_sort(F.collect_list(F.struct("rule_id", multiplier(F.col("severity"), F.col("confidence")).alias("m"))))
    left = F.aggregate(mults, F.lit(100.0), lambda a, x: a * x["m"])
    scored = one.groupBy(key).agg(left.alias("left"), F.count("*").alias("finding_count"))
    return scope.select(key).distinct().join(scored, key, "left").select(
        key, F.least(F.greatest(F.rint(F.coalesce("left", F.lit(100.0))), F.lit(0.0)), F.lit(100.0)).cast("int").alias("score"),
            F.coalesce("finding_count", F.lit(0)).cast("int").alias("finding_count")
    )


def score_rows(configs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with score and finding_count of each row by the local rules.

    For rows that are a server each: a rule gives at most one finding per row, so nothing
    has to be brought together and nothing is shuffled.
    """
    left = F.aggregate("hits", F.lit(100.0), lambda a, x: a * multiplier(x["severity"], x["confidence"]))
    return with_hits(configs, keep).select(*keep, fired(F.col("hits")).alias("hits")).select(
        *keep, F.least(F.greatest(F.rint(left), F.lit(0.0)), F.lit(100.0)).cast("int").alias("score"), F.size("hits").alias("finding_count")
    )


def cascade(findings: DataFrame, key: str) -> DataFrame:
    """(key, step, rule_id, multiplier, before, after): worst severity and confidence first."""
    worst = F.struct(
        (-F.coalesce(rank(F.col("severity"), SEVERITY_RANK), F.lit(0))).alias("s"),
        (-F.coalesce(rank(F.col("confidence"), CONFIDENCE_RANK), F.lit(0))).alias("c"), F.col("rule_id"),
        multiplier(F.col("severity"), F.col("confidence")).alias("multiplier"),
    )
    lists = dedupe_findings(findings, key).groupBy(key).agg(F.array_sort(F.collect_list(worst)).alias("a"))
    # One finding per rule: the lists are no longer than the rule set.
    before = lambda i: F.aggregate(F.slice("a", F.lit(1), i), F.lit(100.0), lambda acc, x: acc * x["multiplier"])
    steps = F.transform("a", lambda x, i: F.struct((i + 1).alias("step"), x["rule_id"].alias("rule_id"),
        x["multiplier"].alias("multiplier"), before(i).alias("before"), before(i + 1).alias("after")))
    return lists.select(key, F.inline(steps))


def severity_totals(findings: DataFrame) -> DataFrame:
    """Counts by severity and class with subtotals (an extension): null means all."""
    return findings.rollup("severity", "owasp").agg(F.count("*").alias("findings"))
