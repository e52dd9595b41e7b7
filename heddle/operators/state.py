"""Registry state as snapshots: upsert, mark-and-sweep delisting, relisting, change ledger.

A poll and the state meet in one full outer join by key; the result is the next snapshot,
written beside the old one and switched to, so an aborted run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.history import version_history
from heddle.session import materialise


def upsert(state: DataFrame, poll: DataFrame, keys: list[str], attributes: list[str], run_at: Column) -> DataFrame:
    """Next state: keys, attributes, first_seen_at, last_seen_at, delisted_at, change.

    change is new, updated, relisted, delisted (gone in this poll) or absent (gone before).
    Keys of the poll count once: of repeated ones the greatest row holds. Attributes come
    from the poll where it has the key, null or not. Rows with a null key part are dropped.
    """
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    new = poll.where(whole).groupBy(*keys).agg(F.max(F.struct(*attributes)).alias("p"))
    old = state.where(whole).select(*keys, F.struct(*attributes, "first_seen_at", "last_seen_at", "delisted_at").alias("o"))
    both = old.join(new, keys, "full_outer")
    here, known = F.col("p").isNotNull(), F.col("o").isNotNull()
    change = (
        F.when(here & ~known, "new").when(here & F.col("o.delisted_at").isNotNull(), "relisted").when(here,
            "updated").when(F.col("o.delisted_at").isNull(), "delisted").otherwise("absent")
    )
    return both.select(
        *keys,
        *[F.when(here, F.col(f"p.`{a}`")).otherwise(F.col(f"o.`{a}`")).alias(a) for a in attributes],
        F.coalesce("o.first_seen_at", run_at).alias("first_seen_at"),
        F.when(here, run_at).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(~here, F.coalesce("o.delisted_at", run_at)).alias("delisted_at"),
        change.alias("change"),
    )


def replay(first: DataFrame, polls: list[tuple[DataFrame, Column, Column]], keys: list[str], attributes: list[str]) -> list[DataFrame]:
    """The upserts of (poll, run_at, label) one after the other, each with its label as ``poll_no``.

    Each state is written before the next poll meets it, so no poll is computed twice and plans
    do not grow with the number of polls.
    """
    out, state = [], first
    for i, (poll, run_at, label) in enumerate(polls):
        done = upsert(state, poll, keys, attributes, run_at)
        done = materialise(done) if i < len(polls) - 1 else done
        out.append(done.withColumn("poll_no", label))
        state = done.drop("change")
    return out


def poll_summary(upserted: DataFrame, *by: str) -> DataFrame:
    """One row of counters over an upsert's result, or for each of ``by`` over several."""
    kinds = ("new", "updated", "relisted", "delisted", "absent")
    return upserted.groupBy(*by).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds],
        F.count_if(F.col("delisted_at").isNull()).alias("listed"))


def latest(df: DataFrame, key: str, at: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the columns of the row with the greatest (at, order): a hash aggregate, no sort."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, order)).alias("x")).select(key,
        "x.*")


def change_ledger(observations: DataFrame, key: str, at: str, order: str, value: str) -> DataFrame:
    """(key, at_us, order, value): rows that differ from the one before of their key, which is
    what an append-on-change ledger keeps.

    Exact repeats of a row count once; null values are no observation. Keys of any size:
    the history operator cuts hot ones along time.
    """
    h = version_history(observations, key, at, F.col(f"`{value}`"), order, per_instant=False)
    return h.select(F.col("entity_id").alias(key), F.col("valid_from_us").alias("at_us"), F.col("order_key").alias(order),
        F.col("value").alias(value))


def score_pairs(scores: DataFrame) -> DataFrame:
    """(server_id, score, previous_score, finding_count, computed_at): the latest of each server
    beside the one before it."""
    w = Window.partitionBy("server_id").orderBy(F.desc("computed_at"), F.desc("id"))
    # A dense rank counts repeated rows once, and its limit prunes each task before the shuffle.
    rows = scores.where("score IS NOT NULL").select("server_id", "id", "computed_at", "score", "finding_count")
    top = rows.withColumn("r", F.dense_rank().over(w)).where("r <= 2")
    last = lambda c: F.max(F.when(F.col("r") == 1, F.col(c))).alias(c)
    return top.groupBy("server_id").agg(last("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("previous_score"),
        last("finding_count"), last("computed_at"))


def newly_flagged(pairs: DataFrame) -> DataFrame:
    """Servers whose latest score fell below 100 from 100, or that start below it."""
    return pairs.where("score < 100 AND (previous_score IS NULL OR previous_score >= 100)")
