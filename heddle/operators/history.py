"""Version history of a changing attribute (type-2 history) from observations.

Every entity's observations become one sorted struct array that a higher-order function
folds, keeping an element only where the value changes; kept elements are exploded as
versions with their end. The fold pairs each element with its predecessor (``zip_with``)
and filters: an ``aggregate`` that concatenates copies its accumulator for every kept
element, which is quadratic.

No array grows with a hot entity. Entities with more than ``segment_rows`` observations are
reduced to one row per instant, numbered in order of time by a parallel sort and cut into
segments of at most that many rows, however unevenly they lie in time; each segment is folded
on its own and the segments are stitched by their first and last values. Only (entity,
segment) summaries meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import BROADCAST_BYTES, materialise, with_ordinal

SEGMENT_ROWS = 50_000
#: Hot entities up to this many become constants of the plan.
NAMED = 1_000


def _split(obs: DataFrame, segment_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of entities up to ``segment_rows``, and those of the hot ones beyond it.

    Few hot entities are named in the filter itself. More are joined: broadcast if they take
    few bytes (64 for each row's place in the table), else by a shuffle.
    """
    hot = materialise(obs.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") > segment_rows).select("e"))
    few = [r["e"] for r in hot.limit(NAMED + 1).collect()]
    if not few:
        return obs, None
    if len(few) <= NAMED:
        named = F.col("e").isin(few)
        return obs.where(~named), obs.where(named)
    size = hot.agg(F.sum(F.octet_length(F.col("e").cast("string")) + 64)).first()[0]
    ids = F.broadcast(hot) if size <= BROADCAST_BYTES else hot
    return obs.join(ids, "e", "left_anti"), obs.join(ids, "e", "left_semi")


def segmented(single: DataFrame, order: list[str], segment_rows: int) -> DataFrame:
    """Rows with their segment ``seg``: at most ``segment_rows`` neighbours in the order.

    Ordinals run on from entity to entity, so a segment's number alone bounds its rows.
    """
    numbered = with_ordinal(single, [F.col(c) for c in order], "at")
    return numbered.withColumn("seg", F.floor(F.col("at") / segment_rows).cast("long")).drop("at")


def _fold(obs: DataFrame, per_instant: bool = True) -> DataFrame:
    """(e, seg, a): array of (t, o, v) at which the value changes within the segment.

    Neighbours are paired by ``zip_with``: a lambda that indexes the array it runs over would
    read the whole array again for every element.
    """
    grouped = obs.groupBy("e", "seg").agg(F.array_sort(F.collect_list(F.struct("t", "o", "v"))).alias("a"))
    # Of one instant (or one row delivered again) the last holds.
    same = lambda x, y: x["t"].eqNullSafe(y["t"]) & (F.lit(per_instant) | x["o"].eqNullSafe(y["o"]))
    held = F.filter(F.zip_with("a", F.slice("a", F.lit(2), F.size("a")), lambda x, y: F.when(~same(x, y), x)), lambda x: x.isNotNull())
    one = grouped.select("e", "seg", held.alias("a"))
    changed = F.filter(
        F.zip_with(F.slice("a", F.lit(2), F.size("a")), "a", lambda x, before: F.when(x.isNotNull() & (x["v"] != before["v"]), x)),
            lambda x: x.isNotNull()
    )
    return one.select("e", "seg", F.concat(F.slice("a", 1, 1), changed).alias("a"))


def version_history(
    df: DataFrame, entity: str, at: str, value: Column, order: str, segment_rows: int = SEGMENT_ROWS, per_instant: bool = True
) -> DataFrame:
    """(entity_id, valid_from_us, valid_to_us, value, order_key): a row per period of an unchanged value.

    ``at`` is a timestamp, ``value`` the (normalised) observed value, ``order`` breaks ties of
    one instant: the greatest holds (unless not ``per_instant``: then all count, in that
    order). order_key is that of the period's first row. Rows with a null entity, instant or value are no
    observation. Repeated rows change nothing. The latest period has a null end. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    obs = df.select(
        F.col(f"`{entity}`").alias("e"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("t"), F.col(f"`{order}`").alias("o"),
            value.alias("v")
    ).where(F.col("e").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull())
    few, hot = _split(obs, segment_rows)
    cold = few.withColumn("seg", F.lit(0).cast("long"))
    if hot is None:
        return _explode(_fold(cold, per_instant).withColumn("seg_end", F.lit(None).cast("long")))
    one = ["e", "t"] if per_instant else ["e", "t", "o"]
    single = (
        hot.groupBy(*one)
        .agg(F.max(F.struct("o", "v") if per_instant else F.struct("v")).alias("m"))
        .select("e", "t", "m.o" if per_instant else "o", "m.v")
    )
    folded = materialise(_fold(segmented(single, one, segment_rows), per_instant))
    # Stitch: a segment's first version is none if the segment before ends in the same value.
    w = Window.partitionBy("e").orderBy("seg")
    first, second, last = F.get("a", F.lit(0)), F.get("a", F.lit(1)), F.element_at("a", -1)
    edges = (
        folded.select("e", "seg", first["v"].alias("v0"), last["v"].alias("v1"), first["t"].alias("t0"), second["t"].alias("t1"))
        .withColumn("same", F.coalesce(F.lag("v1").over(w) == F.col("v0"), F.lit(False)))
        .withColumn("start", F.when(F.col("same"), F.col("t1")).otherwise(F.col("t0")))
        .withColumn("seg_end", F.first("start", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
        .select("e", "seg", "same", "seg_end")
    )
    stitched = folded.join(edges, ["e", "seg"]).select(
        "e", F.when(F.col("same"), F.slice("a", F.lit(2), F.size("a"))).otherwise(F.col("a")).alias("a"), "seg_end"
    )
    plain = _fold(cold, per_instant).select("e", "a", F.lit(None).cast("long").alias("seg_end"))
    return _explode(plain).unionByName(_explode(stitched))


def _explode(folded: DataFrame) -> DataFrame:
    """One row per version; it ends where the next begins, the segment's last at ``seg_end``."""
    return (
        folded.select("e", "seg_end", F.explode(F.arrays_zip(F.col("a").alias("x"),
            F.slice("a", F.lit(2), F.size("a")).alias("y"))).alias("z"))
        .select(
            F.col("e").alias("entity_id"),
            F.col("z.x.t").alias("valid_from_us"),
            F.coalesce(F.col("z.y.t"), F.col("seg_end")).alias("valid_to_us"),
            F.col("z.x.v").alias("value"),
            F.col("z.x.o").alias("order_key"),
        )
    )
