"""The N best rows of every group, exact, with a fixed order among equals.

A first pass counts a histogram of scores per group (map-side combined, in a fixed number
of score buckets). Read from the top, the bucket in which the N-th row must lie is a safe
lower threshold; where that bucket alone holds many rows, as with many equal scores, a
second histogram over the first tie key bounds it further. Rows below are filtered before
anything is sorted, and the survivors are ranked exactly with all tie keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import materialise

#: Buckets per unit of ln(1 + |score|): integers up to 100 get a bucket each.
RESOLUTION = 128
#: Buckets of a tie key within the threshold bucket of one group.
TIE_BUCKETS = 4096
#: Only groups this many times larger than N get a threshold: smaller ones are ranked whole.
WORTH = 8
#: Thresholds up to this many groups are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 300_000


def _bucket(x: Column) -> Column:
    """A monotone bucket of a number, the same for all groups."""
    return F.signum(x) * F.rint(RESOLUTION * F.log1p(F.abs(x)))


def _at_least(key: Column, n: int) -> list[Column]:
    """Words whose set bits are no more than the distinct keys seen, and close for up to n of them.

    Rows delivered twice set the same bit, so they can't be taken for two survivors.
    """
    h = F.xxhash64(key)
    words = max(1, -(-4 * n // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    word = F.pmod(F.shiftrightunsigned(h, 8), F.lit(words))
    return [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(words)]


def top_n_per_group(df: DataFrame, group: str, score: str, tie_keys: Sequence[str], row_key: str, n: int) -> DataFrame:
    """The ``n`` first rows of each group by score, then ``tie_keys``, all descending.

    Gives (group, row_key, score, tie keys, rank). Rows with a null or NaN score, or a null
    group, don't compete. Rows that agree in row_key, score and tie keys are one row (a
    repeated delivery); rows with different keys all compete. Null tie keys come last.
    Groups with fewer rows come out whole; an empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    ties = [t for t in tie_keys if t != row_key]
    rows = df.select(
        F.col(f"`{group}`").alias("g"), F.col(f"`{score}`").alias("s"), F.col(f"`{row_key}`").alias("k"),
            *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(ties)]
    ).where(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double")))
    rows = rows.withColumn("b", _bucket(F.col("s").cast("double")))
    tie = _number(rows, "t0") if ties else F.lit(None).cast("double")

    counts = _at_least(F.col("k"), n)
    seen = sum((F.bit_count(f"w{i}") for i in range(len(counts))), F.lit(0))
    hist = rows.groupBy("g", "b").agg(*counts, F.count("*").alias("c"), F.min(tie).alias("lo"), F.max(tie).alias("hi"),
        (F.min("s") == F.max("s")).alias("one"))
    down = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = hist.withColumn("seen", seen).withColumn("above", F.sum("seen").over(down) - F.col("seen")).withColumn("total",
        F.sum("c").over(Window.partitionBy("g")))
    threshold = materialise(
        reached.where((F.col("total") > WORTH * n) & (F.col("above") < n) & (F.col("above") + F.col("seen") >= n)).select("g",
            F.col("b").alias("tb"), "above", "c", "lo", "hi", "one")
    )
    groups = threshold.count()
    hint = F.broadcast if groups <= BROADCAST_GROUPS else (lambda d: d)
    kept = rows
    if groups:
        crowded = threshold.where(F.col("one") & (F.col("c") > WORTH * n) & F.col("lo").isNotNull() & (F.col("hi") > F.col("lo")))
        limits = threshold.select("g", "tb")
        if ties:
            within = F.floor((tie - F.col("lo")) / (F.col("hi") - F.col("lo")) * TIE_BUCKETS)
            at = rows.join(hint(crowded.withColumnRenamed("tb", "b")), ["g", "b"]).select("g", "k",
                F.coalesce(within, F.lit(-1)).alias("q"), "above", "lo", "hi")
            hist2 = at.groupBy("g", "q", "above", "lo", "hi").agg(*_at_least(F.col("k"), n)).withColumn("seen", seen)
            down2 = Window.partitionBy("g").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            second = (
                hist2.withColumn("before", F.sum("seen").over(down2) - F.col("seen") + F.col("above"))
                .where((F.col("before") < n) & (F.col("before") + F.col("seen") >= n))
                .select("g", F.col("q").alias("tq"), "lo", "hi")
            )
            limits = materialise(limits.join(second, "g", "left"))
        kept = rows.join(hint(limits), "g", "left")
        keep = F.col("tb").isNull() | (F.col("b") > F.col("tb"))
        equal = F.col("b") == F.col("tb")
        if ties:
            within = F.floor((tie - F.col("lo")) / (F.col("hi") - F.col("lo")) * TIE_BUCKETS)
            # There is a tq only where the bucket holds one score; else the whole bucket is kept.
            equal = equal & (F.col("tq").isNull() | (F.coalesce(within, F.lit(-1)) >= F.col("tq")))
        kept = kept.where(keep | equal)
    order = [F.desc("s"), *[F.desc(f"t{i}") for i in range(len(ties))], F.desc("k")]
    ranked = kept.withColumn("rank", F.dense_rank().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    cols = ["g", "k", "s", *[f"t{i}" for i in range(len(ties))], "rank"]
    names = [group, row_key, score, *ties, "rank"]
    return ranked.select(*cols).distinct().toDF(*names)


def _number(rows: DataFrame, name: str) -> Column:
    """A monotone number of an integer or time column; other types give null (no second histogram)."""
    kind = dict(rows.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("double")
    return F.lit(None).cast("double")
