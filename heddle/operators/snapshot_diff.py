"""Differences between consecutive full snapshots by Merkle trees over hash ranges.

Keys fall into hash ranges (leaves); a leaf's digest combines its rows' digests in any
order, an inner node's digest its children's. Every pair of consecutive snapshots has one
tree whose nodes hold both sides' digests. It is built once, from the leaves up, and read
from the root down: below nodes that agree nothing is looked at, and rows are compared only
in leaves that differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import materialise

FANOUT_BITS = 4
ROWS_PER_LEAF = 16
MAX_LEAF_BITS = 24
#: Levels above the leaves that are cheaper to aggregate again than to write.
PLAIN_LEVELS = 3


def canonical_json(c: Column) -> Column:
    """Text equal for equal JSON values: members sorted, spacing and escapes gone.

    Texts that are no JSON compare as text; null stays null.
    """
    v = F.to_json(F.try_parse_json(c))
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.concat(F.lit("j"), v), F.concat(F.lit("t"), c)))


def row_digests(df: DataFrame, snapshot: str, key: str, version: str, state: list[Column]) -> DataFrame:
    """(s, k, h, d1, d2): of each snapshot's keys the row of the greatest version, digested.

    Only digests of rows are shuffled, never the rows. Null keys name no record.
    """
    # A null is told from any text by its marker.
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in state])
    return (
        df.select(
            F.col(f"`{snapshot}`").alias("s"), F.col(f"`{key}`").alias("k"), F.col(f"`{version}`").alias("n"),
            F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"),
        )
        .where(F.col("k").isNotNull() & F.col("s").isNotNull())
        .groupBy("s", "k")
        .agg(F.max(F.struct("n", "d1", "d2")).alias("m"))
        .select("s", "k", F.xxhash64("k").alias("h"), "m.d1", "m.d2")
    )


def _sides(names: tuple[str, ...], fold: Callable[[Column], Column]) -> list[Column]:
    return [fold(F.when(F.col("side") == i, F.col(c))).alias(f"{c}_{i}") for i in (0, 1) for c in names]


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """The level above: a node's digests are its children's combined."""
    fold = lambda c: F.sum(c) if c.startswith("n_") else F.bit_xor(c)
    return nodes.groupBy("cur", F.shiftrightunsigned("node", bits).alias("node")).agg(*[fold(c).alias(c) for c in nodes.columns[2:]])


_DIFFER = "NOT (x1_0 <=> x1_1 AND x2_0 <=> x2_1 AND n_0 <=> n_1)"


def differing_leaves(leaves: DataFrame, bits: int) -> DataFrame:
    """(cur, node) of the leaves that differ, found from the root down.

    ``leaves`` (written once) has each side's digests per leaf; a side that lacks a leaf
    differs from any. The levels above are a sixteenth of the one below each and aggregated
    from one another; in trees of more than ``PLAIN_LEVELS`` they are written as one table
    before the descent reads them.
    """
    levels, at = [], leaves
    for level in range(bits - FANOUT_BITS, -1, -FANOUT_BITS):
        at = _up(at, FANOUT_BITS)
        levels.append(at.withColumn("level", F.lit(level)))
    if len(levels) > PLAIN_LEVELS:
        whole = materialise(reduce(DataFrame.unionByName, levels))
        levels = [whole.where(F.col("level") == level) for level in range(bits - FANOUT_BITS, -1, -FANOUT_BITS)]
    found = levels[-1].where(_DIFFER).select("cur", "node")
    for nodes in [*levels[-2::-1], leaves]:
        parents = found.withColumnRenamed("node", "parent")
        below = nodes.withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS)).join(parents, ["cur", "parent"], "left_semi")
        found = below.where(_DIFFER).select("cur", "node")
    return found


def snapshot_changes(digests: DataFrame, rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """(snapshot_no, name, change_kind) against the snapshot before; the first has no rows.

    ``digests`` is what ``row_digests`` gives. change_kind is added, removed or changed.
    The trees have at most 2**MAX_LEAF_BITS leaves, whatever the number of rows.
    """
    digests = materialise(digests)
    # A row per snapshot goes to the driver: the list of snapshots is what their pairs are made of.
    sizes = digests.groupBy("s").agg(F.count("*").alias("rows")).orderBy("s").collect()
    most = max((r["rows"] for r in sizes), default=0)
    levels = max(1, math.ceil(math.log2(max(2, most / rows_per_leaf)) / FANOUT_BITS))
    bits = min(MAX_LEAF_BITS, FANOUT_BITS * levels)
    # A snapshot is the later side of its own pair and the earlier side of the next one's.
    kind = dict(digests.dtypes)["s"]
    steps = [(s, c, side) for a, c in zip(sizes, sizes[1:], strict=False) for s, c, side in ((c["s"], c["s"], 1), (a["s"], c["s"], 0))]
    pairs = digests.sparkSession.createDataFrame(steps, f"s {kind}, cur {kind}, side int")
    # Hash ranges: a leaf is the top bits of the key's hash.
    leafed = digests.withColumn("node", F.shiftrightunsigned("h", 64 - bits))
    own = leafed.groupBy("s", "node").agg(
        F.bit_xor(F.xxhash64("h", "d1", "d2")).alias("x1"), F.bit_xor(F.xxhash64("d2", "d1", "h")).alias("x2"), F.count("*").alias("n")
    )
    sided = lambda df: df.join(F.broadcast(pairs), "s").drop("s")
    # One row of a side per node: the fold only brings the two sides together.
    leaves = materialise(sided(own).groupBy("cur", "node").agg(*_sides(("x1", "x2", "n"), F.max)))
    rows = sided(leafed).join(differing_leaves(leaves, bits), ["cur", "node"], "left_semi")
    kind = (
        F.when(F.col("had") == 0, "added")
        .when(F.col("has") == 0, "removed")
        .when((F.col("d1_0") != F.col("d1_1")) | (F.col("d2_0") != F.col("d2_1")), "changed")
    )
    return (
        rows.groupBy("cur", "k")
        .agg(F.max(1 - F.col("side")).alias("had"), F.max("side").alias("has"), *_sides(("d1", "d2"), F.max))
        .select(F.col("cur").alias("snapshot_no"), F.col("k").alias("name"), kind.alias("change_kind"))
        .where("change_kind IS NOT NULL")
    )
