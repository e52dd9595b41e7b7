"""Names within a few edits of others: against a short known list, and among millions.

The known list is an array literal, so its comparison needs no join. Among many names, equal
lengths are not needed: each name is joined only with names sharing a variant that has up
to d characters deleted, which any two names within d edits do, and verified. Variants that
no other name has are left out of the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.variants import packed, repeated, unpacked, variants, with_depths
from heddle.session import materialise, ship

# ---- fixed values: well-known packages, in the order that breaks ties ----
KNOWN_SERVERS = [
    "@modelcontextprotocol/server-filesystem",
    "@modelcontextprotocol/server-postgres",
    "@modelcontextprotocol/server-everything",
    "@modelcontextprotocol/server-sqlite",
    "@upstash/context7-mcp",
    "@playwright/mcp",
    "@google/mcp-server",
    "mcp-server-sqlite",
]
# ---- end of fixed values ----
MAX_DISTANCE = 2
#: Deletion variants of names that one worker holds at a time.
AT_ONCE = 1 << 21


def nearest_known(name: Column, known: list[str], max_distance: int = MAX_DISTANCE) -> Column:
    """struct(distance, ord, known) of the nearest known name within the distance, ties in list
    order; null for known names themselves and where none is near."""
    each = F.array(*[F.struct(F.levenshtein(name, F.lit(k), max_distance).alias("distance"), F.lit(i).alias("ord"),
        F.lit(k).alias("known")) for i, k in enumerate(known)])
    near = F.filter(each, lambda s: s["distance"].between(1, max_distance))
    return F.when(name.isNotNull() & ~name.isin(*known), F.array_min(near))


def known_neighbours(packages: DataFrame, known: list[str], max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(known_name, identifier, distance) of distinct packages near each known name; every
    known name has a row, with a null identifier where nothing is near."""
    spark = packages.sparkSession
    names = packages.select(F.col("identifier")).where("identifier IS NOT NULL").distinct()
    d = F.explode(F.array(*[F.struct(F.lit(k).alias("known_name"), F.levenshtein("identifier", F.lit(k),
        max_distance).alias("distance")) for k in known]))
    near = names.select("identifier", d.alias("x")).select("x.known_name", "identifier",
        "x.distance").where(F.col("distance").between(1, max_distance))
    all_known = spark.createDataFrame([(k,) for k in known], "known_name string")
    return all_known.join(near, "known_name", "left")


def close_pairs(names: DataFrame, name: str, max_distance: int = MAX_DISTANCE, at_once: int = AT_ONCE) -> DataFrame:
    """(a, b, distance), a < b: distinct names within the distance of each other.

    Candidates share a fingerprint of a deletion variant, so work follows the number of names times
    their variants, not their square; every candidate is verified. Of the variants, hundreds a
    name, only fingerprints are shuffled: names are dealt into chunks, each sends the first bits
    of its hashes, some two bytes a variant, to be compared with those of other chunks, and
    gets back those that are not its alone. Only such variants are joined. A chunk, like what
    is compared at once, has about ``at_once`` variants, whatever the number of names.
    """
    spark, d = names.sparkSession, max_distance
    ship(spark)
    distinct = materialise(names.select(F.col(name).alias("n")).where("n IS NOT NULL").distinct())
    size, each = F.length("n").cast("double"), F.lit(1.0)
    total = F.lit(1.0)
    for r in range(d):
        each = each * F.greatest(size - r, F.lit(0.0)) / (r + 1)
        total = total + each
    count = max(1, int(distinct.agg(F.sum(total)).first()[0] or 0))
    # By chance alone, one in 64 fingerprints is another's too.
    chunks, part_bits = -(-count // at_once), ((count - 1) // at_once).bit_length()
    bits = min(64, count.bit_length() + 6)
    rest = bits - part_bits
    u = np.uint64

    def send(key: tuple, table: pa.Table) -> pa.Table:
        prints = _fingerprints(table, d, bits)
        ends = np.searchsorted(prints >> u(rest), np.arange(1 << part_bits, dtype=u), "right")
        blocks = np.split(prints & u((1 << rest) - 1), ends[:-1])
        return pa.table({"part": pa.array(range(len(blocks)), pa.int32()), "chunk": pa.array([key[0].as_py()] * len(blocks),
            pa.int32()), "prints": pa.array([packed(b) for b in blocks], pa.binary())})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        owners = table.column("chunk").to_numpy()
        blocks = [unpacked(b.as_py()) for b in table.column("prints")]
        prints, owner = np.concatenate(blocks), np.repeat(owners, [len(b) for b in blocks])
        order = np.argsort(prints, kind="stable")
        order = order[repeated(prints[order])]
        prints, owner = prints[order], owner[order]
        return pa.table({"part": pa.array([key[0].as_py()] * len(owners), pa.int32()), "chunk": pa.array(owners, pa.int32()),
            "prints": pa.array([packed(prints[owner == c]) for c in owners], pa.binary())})

    def keep(table: pa.Table, known: pa.Table) -> pa.Table:
        shared = [unpacked(b.as_py()) + u(p.as_py() << rest) for p, b in zip(known.column("part"), known.column("prints"), strict=True)]
        own = _fingerprints(table, d, bits, unique=False)
        shared = np.unique(np.concatenate([own[repeated(own)], *shared]))
        first = min(bits, 22)
        may = np.zeros(1 << first, bool)
        may[shared >> u(bits - first)] = True
        n, at, keys, gone = _column(table), [np.zeros(0, np.int64)], [np.zeros(0, u)], [np.zeros(0, np.int8)]
        for some, hashes, deleted in with_depths(n, d):
            prints = hashes >> u(64 - bits)
            row, col = np.nonzero(may[prints >> u(bits - first)])
            found = prints[row, col]
            has = shared[np.minimum(np.searchsorted(shared, found), len(shared) - 1)] == found if len(found) else np.zeros(0, bool)
            at.append(some[row[has]])
            keys.append(found[has])
            gone.append(deleted[col[has]])
        at, keys, gone = np.concatenate(at), np.concatenate(keys), np.concatenate(gone)
        order = np.lexsort((gone, keys, at))
        at, keys, gone = at[order], keys[order], gone[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])
        return pa.table({"k": pa.array(keys[new].view(np.int64)), "n": n.take(pa.array(at[new])), "gone": pa.array(gone[new])})

    # Numbers of partitions are given: by bytes, which say nothing of the variants, all would be one task's.
    dealt = distinct.select(F.pmod(F.xxhash64("n"), F.lit(chunks)).cast("int").alias("chunk"), "n").repartition(chunks, "chunk")
    blocks = "part int, chunk int, prints binary"
    sent = dealt.groupBy("chunk").applyInArrow(send, blocks).repartition(1 << part_bits, "part")
    shared = sent.groupBy("part").applyInArrow(compare, blocks).repartition(chunks, "chunk")
    # Both sides of the join read this one exchange.
    keys = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(keep, "k long, n string, gone byte").repartition("k")
    a, b = (keys.select(F.col("n").alias(x), "k", F.col("gone").alias(f"gone_{x}")) for x in "ab")
    # Names e edits apart share a variant with up to e characters deleted; what they share beyond gives the pair again.
    distance = F.levenshtein("a", "b", max_distance)
    near = a.hint("merge").join(b, "k").where("a < b").where(F.greatest("gone_a", "gone_b") <= distance)
    return near.select("a", "b", distance.alias("distance")).distinct()


def _column(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table.column("n").chunks) if table.num_rows else pa.array([], pa.string())


def _fingerprints(table: pa.Table, deletions: int, bits: int, unique: bool = True) -> np.ndarray:
    """The first bits of the hashes of all names' variants, in ascending order."""
    found = [h >> np.uint64(64 - bits) for _, h in variants(_column(table), deletions)]
    found = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if unique and len(found) else found
