"""Filling containers of fixed capacity with texts of varying token counts.

Packing needs only how many items of each size there are, and sizes are at most the
capacity: a histogram of at most `capacity` rows stands for any number of texts. On it,
Martello and Toth's reduction first fixes sets that provably dominate all others (an item
alone, an item with its exact complement, an item with the largest partner where no two, or
no three, further items fit better); best-fit decreasing packs the remainder, whole classes
of equal containers at a time. The plan maps ranges of ranks within a size to containers,
and texts get their rank in parallel, hot sizes split by a salt.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import materialise, python_input, ship_file

#: Where the driver finds the vocabulary; the workers get it through the shared folder.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public word-splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Windows whose plans one stage of Python workers holds; more take more stages.
WINDOWS_AT_ONCE = 8
#: Rows of one size that are ranked by one task.
RANK_ROWS = 100_000

_ENCODERS: dict = {}


def _encoder(name: str):
    """Encoder of a shipped vocabulary, read once per worker."""
    if name not in _ENCODERS:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[name] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0 tokens.

    ``tokenizer`` is a vocabulary file that the driver can read.
    """
    vocabulary = ship_file(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for b in batches:
            # Lone surrogates can't occur in Arrow's UTF-8.
            parts = (b.column(1).slice(k, 500).to_pylist() for k in range(0, b.num_rows, 500))
            sizes = [len(encode(t)) if t else 0 for part in parts for t in part]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return python_input(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).mapInArrow(run,
        "doc_id long, n_tokens long")


class _Left:
    """Counts of the sizes not yet packed, with their order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0 and s > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, most: int) -> int:
        i = bisect_right(self.order, most)
        return self.order[i - 1] if i else 0

    def smallest(self, how_many: int, but: int) -> list[int]:
        """The smallest items (not sizes), without one item of size ``but``."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(how_many - len(out), self.n[s] - (s == but))
            if len(out) == how_many:
                break
        return out


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominating sets fixed for good, as (sizes, how many containers), and what is left.

    A set dominates if the other items of any set with the same largest item can be put
    into the places of its items; fixing it keeps some optimal packing reachable.
    """
    left, fixed = _Left(counts), []
    for s in sorted(left.n, reverse=True):
        while left.n.get(s):
            room = capacity - s
            k = left.largest(room)
            if k == s and left.n[s] == 1:  # it is the only item of its size
                i = bisect_left(left.order, s)
                k = left.order[i - 1] if i else 0
            if not k:  # nothing fits beside it
                fixed.append(((s,), left.n[s] if s > room else 1))
                left.take(s, fixed[-1][1])
                continue
            pairs = left.n[s] // 2 if k == s else min(left.n[s], left.n[k])
            few = left.smallest(3, s)
            only_one = len(few) < 2 or few[0] + few[1] > room
            only_two = not only_one and (len(few) < 3 or sum(few) > room)
            if k != room and not only_one and not (only_two and not _pair_beats(left, s, room, k)):
                break
            # What the last rule rests on, which sizes are there once, twice or thrice, holds
            # until few of s or k are left: all but those are fixed at once.
            fixed.append(((s, k), pairs if k == room or only_one else max(1, pairs - 3)))
            take = fixed[-1][1]
            if k == s:
                left.take(s, 2 * take)
            else:
                left.take(s, take)
                left.take(k, take)
    return fixed, left.n


def _pair_beats(left: _Left, s: int, room: int, k: int) -> bool:
    """Do two further items within ``room`` fill more of it than ``k``?

    Two pointers over the sizes as they stand, and out at the first such pair: where sizes are
    dense one is met at once, and where they are not there are few.
    """
    order, n = left.order, left.n
    i, j = 0, bisect_right(order, room) - 1
    while i <= j:
        x, y = order[i], order[j]
        if x + y > room:
            j -= 1
        elif x + y <= k:
            i += 1
        elif x == y:
            return n[x] - (x == s) > 1
        elif n[x] == (x == s):  # the item itself, the only one of its size
            i += 1
        elif n[y] == (y == s):
            j -= 1
        else:
            return True
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing as classes of equal containers: (((size, times), ...), how many)."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple, how_many: int) -> None:
        if how_many:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((content, how_many))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                content, have = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, content, have = capacity, (), n
            each = room // s
            full = min(have, n // each)
            put(room - each * s, (content, (s, each)), full)
            n -= full * each
            if content or room < capacity:
                if n and full < have:  # the last one takes the rest
                    put(room - n * s, (content, (s, n)), 1)
                    full, n = full + 1, 0
                put(room, content, have - full)
            elif n and n < each:
                put(room - n * s, (content, (s, n)), 1)
                n = 0
    return [(_unroll(content), k) for room in rooms for content, k in open_[room]]


def _unroll(content: tuple) -> tuple[tuple[int, int], ...]:
    out = []
    while content:
        content, item = content
        out.append(item)
    return tuple(reversed(out))


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int, int]:
    """Intervals of ranks within sizes and their containers; containers in all; fixed ones.

    Arrays: size, first (rank), container (of that rank), times (items of the size in each
    container), sorted by size and first rank.
    """
    fixed, left = reduce_instance(counts, capacity)
    classes = [(tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes)), k) for sizes, k in fixed] + best_fit(left, capacity)
    used: dict[int, int] = {}
    rows, container = [], 0
    for content, k in classes:
        for s, times in content:
            rows.append((s, used.get(s, 0), container, times))
            used[s] = used.get(s, 0) + times * k
        container += k
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("size", "first", "container", "times"), cols, strict=True)), container, sum(k for _, k in fixed)


def fill_containers(docs: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(window_id, container_id, doc_id, piece_no, token_from, n_tokens): every text assigned.

    A text longer than the capacity is cut into full containers and a rest (piece_no from
    0); all others stay whole, in one container. Texts without tokens (null, empty) need no
    container: container_id is null. A null doc_id is assigned like any other. Windows with
    a null or non-positive capacity are left out. Repeated doc_ids are assigned each.
    Other columns are ignored.

    The driver holds one number for each size that occurs. D different sizes take at least
    D squared / 2 tokens, so there are at most some 7 million in 100 TB of text, whatever the
    capacity. Windows are planned ``WINDOWS_AT_ONCE`` at a time.
    """
    sizes = [(r["window_id"], r["capacity_tokens"]) for r in windows.select("window_id",
        "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("window_id").collect()]
    counted = materialise(token_counts(docs, tokenizer=tokenizer))
    kind = dict(windows.dtypes)["window_id"]
    groups = [sizes[i : i + WINDOWS_AT_ONCE] for i in range(0, len(sizes), WINDOWS_AT_ONCE)] or [[]]
    return reduce(DataFrame.unionByName, [_filled(counted, group, kind, rank_rows) for group in groups])


def _histogram(pieces: DataFrame, window) -> dict[int, int]:
    """How many pieces of each size a window has."""
    rows = pieces.where((F.col("window_id") == F.lit(window)) & (F.col("size") > 0)).groupBy("size").count().toArrow()
    return dict(zip(rows.column("size").to_pylist(), rows.column("count").to_pylist(), strict=True))


def _filled(counted: DataFrame, sizes: list[tuple], kind: str, rank_rows: int) -> DataFrame:
    """All texts in containers of a few windows."""
    caps = F.array(*[F.struct(F.lit(w).cast(kind).alias("window_id"), F.lit(int(c)).cast("long").alias("cap")) for w,
        c in sizes]).cast(f"array<struct<window_id:{kind},cap:bigint>>")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("cap")) - 1, F.lit(0).cast("long"))
    pieces = (
        counted.select("doc_id", "n_tokens", F.inline(caps))
        .select("doc_id", "window_id", "cap", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
        .select(
            "window_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("token_from"),
            F.least("cap", F.col("n_tokens") - F.col("piece_no") * F.col("cap")).alias("size"),
        )
    )
    hist = {w: _histogram(pieces, w) for w, _ in sizes}
    plans = {w: packing_plan(hist[w], c)[0] for w, c in sizes}
    most = max((n for h in hist.values() for n in h.values()), default=0)
    salts = -(-most // rank_rows) or 1
    # Ranks within a size: by salt, then by the salts' counts before.
    items = pieces.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    inner = Window.partitionBy("window_id", "size", "salt").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("r", F.row_number().over(inner).cast("long") - 1)
    if salts > 1:
        before = Window.partitionBy("window_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = items.groupBy("window_id", "size", "salt").count()
        starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).drop("count")
        ranked = ranked.join(starts, ["window_id", "size", "salt"]).withColumn("r", F.col("r") + F.col("start"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {w: (p["size"] << 40) + p["first"] for w, p in plans.items()}
        names = ["window_id", "container_id", "doc_id", "piece_no", "token_from", "n_tokens"]
        for b in batches:
            win, size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            out = np.zeros(len(win), np.int64)
            for w, p in plans.items():
                at = np.flatnonzero(win == w)
                if len(at):
                    k = np.searchsorted(keys[w], (size[at].astype(np.int64) << 40) + rank[at], "right") - 1
                    out[at] = p["container"][k] + (rank[at] - p["first"][k]) // p["times"][k]
            yield pa.record_batch([b.column(0), pa.array(out), *[b.column(i) for i in range(1, 5)]], names=names)

    schema = f"window_id {kind}, container_id long, doc_id long, piece_no long, token_from long, n_tokens long"
    placed = ranked.select("window_id", "doc_id", "piece_no", "token_from", "size", "r").mapInArrow(place, schema)
    none = pieces.where("size <= 0").select(
        "window_id", F.lit(None).cast("long").alias("container_id"), "doc_id", "piece_no", "token_from", F.col("size").alias("n_tokens")
    )
    return placed.unionByName(none)


def fill_summary(assigned: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: texts, pieces, containers, the least possible number and the share filled."""
    per = assigned.where("container_id IS NOT NULL").groupBy("window_id").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers")
    )
    return per.join(windows.select("window_id", "label", F.col("capacity_tokens").cast("long").alias("capacity")), "window_id").select(
        "window_id", "label", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"),
    )
