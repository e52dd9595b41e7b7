"""Evaluation passages inside training texts, exact or with other numbers, names and units.

Words are canonicalised into templates: numbers, units and known names become typed
placeholders. Windows of a fixed number of template words are hash-joined between test
items and documents. Each joined window then has its slots checked: with the same words in
every slot it is a verbatim passage; with other words, but the same replacement wherever a
slot's word recurs, it is a re-parameterised copy. A text is read once; what leaves the
reading stage are windows as numbers, never words or texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import python_input

WINDOW = 13
#: Tests of up to this many bytes sift the documents' windows before the join and are broadcast
#: (a window takes two bytes of text at least, and 40 as a row); the windows of more are joined
#: by a shuffle. Words, templates and results are the same either way.
SIFT_BYTES = 2 << 20
#: The names are held by every worker: a lexicon of more bytes is refused.
LEXICON_BYTES = 64 << 20
#: Words whose numbers a worker remembers, and windows whose slots it lays out at once.
REMEMBERED, AT_ONCE = 200_000, 100_000
#: Units of measure as words of texts.
UNITS = (
    "ms", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "b", "kb", "mb", "gb", "tb", "kib", "mib", "gib", "byte", "bytes",
    "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "inch", "inches", "foot", "feet", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ml", "l", "liter", "liters", "litre", "litres", "percent", "times", "euro", "euros", "dollar",
    "dollars",
)

_WORD = re.compile(r"[^\W_]+")
_GAP = 1


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


def slot_of(word: str, names: frozenset[str], units: frozenset[str] = frozenset(UNITS)) -> int:
    """1 for a number (digits of any script and nothing else), 2 a unit, 3 a name, 0 none.

    By the word alone, so that equal words always give equal templates.
    """
    if word.isdecimal() or (word.isnumeric() and all(unicodedata.category(c)[0] == "N" for c in word)):
        return 1
    return 2 if word in units else 3 if word in names else 0


class Reader:
    """Windows of texts as numbers: position, template hash and the words in its slots.

    With ``only``, the words of all tests, other words that are no slots end the run of
    windows before them, as they can't be part of a match; with ``templates`` only windows of
    those hashes are given. Both leave out what the join would. Hashes are multilinear over
    64-bit numbers of words.
    """

    def __init__(self, names: Iterable[str], size: int, only: Iterable[str] | None = None, templates: np.ndarray | None = None):
        self.names, self.size, self.templates = frozenset(names), size, templates
        self.only = None if only is None else frozenset(only)
        self.weight = np.random.default_rng(13).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        # Codes of words, and by code: template's number (0 ends a run), the word's own, a slot or not.
        self.code: dict[str, int] = {}
        self.rows: list[tuple[int, int, bool]] = [(0, 0, False)] * 2

    def _add(self, word: str) -> int:
        slot = slot_of(word, self.names)
        if slot or self.only is None or word in self.only:
            own = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()) or 1
            self.rows.append((slot or own, own, bool(slot)))
            k = len(self.rows) - 1
        else:
            k = _GAP
        self.code[word] = k
        return k

    def windows(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text's number, position from one, template hash, slots' words, how many) of windows."""
        if len(self.code) > REMEMBERED:
            self._forget()
        get, add = self.code.get, self._add
        codes: list[int] = []
        starts = [0]
        for t in texts:
            codes += [get(w) or add(w) for w in words(t)]
            codes.append(_GAP)
            starts.append(len(codes))
        at_code = np.array(codes, np.int64)
        value, own = (np.array([r[i] for r in self.rows], np.uint64)[at_code] for i in (0, 1))
        slot = np.array([r[2] for r in self.rows], bool)[at_code]
        if len(codes) < self.size:
            return
        gaps = np.concatenate([[0], np.cumsum(value == 0)])
        at = np.flatnonzero(gaps[self.size :] == gaps[: -self.size])
        first, steps = np.array(starts), np.arange(self.size)
        for k in range(0, len(at), AT_ONCE):
            a = at[k : k + AT_ONCE]
            th = np.zeros(len(a), np.uint64)
            for i in range(self.size):
                th += value[a + i] * self.weight[i]
            if self.templates is not None:
                hit = np.isin(th, self.templates)
                a, th = a[hit], th[hit]
            text = np.searchsorted(first, a, "right") - 1
            cells = a[:, None] + steps
            filled = slot[cells]
            yield text, a - first[text] + 1, th, own[cells][filled], filled.sum(axis=1)


def _read(df: DataFrame, key: str, text: str, reader: Reader) -> DataFrame:
    """(key, pos, th, slots) of a table's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):  # few whole texts at a time
                for row, pos, th, slots, many in reader.windows(b.column(1).slice(start, 1000).to_pylist()):
                    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(slots.view(np.int64)))
                    yield pa.record_batch(
                        [b.column(0).take(pa.array(row + start)), pa.array(pos.astype(np.int32)), pa.array(th.view(np.int64)), lists],
                            names=["key", "pos", "th", "slots"]
                    )

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    return python_input(rows).mapInArrow(run, f"key {kind}, pos int, th long, slots array<long>")


def template_matches(
    docs: DataFrame, items: DataFrame, names: DataFrame, doc_key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", name: str = "given_name", size: int = WINDOW,
) -> DataFrame:
    """(doc_key, doc_pos, item_key, item_pos, verbatim, consistent): windows with equal templates.

    verbatim: the same words in all slots. consistent: each slot word of the item stands for
    one word of the document and the other way round. Positions count words from one. Null,
    empty and shorter texts and null keys give nothing. An item without ``size`` words can't
    be found. Repeated keys and rows give repeated windows. ``names`` is a small lexicon that
    becomes part of the reading stage, refused beyond ``LEXICON_BYTES``.
    """
    known_names = names.select(F.col(f"`{name}`").alias("n")).where("n IS NOT NULL").distinct()
    if (known_names.select(F.sum(F.octet_length("n"))).first()[0] or 0) > LEXICON_BYTES:
        raise ValueError(f"more than {LEXICON_BYTES} bytes of names")
    lexicon = sorted({r["n"].lower() for r in known_names.collect()})
    tests = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    plain = Reader(lexicon, size)
    if (tests.select(F.sum(F.octet_length("t"))).first()[0] or 0) <= SIFT_BYTES:
        texts = [r["t"] for r in tests.collect()]
        hashes = [w[2] for w in plain.windows(texts)]
        plain._forget()
        there = Reader(lexicon, size, {w for t in texts for w in words(t)}, np.unique(np.concatenate(hashes)) if hashes else np.empty(0,
            np.uint64))
        hint = F.broadcast
    else:
        there, hint = plain, lambda d: d
    right = _read(tests, "i", "t", plain).select(F.col("key").alias(item_key), F.col("pos").alias("item_pos"), "th",
        F.col("slots").alias("item_slots"))
    found = _read(docs, doc_key, text, there).join(hint(right), "th")
    pairs = F.array_distinct(F.arrays_zip("item_slots", "slots"))
    one_to_one = (F.size(pairs) == F.size(F.array_distinct("item_slots"))) & (F.size(pairs) == F.size(F.array_distinct("slots")))
    verbatim = F.col("slots") == F.col("item_slots")
    return found.select(F.col("key").alias(doc_key), F.col("pos").alias("doc_pos"), item_key, "item_pos", verbatim.alias("verbatim"),
        one_to_one.alias("consistent"))


def leaked_items(matches: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(doc_key, item_key) of documents that hold ``size`` consecutive words of an item."""
    return matches.where("verbatim").select(doc_key, item_key).distinct()


def reparameterised(docs: DataFrame, items: DataFrame, names: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows, verbatim_windows, kind) of every affected pair.

    kind is ``verbatim`` if some window agrees word for word, else ``reparameterised`` if
    some window's slots are replaced consistently: equal slot words of the item are equal in
    the document, and different ones differ. Pairs with neither are not reported.
    """
    matches = template_matches(docs, items, names, size=size).where("consistent")
    return (
        matches.groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("windows"), F.count_if(F.col("verbatim")).alias("verbatim_windows"))
        .withColumn("kind", F.when(F.col("verbatim_windows") > 0, "verbatim").otherwise("reparameterised"))
    )
