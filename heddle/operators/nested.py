"""Deeply nested JSON records to flat linked tables by vectorised structural indexing.

A batch of texts is one byte buffer. Bitmaps of quotes (without escaped ones), brackets and
delimiters are built over it, string interiors are masked by the parity of a prefix sum of
quotes, nesting depth is a prefix sum of brackets, and sorting the delimiters by (record,
depth, position) puts each container's delimiters side by side, so that the spans of all
members and elements come out at once. No record is parsed on its own, but for texts that
were encoded twice and strings holding escapes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import python_input

CHUNK_BYTES = 16 << 20
SCHEMA = "origin string, record_id long, relation string, parent_pos long, item_key string, value string"
_OUT = pa.schema([("origin", pa.string()), ("record_id", pa.int64()), ("relation", pa.string()), ("parent_pos", pa.int64()),
    ("item_key", pa.string()), ("value", pa.string())])

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '{}[]:,"']] = True
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in " \t\r\n"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
OBJ, ARR, STR, NULL = ord("{"), ord("["), ord('"'), ord("n")


class Index:
    """Members and elements of every container in a buffer of JSON texts.

    buf: bytes; off: offsets of the texts. Nodes are rows of parallel arrays: row (text),
    box (the container's number), pos (place in an array, else -1), k0, k1 (span of the
    quoted key), v0, v1 (span of the value), kind (first byte of the value), own (number of
    the container that the value is, else -1). root: per text its container's number, -1
    where the text is no complete object or array; r0, r1: the text's span without space.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, rows = buf, len(off) - 1
        marks = np.flatnonzero(_MARK[buf])
        row = np.searchsorted(off, marks, "right") - 1
        ch = buf[marks]
        # Quotes after an odd run of backslashes are escaped; runs end at a text's start.
        plain = np.where(buf != 92, np.arange(len(buf)), -1)
        plain = np.maximum.accumulate(plain) if len(buf) else plain
        before = np.maximum(np.where(marks > 0, plain[marks - 1], -1), off[row] - 1)
        quote = (ch == STR) & ((marks - 1 - before) % 2 == 0)
        count = np.concatenate([[0], np.cumsum(quote)])
        first = np.searchsorted(marks, off[:-1])
        last = np.searchsorted(marks, off[1:])
        whole = (count[last] - count[first]) % 2 == 0
        keep = ~((count[:-1] - count[first[row]]) % 2).astype(bool) & (ch != STR)
        tok, trow = marks[keep], row[keep]
        step = _STEP[buf[tok]]
        total = np.concatenate([[0], np.cumsum(step)])
        first, last = np.searchsorted(tok, off[:-1]), np.searchsorted(tok, off[1:])
        after = total[1:] - total[first[trow]]
        whole &= (total[last] == total[first]) & (last > first)
        bad = np.zeros(rows, bool)
        bad[trow[(after < 0) | ((after == 0) & (step == 0))]] = True
        inner = (after == 0) & (np.arange(len(tok)) != last[trow] - 1)  # closed before the end
        bad[trow[inner]] = True
        whole &= ~bad
        solid = np.flatnonzero(~_SPACE[buf])
        self._solid = solid
        # The whole text must be one container: nothing but space around it.
        has = np.flatnonzero(whole)
        self.r0, self.r1 = self._trim(off[:-1], off[1:])
        lo, hi = self.r0[has], self.r1[has]
        whole[has] = (tok[first[has]] == lo) & (tok[last[has] - 1] == hi - 1)
        ok = whole[trow]
        tok, trow, step, after = tok[ok], trow[ok], step[ok], after[ok]
        depth = np.where(step < 0, after + 1, after)
        order = np.lexsort((tok, depth, trow))
        tok, trow, step = tok[order], trow[order], step[order]
        at = np.arange(len(tok))
        box = np.maximum.accumulate(np.where(step > 0, at, 0)) if len(tok) else at
        kind = buf[tok]
        array = buf[tok[box]] == ARR
        # A bracket closed by the wrong kind makes the text no JSON.
        wrong = (step < 0) & ((kind == ord("]")) != array)
        broken = np.zeros(rows, bool)
        broken[trow[wrong]] = True
        value = (array & (step >= 0)) | (kind == ord(":"))
        value &= ~broken[trow]
        i = np.flatnonzero(value)
        v0, v1 = self._trim(tok[i] + 1, tok[np.minimum(i + 1, len(tok) - 1)])
        i, v0, v1 = i[v1 > v0], v0[v1 > v0], v1[v1 > v0]
        self.row, self.box, self.v0, self.v1 = trow[i], box[i], v0, v1
        inarr = array[i]
        self.pos = np.where(inarr, i - box[i], -1)
        k0, k1 = self._trim(tok[np.maximum(i - 1, 0)] + 1, tok[i])
        self.k0, self.k1 = np.where(inarr, 0, k0), np.where(inarr, 0, k1)
        self.kind = buf[v0]
        opens = np.flatnonzero(step > 0)
        by_pos = opens[np.argsort(tok[opens])]
        where = np.searchsorted(tok[by_pos], v0)
        self.own = np.where(np.isin(self.kind, (OBJ, ARR)), by_pos[np.minimum(where, max(0, len(by_pos) - 1))] if len(by_pos) else -1, -1)
        self.boxes = len(tok)
        self.root = np.full(rows, -1)
        tops = np.searchsorted(trow, np.arange(rows))
        good = np.flatnonzero(whole & ~broken)
        self.root[good] = tops[good]
        self.is_object = ~array

    def _trim(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._solid) or not len(lo):
            return lo, lo
        a = self._solid[np.minimum(np.searchsorted(self._solid, lo), len(self._solid) - 1)]
        b = self._solid[np.maximum(np.searchsorted(self._solid, hi) - 1, 0)] + 1
        return a, np.maximum(b, a) if len(a) else b

    def texts(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The bytes of many spans as one string array."""
        size = np.maximum(hi - lo, 0)
        ends = np.cumsum(size)
        take = np.repeat(lo - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
            pa.py_buffer(self.buf[take])).cast(pa.string())

    def strings(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Spans of quoted strings, decoded."""
        raw = self.texts(lo + 1, hi - 1)
        escaped = np.flatnonzero(pc.find_substring(raw, "\\").to_numpy(zero_copy_only=False) >= 0)
        if not len(escaped):
            return raw
        out = raw.to_pylist()
        for i in escaped:
            try:
                out[i] = json.loads(f'"{out[i]}"', strict=False).encode("utf-8", "replace").decode()
            except ValueError:
                pass
        return pa.array(out, pa.string())

    def below(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes directly in the given containers: (node, which of boxes)."""
        slot = np.full(self.boxes + 1, -1)
        slot[boxes] = np.arange(len(boxes))
        at = slot[self.box]
        nodes = np.flatnonzero(at >= 0)
        return nodes, at[nodes]

    def member(self, boxes: np.ndarray, *names: str) -> list[np.ndarray]:
        """For each name, per container the node of that member, -1 where there is none."""
        nodes, at = self.below(boxes)
        keyed = self.pos[nodes] < 0
        nodes, at = nodes[keyed], at[keyed]
        keys = self.strings(self.k0[nodes], self.k1[nodes])
        out = []
        for name in names:
            hit = np.flatnonzero(pc.equal(keys, name).to_numpy(zero_copy_only=False))
            got = np.full(len(boxes), -1)
            got[at[hit]] = nodes[hit]  # of a repeated member the last holds
            out.append(got)
        return out

    def of_kind(self, nodes: np.ndarray, kind: int) -> np.ndarray:
        """Indices into ``nodes`` of those that are there and of the kind."""
        return np.flatnonzero((nodes >= 0) & (self.kind[nodes] == kind)) if len(self.kind) else np.empty(0, int)


class _Rows:
    """Collects the linked rows of a chunk."""

    def __init__(self, ix: Index, origin: str, ids: pa.Array):
        self.ix, self.origin, self.ids, self.parts = ix, origin, ids, []

    def add(self, relation: str, nodes: np.ndarray, parent: np.ndarray, keys: pa.Array) -> None:
        ix = self.ix
        self._put(relation, ix.row[nodes], parent, keys, ix.v0[nodes], ix.v1[nodes])

    def roots(self, relation: str) -> np.ndarray:
        """The texts that are objects, each as a row that is in no list; their containers."""
        ix = self.ix
        texts = np.flatnonzero(ix.root >= 0)
        texts = texts[ix.is_object[ix.root[texts]]]
        none = np.full(len(texts), -1)
        self._put(relation, texts, none, pa.array(none).cast(pa.string()), ix.r0[texts], ix.r1[texts])
        return ix.root[texts]

    def _put(self, relation: str, row: np.ndarray, parent: np.ndarray, keys: pa.Array, lo: np.ndarray, hi: np.ndarray) -> None:
        if len(row):
            self.parts.append(
                pa.record_batch(
                    [
                        pa.array([self.origin]).take(pa.array(np.zeros(len(row), int))),
                        self.ids.take(pa.array(row)).cast(pa.int64()),
                        pa.array([relation]).take(pa.array(np.zeros(len(row), int))),
                        pa.array(parent.astype(np.int64)),
                        keys,
                        self.ix.texts(lo, hi),
                    ],
                    schema=_OUT,
                )
            )

    def elements(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Non-null elements of arrays: (node, which of boxes)."""
        nodes, at = self.ix.below(boxes)
        ok = (self.ix.pos[nodes] >= 0) & (self.ix.kind[nodes] != NULL)
        return nodes[ok], at[ok]

    def listed(self, relation: str, lists: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of arrays as rows keyed by their position."""
        nodes, at = self.elements(self.ix.own[lists])
        self.add(relation, nodes, parent[at], pa.array(self.ix.pos[nodes]).cast(pa.string()))
        return nodes, at

    def arguments(self, relation: str, lists: np.ndarray, parent: np.ndarray) -> None:
        """Strings, and objects with a non-empty name or a non-null value."""
        ix = self.ix
        nodes, at = self.elements(ix.own[lists])
        objects = np.flatnonzero(ix.kind[nodes] == OBJ)
        name, value = ix.member(ix.own[nodes[objects]], "name", "value")
        named = np.zeros(len(objects), bool)
        named[ix.of_kind(name, STR)] = True
        named &= ix.v1[name] - ix.v0[name] > 2
        valued = (value >= 0) & (ix.kind[value] != NULL) if len(ix.kind) else named
        ok = ix.kind[nodes] == STR
        ok[objects] = named | valued
        self.add(relation, nodes[ok], parent[at[ok]], pa.array(ix.pos[nodes[ok]]).cast(pa.string()))

    def named(self, relation: str, nodes: np.ndarray, parent: np.ndarray, choices: bool) -> None:
        """Names of a map's keys or of a list's objects, with the objects' choices."""
        ix = self.ix
        maps = ix.of_kind(nodes, OBJ)
        inner, at = ix.below(ix.own[nodes[maps]])
        self.add(relation, inner, parent[maps][at], ix.strings(ix.k0[inner], ix.k1[inner]))
        lists = ix.of_kind(nodes, ARR)
        items, at = self.elements(ix.own[nodes[lists]])
        ok = ix.kind[items] == OBJ
        items, at = items[ok], at[ok]
        name, options = ix.member(ix.own[items], "name", "choices")
        has = ix.of_kind(name, STR)
        has = has[ix.v1[name[has]] - ix.v0[name[has]] > 2]
        items, at, name, options = items[has], at[has], name[has], options[has]
        texts = ix.strings(ix.v0[name], ix.v1[name])
        self.add(relation, items, parent[lists][at], texts)
        if choices:
            with_list = ix.of_kind(options, ARR)
            opts, of = self.elements(ix.own[options[with_list]])
            keys = pc.binary_join_element_wise(texts.take(pa.array(with_list[of])), pa.array(ix.pos[opts]).cast(pa.string()), "/")
            self.add("choices", opts, parent[lists][at][with_list[of]], keys)


def _registry(rows: _Rows) -> None:
    ix = rows.ix
    roots = ix.root[ix.root >= 0]
    roots = roots[ix.is_object[roots]]
    (server,) = ix.member(roots, "server")
    packages, remotes = ix.member(ix.own[server[ix.of_kind(server, OBJ)]], "packages", "remotes")
    for relation, lists in (("packages", packages), ("remotes", remotes)):
        lists = lists[ix.of_kind(lists, ARR)]
        nodes, _ = rows.listed(relation, lists, np.full(len(lists), -1))
        nodes = nodes[ix.kind[nodes] == OBJ]
        place = ix.pos[nodes]
        if relation == "remotes":
            (headers,) = ix.member(ix.own[nodes], "headers")
            rows.named("headers", headers, place, choices=False)
            continue
        runtime, package, env = ix.member(ix.own[nodes], "runtimeArguments", "packageArguments", "environmentVariables")
        for name, lists_ in (("runtime_args", runtime), ("package_args", package)):
            there = ix.of_kind(lists_, ARR)
            rows.arguments(name, lists_[there], place[there])
        rows.named("env", env, place, choices=True)


def _environment(rows: _Rows) -> None:
    """The texts are the environment itself: a map or a list at the root."""
    ix = rows.ix
    roots = ix.root[ix.root >= 0]
    # A root is no node; its members are read as those of a value at position -1.
    boxes, arrays = roots[ix.is_object[roots]], roots[~ix.is_object[roots]]
    inner, at = ix.below(boxes)
    rows.add("env", inner, np.full(len(inner), -1), ix.strings(ix.k0[inner], ix.k1[inner]))
    items, _ = rows.elements(arrays)
    items = items[ix.kind[items] == OBJ]
    name, options = ix.member(ix.own[items], "name", "choices")
    has = ix.of_kind(name, STR)
    has = has[ix.v1[name[has]] - ix.v0[name[has]] > 2]
    items, name, options = items[has], name[has], options[has]
    texts = ix.strings(ix.v0[name], ix.v1[name])
    rows.add("env", items, np.full(len(items), -1), texts)
    with_list = ix.of_kind(options, ARR)
    opts, of = rows.elements(ix.own[options[with_list]])
    keys = pc.binary_join_element_wise(texts.take(pa.array(with_list[of])), pa.array(ix.pos[opts]).cast(pa.string()), "/")
    rows.add("choices", opts, np.full(len(opts), -1), keys)


def _package(rows: _Rows) -> None:
    """The texts are a package each; its environment is read where it is kept by itself."""
    ix = rows.ix
    boxes = rows.roots("packages")
    for relation, lists in zip(("runtime_args", "package_args"), ix.member(boxes, "runtimeArguments", "packageArguments"), strict=True):
        lists = lists[ix.of_kind(lists, ARR)]
        rows.arguments(relation, lists, np.full(len(lists), -1))


def _remote(rows: _Rows) -> None:
    """The texts are a remote each."""
    boxes = rows.roots("remotes")
    (headers,) = rows.ix.member(boxes, "headers")
    rows.named("headers", headers, np.full(len(headers), -1), choices=False)


_WALKS = {"registry_entries": _registry, "versions": _environment, "package": _package, "remote": _remote}


def _decoded(texts: pa.Array) -> pa.Array:
    """Texts that are a JSON string holding JSON are decoded; those that can't be become ''."""
    twice = np.flatnonzero(pc.starts_with(pc.utf8_ltrim_whitespace(texts), '"').to_numpy(zero_copy_only=False))
    if not len(twice):
        return texts
    out = texts.to_pylist()
    for i in twice:
        for _ in range(2):
            if out[i].lstrip()[:1] == '"':
                try:
                    out[i] = json.loads(out[i], strict=False).encode("utf-8", "replace").decode()
                except ValueError:
                    out[i] = ""
    return pa.array(out, pa.large_string())


def flatten_batch(origin: str, ids: pa.Array, texts: pa.Array, walk: str | None = None) -> Iterator[pa.RecordBatch]:
    """Linked rows of one batch of texts (see ``flatten``)."""
    keep = pc.and_(pc.is_valid(texts), pc.is_valid(ids))
    ids, texts = ids.filter(keep), texts.filter(keep).cast(pa.large_string())
    start = 0
    while start < len(texts):
        size = np.cumsum(pc.binary_length(texts[start:]).to_numpy())
        stop = start + max(1, int(np.searchsorted(size, CHUNK_BYTES, "right")))
        part = _decoded(texts[start:stop])
        part = part if part.offset == 0 else pa.concat_arrays([part])
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
        ix = Index(buf, off - off[0])
        rows = _Rows(ix, origin, ids[start:stop])
        if np.any(ix.root >= 0):
            _WALKS[walk or origin](rows)
        yield from rows.parts
        start = stop


def flatten(df: DataFrame, origin: str, record_id: str, text: str, walk: str | None = None) -> DataFrame:
    """Linked flat rows (origin, record_id, relation, parent_pos, item_key, value).

    ``origin`` is ``registry_entries`` (a registry page's elements) or ``versions`` (an
    environment); ``walk`` ``package`` or ``remote`` reads texts that are one package or remote
    each, without the environment. Such a row is in no list: its parent_pos and its item_key
    are -1, and so is its children's parent_pos. relation is packages, remotes, runtime_args, package_args, env, choices or
    headers; (relation's parent, parent_pos) points to the parent row, value is the row's
    JSON text. Null elements count in positions but give no row. Null, empty, cut-off and
    otherwise broken texts and null ids give nothing; texts encoded twice are decoded.
    A name listed twice gives two rows here. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(origin, b.column(0), b.column(1), walk)

    return python_input(df.select(F.col(f"`{record_id}`").cast("long").alias("record_id"),
        F.col(f"`{text}`").alias("text"))).mapInArrow(run, SCHEMA)


def relation_table(flat: DataFrame, relation: str) -> DataFrame:
    """One relation with its usual members as columns; absent members are null."""
    members = {
        "packages": ("registryType", "identifier", "version", "fileSha256"),
        "remotes": ("url", "type"),
        "runtime_args": ("type", "name", "value"),
        "package_args": ("type", "name", "value"),
        "env": ("description", "isRequired", "value"),
        "choices": ("label", "value"),
        "headers": ("value", "isRequired"),
    }[relation]
    v = F.try_parse_json("value")
    cols = [F.try_variant_get(v, f"$.{m}", "string").alias(f"{m}_" if m == "value" else m) for m in members]
    plain = F.when(~F.col("value").startswith("{"), F.try_variant_get(v, "$", "string")).alias("scalar")
    return flat.where(F.col("relation") == relation).select("origin", "record_id", "parent_pos", "item_key", *cols, plain)
