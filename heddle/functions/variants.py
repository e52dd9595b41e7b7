"""Hashes of names with characters deleted, in numpy: no variant is ever built as a string."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Hashes made at once of names of one length.
SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)]), dtype=np.uint64)


def _places(length: int, r: int) -> np.ndarray:
    """All choices of r ascending places, a row each."""
    at = np.zeros((1, 0), np.int64)
    for _ in range(r):
        first = at[:, -1] + 1 if at.shape[1] else np.zeros(1, np.int64)
        n = length - first
        at = np.repeat(at, n, axis=0)
        at = np.column_stack([at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first, n)])
    return at


def _of_one_length(codes: np.ndarray, deletions: int) -> np.ndarray:
    """A row of hashes for each row of characters: itself and its variants.

    A variant's hash is a sum over its characters, each times a power for its place, so it is
    put together from prefix sums: what lies behind r deletions moves down r places.
    """
    n, length = codes.shape
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64) + _BASE) * _powers(_BASE, length)[:length], axis=1, dtype=np.uint64, out=sums[:, 1:])
    down, out = _powers(_INVERSE, deletions), [sums[:, -1:]]
    for r in range(1, min(deletions, length) + 1):
        at = _places(length, r)
        total = sums[:, at[:, 0]]
        for t in range(r):
            end = sums[:, at[:, t + 1]] if t + 1 < r else sums[:, -1:]
            total = total + (end - sums[:, at[:, t] + 1]) * down[t + 1]
        out.append(total)
    return _mixed(np.concatenate(out, axis=1))


def with_depths(names: pa.Array, deletions: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of some names, a row of hashes for each, characters deleted for each column);
    a name's variants that are equal have their hash several times."""
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        ways = [comb(int(length), r) for r in range(deletions + 1)]
        step = max(1, SLICE // sum(ways))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            text = "".join(names.take(pa.array(some)).to_pylist())
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), length)
            yield some, _of_one_length(codes, deletions), np.repeat(np.arange(deletions + 1, dtype=np.int8), ways)


def variants(names: pa.Array, deletions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the name, hash) of each name and its variants with up to so many characters
    deleted, every hash once a name."""
    for some, hashes, _ in with_depths(names, deletions):
        hashes = np.sort(hashes, axis=1)
        new = np.ones(hashes.shape, bool)
        np.not_equal(hashes[:, 1:], hashes[:, :-1], out=new[:, 1:])
        yield np.repeat(some, new.sum(axis=1)), hashes[new]


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, seven bits a byte."""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    size = 1 + sum((gaps >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[(ends - size)[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    bits = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(bits, starts), dtype=np.uint64)


def repeated(ascending: np.ndarray) -> np.ndarray:
    """Which of ascending numbers stand there more than once."""
    same = ascending[1:] == ascending[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(ascending) else np.zeros(0, bool)
