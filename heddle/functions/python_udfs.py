"""The few parsers without a native expression, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_words(lines: pd.Series) -> pd.Series:
    """Words of a shell line; null stays null, an unbalanced quote gives the plain words."""

    def split(line):
        if line is None:
            return None
        try:
            return shlex.split(line)
        except ValueError:
            return line.split()

    return lines.map(split)


def edit_steps(a: str, b: str) -> list[tuple[str, str, str]]:
    """Fewest edits from a to b as (same|swap|drop|add, of a, of b), runs joined.

    As many characters are swapped, dropped and added as the edit distance says. Where several
    scripts are as short, swaps come first, then drops. What both begin with is the same in any
    of them and left out of the table of distances.
    """
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    start, a, b = a[:p], a[p:], b[p:]
    n, m = len(a), len(b)
    away = [[n - i + m - j if i == n or j == m else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            away[i][j] = away[i + 1][j + 1] if a[i] == b[j] else 1 + min(away[i + 1][j + 1], away[i + 1][j], away[i][j + 1])
    out: list[tuple[str, str, str]] = [("same", start, start)] if start else []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            op, di, dj = "same", 1, 1
        elif i < n and j < m and away[i][j] == 1 + away[i + 1][j + 1]:
            op, di, dj = "swap", 1, 1
        elif i < n and away[i][j] == 1 + away[i + 1][j]:
            op, di, dj = "drop", 1, 0
        else:
            op, di, dj = "add", 0, 1
        step = (op, a[i : i + di], b[j : j + dj])
        if out and out[-1][0] == op:
            step = (op, out[-1][1] + step[1], out[-1][2] + step[2])
            out.pop()
        out.append(step)
        i, j = i + di, j + dj
    return out


_STEP = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "before", "after")])


@F.pandas_udf(T.ArrayType(_STEP))
def edit_script(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit steps between two short names; null if either is."""
    pairs = zip(a, b, strict=True)
    return pd.Series([None if x is None or y is None else [{"op": o, "before": s, "after": t} for o, s, t in edit_steps(x, y)] for x,
        y in pairs])
