import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators.snapshot_diff import canonical_json, row_digests, snapshot_changes

SCHEMA = "snapshot_no int, row_no long, name string, delisted_at long, raw_json string, s int, k string, node long"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    state = [F.col("delisted_at"), canonical_json(F.col("raw_json"))]
    return {tuple(r) for r in snapshot_changes(row_digests(df, "snapshot_no", "name", "row_no", state), **kw).collect()}


def brute(rows):
    held = {}
    for s, n, name, d, raw in rows:
        cur = held.setdefault(s, {})
        if name is not None and (name not in cur or cur[name][0] < n):
            try:
                value = None if raw is None else ("j", json.loads(raw))
            except ValueError:
                value = ("t", raw)
            cur[name] = (n, d, value)
    out, order = set(), sorted(held)
    for a, b in zip(order, order[1:], strict=False):
        for name in held[a].keys() | held[b].keys():
            x, y = held[a].get(name), held[b].get(name)
            if x is None or y is None:
                out.add((b, name, "added" if x is None else "removed"))
            elif x[1:] != y[1:]:
                out.add((b, name, "changed"))
    return out


@pytest.mark.parametrize("leaf", [1, 16, 10_000])
def test_equals_brute_force_at_any_tree_size(spark, leaf):
    rng = random.Random(3)
    rows = []
    for s in (1, 2, 4):
        for i in range(120):
            if rng.random() < 0.1:
                continue
            doc = {"a": rng.choice([1, 1, 1, 2]), "b": [1, {"c": "é"}], "z": None}
            raw = rng.choice([json.dumps(doc), json.dumps(dict(reversed(doc.items())), indent=1), json.dumps(doc, ensure_ascii=False, separators=(",", ":"))])
            rows.append((s, i, f"n{i}", rng.choice([None, None, None, 7]), rng.choice([raw, raw, raw, None, "{broken", ""])))
            if rng.random() < 0.1:
                rows.append((s, 1000 + i, f"n{i}", None, '{"late": 1}'))
    assert run(spark, rows, rows_per_leaf=leaf) == brute(rows)


def test_writing_makes_no_change_but_array_order_does(spark):
    rows = [(1, 1, "a", None, '{"x":1,"y":"\\u00e9"}'), (2, 1, "a", None, ' {"y" : "é", "x":1}'), (1, 2, "b", None, "[1,2]"), (2, 2, "b", None, "[2,1]"), (1, 3, None, None, "1"), (2, 4, "c", None, None), (1, 4, "c", None, "null")]
    assert run(spark, rows) == {(2, "b", "changed"), (2, "c", "changed")}


def test_empty_single_and_equal_snapshots(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 1, "a", None, None)]) == set()
    assert run(spark, [(s, i, f"n{i}", None, "{}") for s in (1, 2, 3) for i in range(50)]) == set()
