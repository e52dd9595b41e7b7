import random
from datetime import datetime, timedelta

import pytest

from heddle.llm import topn

SCHEMA = "id long, server_id long, computed_at timestamp, score double, g string, s string, rank string"


def brute(rows, n):
    out, groups = set(), {}
    for i, g, at, s, *_ in rows:
        if g is not None and s is not None and s == s:
            groups.setdefault(g, set()).add((s, at or datetime.min, i))
    for g, v in groups.items():
        out |= {(g, x[2]) for x in sorted(v, reverse=True)[:n]}
    return out


def run(spark, rows, n):
    df = topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), "server_id", "score", ["computed_at", "id"], "id", n)
    got = [(r["server_id"], r["id"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("n", [1, 5, 40])
@pytest.mark.parametrize("scores", [(100.0,), (1.0, 2.0, 3.0), (0.001, 0.0011, -5.0, 1e9, float("inf"), -0.0, 0.0)])
def test_equals_brute_force_with_ties_and_repeats(spark, n, scores):
    rng, day = random.Random(n), datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        at = None if rng.random() < 0.05 else day + timedelta(minutes=rng.randint(0, 300))
        r = (i, rng.choice([1, 1, 1, 1, 2, 3, None]), at, rng.choice([*scores, None, float("nan")]), "x", "y", "z")
        rows += [r] * rng.choice([1, 1, 1, 3])
    assert run(spark, rows, n) == brute(rows, n)


def test_second_histogram_and_shuffled_thresholds_keep_the_result(spark, monkeypatch):
    day = datetime(2024, 1, 1)
    rows = [(i, i % 2, day + timedelta(seconds=i * 37 % 1000), 100.0, "", "", "") for i in range(2000)]
    assert run(spark, rows, 5) == brute(rows, 5)
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_rows_delivered_many_times_do_not_count_as_survivors(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, 1, day, 9.0, "", "", "")] * 100 + [(i, 1, day, 1.0, "", "", "") for i in range(2, 60)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_and_small(spark):
    assert run(spark, [], 5) == set()
    assert run(spark, [(1, 1, None, 1.0, "", "", "")], 5) == {(1, 1)}
