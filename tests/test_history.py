import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heddle.operators.history import segmented, version_history

SCHEMA = "id long, who long, at timestamp, v int, e string, t string"


def brute(rows):
    seen = {}
    for i, who, at, v, *_ in rows:
        if None in (who, at, v):
            continue
        cur = seen.setdefault(who, {})
        if at not in cur or cur[at][0] < i:
            cur[at] = (i, v)
    out = set()
    for who, cur in seen.items():
        starts = []
        for at in sorted(cur):
            if not starts or starts[-1][1] != cur[at][1]:
                starts.append((at, cur[at][1]))
        for k, (at, v) in enumerate(starts):
            out.add((who, at, starts[k + 1][0] if k + 1 < len(starts) else None, v))
    return out


def micros(d):
    return None if d is None else int((d - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def made(n, seed=1):
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        who = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        r = (i, who, day + timedelta(hours=rng.randint(0, 60)), rng.choice([None, 1, 1, 2, 3]), "x", "y")
        rows += [r] * rng.choice([1, 1, 2])
    rows += [(n, None, day, 1, "", ""), (n + 1, 1, None, 1, "", ""), (n + 2, 99, day, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1, 5, 40, 10_000])
def test_equals_brute_force_however_hot_groups_are_cut(spark, segment):
    rows = made(250)
    df = spark.createDataFrame(rows, SCHEMA)
    got = version_history(df, "who", "at", F.col("v"), "id", segment_rows=segment).collect()
    want = {(w, micros(a), micros(b), v) for w, a, b, v in brute(rows)}
    assert len(got) == len(want) and {tuple(r)[:4] for r in got} == want


def test_empty_and_constant(spark):
    assert version_history(spark.createDataFrame([], SCHEMA), "who", "at", F.col("v"), "id").count() == 0
    day = datetime(2024, 1, 1)
    rows = [(i, 1, day + timedelta(days=i), 5, "", "") for i in range(30)]
    for segment in (3, 100):
        assert [tuple(r)[:4] for r in version_history(spark.createDataFrame(rows, SCHEMA), "who", "at", F.col("v"), "id", segment_rows=segment).collect()] == [(1, micros(day), None, 5)]


def test_returning_value_starts_a_period(spark):
    day = datetime(2024, 1, 1)
    rows = [(i, 1, day + timedelta(days=i), v, "", "") for i, v in enumerate([1, 2, 1])]
    assert version_history(spark.createDataFrame(rows, SCHEMA), "who", "at", F.col("v"), "id").count() == 3


@pytest.mark.parametrize("segment", [2, 30, 10_000])
def test_ledger_of_all_rows_in_order(spark, segment):
    rows = [r for r in made(150, 3) if None not in r[:4]]
    out = version_history(spark.createDataFrame(rows, SCHEMA), "who", "at", F.col("v"), "id", segment_rows=segment, per_instant=False)
    want, last = set(), {}
    for i, who, at, v, *_ in sorted(set(rows), key=lambda r: (r[1], r[2], r[0])):
        if last.get(who) != v:
            want.add((who, micros(at), i, v))
        last[who] = v
    assert {(r["entity_id"], r["valid_from_us"], r["order_key"], r["value"]) for r in out.collect()} == want


def test_bursts_are_cut_like_anything_else(spark):
    """Most of an entity's rows in one hour, one row long before: no array holds more than a segment."""
    start = datetime(2024, 5, 1)
    rows = [(i, 1, start + timedelta(milliseconds=180 * i), i // 3, "", "") for i in range(20_000)] + [(99_999, 1, datetime(1990, 1, 1), 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = df.select(F.col("who").alias("e"), F.unix_micros(F.col("at")).alias("t"))
    sizes = [r["count"] for r in segmented(plain, ["e", "t"], 1000).groupBy("e", "seg").count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 20_001
    got = version_history(df, "who", "at", F.col("v"), "id", segment_rows=1000)
    assert {tuple(r)[:4] for r in got.collect()} == {(w, micros(a), micros(b), v) for w, a, b, v in brute(rows)}


def test_text_keys_and_shuffled_hot_keys(spark, monkeypatch):
    from heddle.operators import history

    rows = made(250, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.concat(F.lit("é"), F.col("who").cast("string")))
    want = {(f"é{w}", micros(a), micros(b), v) for w, a, b, v in brute(rows)}
    for named, limit in ((1000, 0), (0, history.BROADCAST_BYTES), (0, 0)):
        monkeypatch.setattr(history, "NAMED", named)
        monkeypatch.setattr(history, "BROADCAST_BYTES", limit)
        assert {tuple(r)[:4] for r in version_history(df, "who", "at", F.col("v"), "id", segment_rows=20).collect()} == want
