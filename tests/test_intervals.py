import random
from datetime import datetime, timedelta

import pytest

from graphmill.operators.intervals import interval_gaps, merge_intervals

SCHEMA = "subject string, tr_start timestamp_ntz, tr_end timestamp_ntz, _k string, _bounds int"
EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def brute(rows):
    """Periods and gaps by subject, by sorting."""
    by = {}
    for s, a, b, *_ in rows:
        if s is not None and a is not None and (b is None or b > a):
            by.setdefault(s, []).append((us(a), float("inf") if b is None else us(b)))
    periods, gaps = set(), set()
    for s, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        periods |= {(s, a, None if b == float("inf") else b) for a, b in merged}
        gaps |= {(s, x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return periods, gaps


def made(seed, n):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None])
        a = None if rnd.random() < 0.1 else EPOCH + timedelta(microseconds=rnd.randrange(-3000, 60_000) // rnd.choice([1, 50]) * 17)
        b = None if rnd.random() < 0.004 else (a or EPOCH) + timedelta(microseconds=rnd.choice([0, -5, 17, 60, 2_000, 400_000 * (rnd.random() < 0.02)]))
        rows += [(s, a, b, "x", 1)] * rnd.choice([1, 1, 2])
    return rows


@pytest.mark.parametrize("shard", [10_000, 40, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, shard):
    rows = made(seed, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    periods, gaps = brute(rows)
    got = [tuple(r) for r in merge_intervals(df, rows_per_shard=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == periods
    got = [tuple(r) for r in interval_gaps(df, rows_per_shard=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == gaps


def test_two_thousand_shards_and_bounds_by_salt(spark, monkeypatch):
    """A subject of 2,000 shards beside one of a few; the same rows when bounds are too large to broadcast."""
    from graphmill.plans import shards

    rnd = random.Random(5)
    rows = [("hot", EPOCH + timedelta(seconds=rnd.randrange(40_000)), None, "", 0) for _ in range(6_000)]
    rows = [(s, a, a + timedelta(seconds=rnd.choice([1, 2, 3, 900 * (rnd.random() < 0.01)])), x, y) for s, a, _, x, y in rows]
    rows += [("warm", a, b, x, y) for _, a, b, x, y in rows[:30]] + [("cold", *rows[0][1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    periods, gaps = brute(rows)
    bounds = shards.shard_bounds(df.selectExpr("subject AS _k", "unix_micros(cast(tr_start AS timestamp)) AS _lo"), ["_k"], "_lo", 3)
    assert {r["_k"]: len(r["_bounds"]) for r in bounds.collect()} == {"hot": 1999, "warm": 9}
    assert {tuple(r) for r in interval_gaps(df, rows_per_shard=3).collect()} == gaps
    monkeypatch.setattr(shards, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in merge_intervals(df, rows_per_shard=3).collect()} == periods
    assert {tuple(r) for r in interval_gaps(df, rows_per_shard=3).collect()} == gaps


def test_same_start_and_spanning_rows(spark):
    t = lambda h: EPOCH + timedelta(hours=h)
    rows = [("s", t(0), t(1), "", 0)] * 50 + [("s", t(0), t(500), "", 0)] * 3 + [("s", t(h), t(h) + timedelta(minutes=30), "", 0) for h in range(480, 620, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    periods, gaps = brute(rows)
    assert {tuple(r) for r in merge_intervals(df, rows_per_shard=10).collect()} == periods
    assert {tuple(r) for r in interval_gaps(df, rows_per_shard=10).collect()} == gaps


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merge_intervals(empty).count() == 0 and interval_gaps(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert merge_intervals(nulls).count() == 0 and interval_gaps(nulls).count() == 0


def test_time_zone_has_no_effect(spark):
    df = spark.createDataFrame([("s", datetime(2024, 3, 10, 2, 30, 0, 5), datetime(2024, 3, 10, 2, 40))], "subject string, tr_start timestamp_ntz, tr_end timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert merge_intervals(df).first()["period_start_us"] == us(datetime(2024, 3, 10, 2, 30, 0, 5))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
