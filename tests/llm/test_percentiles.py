import random

import pytest
from pyspark.sql import functions as F

from graphmill.llm import percentiles as p


def test_exact_and_mergeable(spark):
    rnd = random.Random(6)
    groups = {"a": [rnd.randrange(1 << 40) for _ in range(300)], "b": [5] * 50, "c": [-7, 0, 9], "d": [rnd.choice([1, 2, 1 << 62, -(1 << 62)]) for _ in range(101)]}
    rows = [(g, v, "x", 1) for g, vs in groups.items() for v in vs] + [("a", None, "", 0), (None, 3, "", 0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v long, lo string, rank int")
    parts = [p.value_counts(df.where(F.pmod(F.hash("v"), F.lit(2)) == i), F.col("g"), F.col("v")) for i in (0, 1)]
    parts.append(p.value_counts(df.where("v IS NULL"), F.col("g"), F.col("v")))
    counts = p.materialise(p.merge_counts(*parts), "counts")
    for levels in (3, 8):
        got = {(r["g"], r["q"]): r for r in p.bisect_percentiles(counts, [0, 50, 90, 100], levels=levels).collect()}
        assert len(got) == 16
        for (g, q), r in got.items():
            vs = sorted(groups[g])
            assert r["lo"] == r["hi"] == vs[min(len(vs) * q // 100, len(vs) - 1)] and r["n"] == len(vs)


def test_fractional_values(spark):
    rnd = random.Random(8)
    groups = {"tenths": [i / 10 for i in range(1, 10)], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300) for _ in range(200)], "few": [-0.0, 0.0, -1.5, float("inf"), float("-inf")]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("tenths", float("nan")), ("tenths", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = p.merge_counts(p.value_counts(df.where("g <> 'few'"), F.col("g"), F.col("v")), p.value_counts(df.where("g = 'few'"), F.col("g"), F.col("v")))
    got = {(r["g"], r["q"]): r for r in p.bisect_percentiles(counts, [0, 50, 90]).collect()}
    for (g, q), r in got.items():
        vs = sorted(groups[g])
        assert r["lo"] == r["hi"] == vs[len(vs) * q // 100] and r["n"] == len(vs)
    assert len(got) == 9
    near = p.bisect_percentiles(p.value_counts(df.where("g = 'tenths'"), F.col("g"), F.col("v")), [50], levels=3, tolerance=0.25).first()
    assert near["lo"] <= 0.5 <= near["hi"] <= near["lo"] + 0.25
    with pytest.raises(TypeError):
        p.value_counts(df.select("g", F.col("v").cast("decimal(20,4)").alias("v")), F.col("g"), F.col("v"))


def test_tolerance_bounds_the_error(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 977).alias("v"))
    counts = p.value_counts(df, F.col("g"), F.col("v"))
    r = p.bisect_percentiles(counts, [50], levels=4, tolerance=5000).first()
    assert r["lo"] <= 500 * 977 <= r["hi"] and r["hi"] - r["lo"] <= 5000


def test_salted_join_gives_the_same(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id")).alias("v"))
    counts = p.materialise(p.value_counts(df, F.col("g"), F.col("v")), "counts")
    small = {tuple(r) for r in p.bisect_percentiles(counts, [50, 99]).collect()}
    old, p.BROADCAST_ROWS = p.BROADCAST_ROWS, 0
    try:
        assert {tuple(r) for r in p.bisect_percentiles(counts, [50, 99]).collect()} == small
    finally:
        p.BROADCAST_ROWS = old


def test_latencies(spark):
    rows = [("r", f"q{i}", " Multi-Session_ABS\t", 10 + i, None) for i in range(30)] + [("r", "q0", " Multi-Session_ABS\t", 10, None)] * 3
    rows += [("r", "x1", "multi-session", 0, -4), ("r", None, "multi-session", 5, 5), (None, "q", "multi-session", 5, 5), ("r", "q9x", None, 5, 5)]
    df = spark.createDataFrame(rows, "run_id string, question_id string, question_type string, fts_latency_us long, vec_latency_us long")
    got = p.bisect_percentiles(p.latency_counts(df), [50, 90], min_rows=30).select("g.*", "q", "n", "lo").collect()
    assert {tuple(r) for r in got} == {("r", "multi-session", "fts", 50, 30, 25), ("r", "multi-session", "fts", 90, 30, 37)}
    assert p.bisect_percentiles(p.latency_counts(df.limit(0)), [50]).count() == 0
