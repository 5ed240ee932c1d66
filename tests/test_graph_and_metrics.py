import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphmill.operators import graph
from graphmill.operators import metrics as m
from graphmill.operators.graph import k_hop
from graphmill.plans.shards import running_totals


@pytest.mark.parametrize("depth,predicate,few", [(1, None, 1000), (3, None, 1000), (3, "p", 1000), (7, None, 1000), (7, None, 2), (5, "q", 0)])
def test_walk_matches_brute_force(spark, monkeypatch, depth, predicate, few):
    monkeypatch.setattr(graph, "FEW", few)  # frontiers of more nodes are joined
    monkeypatch.setattr(graph, "HELD", max(few, 3))
    rnd = random.Random(depth)
    edges = sorted({(f"n{rnd.randrange(14)}", rnd.choice("pq"), f"n{rnd.randrange(14)}") for _ in range(24)})
    df = spark.createDataFrame([(",".join(e), *e) for e in edges], "triple string, subject string, predicate string, object string")
    true, level, seen = {}, {"n0"}, set()
    for hop in range(1, depth + 1):
        seen |= level
        out = [e for e in edges if e[0] in level and predicate in (None, e[1])]
        for e in out:
            true.setdefault(",".join(e), hop)
        level = {e[2] for e in out} - seen
    assert {r["triple"]: r["hops"] for r in k_hop(df, "n0", predicate, depth).collect()} == true


@pytest.mark.parametrize("shard", [1000, 5])
def test_running_totals(spark, shard):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), v, rnd.randrange(5)) for v in rnd.sample(range(1000), 60)]
    true = {(g, v): sum(c for h, w, c in rows if h == g and w <= v) for g, v, _ in rows}
    df = spark.createDataFrame(rows, "g string, v long, c long")
    assert {(r["g"], r["v"]): r["_upto"] for r in running_totals(df, ["g"], "v", "c", shard).collect()} == true


def test_recall_and_gain(spark):
    rows = [(["a", "b", "b"], ["b"]), (["x"], []), (None, ["a"]), (["c", "d"], ["d", "e", "f"]), ([], None)]
    df = spark.createDataFrame(rows, "found array<string>, want array<string>")

    def gain(found, want, k):
        found, want = (found or [])[:k], want or []
        if not want:
            return 1.0
        weight = lambda i: 1.0 / (i + 1).bit_length()
        return sum(weight(i) for i, x in enumerate(found) if x in want) / sum(weight(i) for i in range(min(len(want), k)))

    for k in (1, 2, 5):
        got = df.select(m.recall_at(F.col("found"), F.col("want"), k).alias("r"), m.ndcg_at(F.col("found"), F.col("want"), k).alias("g")).collect()
        assert [r["r"] for r in got] == [not (w or []) or bool(set((f or [])[:k]) & set(w)) for f, w in rows]
        assert [round(r["g"], 9) for r in got] == [round(gain(f, w, k), 9) for f, w in rows]


def test_percentiles_and_summary(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.randrange(40)) for g in "ab" for _ in range(57)] + [("c", 4), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    for shard in (1000, 6):
        got = {r["g"]: r for r in m.nearest_index(df, ["g"], "v", [50, 99], shard).collect()}
        for g in "abc":
            vs = sorted(v for h, v in rows if h == g and v is not None)
            assert (got[g]["n"], got[g]["p50"], got[g]["p99"]) == (len(vs), vs[len(vs) // 2], vs[len(vs) * 99 // 100])
    assert m.latency_summary(df.where("g = 'c'"), ["g"], "v").collect()[0].asDict() == {"g": "c", "n": 1, "min": 4, "p50": 4, "p99": 4, "max": 4}


def test_f1(spark):
    df = spark.createDataFrame([("The cats were running fast!", "a running cat"), ("", "x"), ("same words", "same words"), (None, "abc")], "p string, g string")
    got = [round(r[0], 6) for r in df.select(m.token_f1(m.answer_tokens(F.col("p")), m.answer_tokens(F.col("g")))).collect()]
    assert got == [0.8, 0.0, 1.0, 0.0]


def test_types_sessions_samples(spark):
    df = spark.createDataFrame([("multi-session", "q__s__t"), ("multi-session_abs", "plain"), ("other", None)], "t string, k string")
    got = df.select(m.ability(F.col("t")), m.canonical_type(F.col("t")), m.session_of(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("multi_session_reasoning", "multi-session", "s"), ("abstention", "multi-session", None), ("unknown", "other", None)]
    once = m.sample_rows(spark.range(100), 7, "id").collect()
    assert len(once) == 7 and once == m.sample_rows(spark.range(100).repartition(5), 7, "id").collect()
    assert m.throughput(10, 2.0) == 5.0 and m.throughput(1, 0) == 0.0


def test_medians_of_odd_and_even_numbers(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([1.0, 2.5, 9.0, rnd.random()])) for g, n in (("a", 31), ("b", 40), ("c", 1)) for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for shard in (1000, 3):
        got = {r["g"]: r for r in m.score_summary(df, ["g"], "v", shard).collect()}
        for g in "abc":
            vs = [v for h, v in rows if h == g and v is not None]
            assert got[g]["median"] == pytest.approx(statistics.median(vs)) and got[g]["n"] == len(vs) and got[g]["mean"] == pytest.approx(statistics.mean(vs))
