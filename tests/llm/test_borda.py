import random

from pyspark.sql import functions as F

from graphmill.llm.borda import borda, first_of, positions


def brute(scores):
    """scores: list of {group: {item: value or None}}."""
    out = {}
    for g in set().union(*scores):
        items = set().union(*[s.get(g, {}) for s in scores])
        for item in items:
            total = 0.0
            for s in scores:
                values = sorted(v for v in s.get(g, {}).values() if v is not None)
                v = s.get(g, {}).get(item)
                rank = (len(values) + 1 + len(items)) / 2 if v is None else sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
                total += len(items) - rank
            out[g, item] = total
    return out


def run(spark, rows_per_shard):
    rnd = random.Random(4)
    tables, scores = [], []
    for n in (400, 300):
        rows, best = [], {}
        for _ in range(n):
            g, item = rnd.choice(["hot", "hot", "q1", "q2", None]), rnd.choice([f"k{i}" for i in range(90)] + [None])
            v = rnd.choice([None, float("nan"), rnd.randrange(12) / 4, rnd.random() * 1e6])
            rows.append((g, item, v, "x"))
            if g and item:
                old = best.setdefault(g, {}).get(item)
                v = None if v is None or v != v else v
                best[g][item] = old if v is None else v if old is None else min(v, old)
        tables.append(spark.createDataFrame(rows, "question_id string, key string, value double, points string"))
        scores.append(best)
    args = [(t, F.col("question_id"), F.col("key"), F.col("value")) for t in tables]
    return borda(args, rows_per_shard=rows_per_shard), brute(scores)


def test_matches_brute_force_in_one_and_in_many_shards(spark):
    for shard in (25_000, 7):
        got, true = run(spark, shard)
        assert {(r["group"], r["item"]): r["points"] for r in got.collect()} == true


def test_hot_groups_and_scores_are_split(spark, monkeypatch):
    """With nothing broadcast but what is hot the rows are the same; a large group is numbered over many partitions."""
    from graphmill.plans import shards

    monkeypatch.setattr(shards, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shards, "HOT_ROWS", 5)
    got, true = run(spark, 7)
    ranked = positions(got).collect()
    assert {(r["group"], r["item"]): r["points"] for r in ranked} == true
    for g in ("hot", "q1", "q2"):
        own = sorted((r for r in ranked if r["group"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert [r["item"] for r in own] == [i for _, i in sorted((-p, i) for (h, i), p in true.items() if h == g)]


def test_one_group_of_a_million(spark):
    rows = spark.range(1_000_000).select(F.lit("q").alias("g"), F.col("id").cast("string").alias("k"), (F.col("id") % 1000).alias("v"))
    ranking = borda([(rows, F.col("g"), F.col("k"), F.col("v")), (rows.where("v < 10"), F.col("g"), F.col("k"), F.lit(1))])
    places = positions(ranking)
    assert places.rdd.getNumPartitions() > 1
    r = places.agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.min_by("item", "place"), F.max_by("item", "place")).first()
    assert tuple(r) == (1_000_000, 1, 1_000_000, "0", "999999")


def test_first_ties_and_places(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0), ("q", "c", 2.0)], "g string, k string, v double")
    ranking = borda([(df, F.col("g"), F.col("k"), F.col("v"))])
    assert [tuple(r)[:2] for r in first_of(ranking).collect()] == [("q", "a")]
    assert [r["item"] for r in positions(ranking).orderBy("place").collect()] == ["a", "b", "c"]


def test_scale_has_no_effect_and_empty(spark):
    df = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0)], "g string, k string, v double")
    other = df.select("g", F.when(F.col("k") == "a", "b").otherwise("a").alias("k"), (F.col("v") * 1e9).alias("v"))
    points = [r["points"] for r in borda([(t, F.col("g"), F.col("k"), F.col("v")) for t in (df, other)]).collect()]
    assert points == [1.0, 1.0]
    empty = df.limit(0)
    assert borda([(t, F.col("g"), F.col("k"), F.col("v")) for t in (empty, empty)]).count() == 0
    assert borda([(t, F.col("g"), F.col("k"), F.col("v")) for t in (df, empty)], [2.0, 1.0]).count() == 2
