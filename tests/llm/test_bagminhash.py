import json
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from graphmill.llm import bagminhash as b
from graphmill.llm.queries import p2_near_duplicates
from graphmill.llm.words import mix64, words

NAMES = "name string, content string, class string, id long, key double"


def texts(seed=3, base=40, copies=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = {}
    for i in range(base):
        own = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 60, 200]))]
        for c in range(copies):
            edited = list(own)
            for _ in range(int(len(own) * rnd.choice([0, 0.03, 0.1, 0.2, 0.4]))):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            if c == 2:
                rnd.shuffle(edited)
            out[f"n{i}.{c}"] = " ".join(edited)
    return out


def brute(bags, threshold):
    names, found = sorted(bags), set()
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            both = sum((bags[x] & bags[y]).values())
            if both >= threshold * (sum(bags[x].values()) + sum(bags[y].values()) - both) - 1e-9:
                found.add((x, y))
    return found


@pytest.mark.parametrize("weights,threshold", [("bag", 0.8), ("set", 0.6)])
def test_pairs_match_brute_force(spark, weights, threshold):
    data = texts()
    rows = [(n, json.dumps({"data": t}), "x", 1, 2.0) for n, t in data.items()]
    rows += rows[:5] + [("null", None, None, None, None), ("cut", '{"data": "a b c', "", 0, 0.0), ("empty", '{"data": ""}', "", 0, 0.0), (None, '{"data": "a b"}', "", 0, 0.0), ("number", '{"data": 5}', "", 0, 0.0)]
    rows += [("twin.a", json.dumps({"data": "alpha beta gamma"}), "", 0, 0.0), ("twin.b", json.dumps({"data": "Beta, alpha! gamma"}), "", 0, 0.0)]
    members, links = b.near_duplicates(spark.createDataFrame(rows, NAMES), "name", [], weights, threshold, json_data="content")
    got = {tuple(r) for r in b.expand(members, links).collect()}
    bags = {n: Counter(words(t)) for n, t in data.items()} | {"twin.a": Counter(["alpha", "beta", "gamma"]), "twin.b": Counter(["alpha", "beta", "gamma"])}
    if weights == "set":
        bags = {n: Counter(set(c)) for n, c in bags.items()}
    true = brute(bags, threshold)
    assert got <= true and len(got) >= 0.98 * len(true) and ("twin.a", "twin.b") in got


def test_tiles_change_nothing(spark):
    data = texts(5, 20, 5)
    df = spark.createDataFrame([(n, t) for n, t in data.items()], "name string, text string")
    sets = b.materialise(b.weighted_sets(df, "name", ["text"], "set"), "sets")
    whole = {tuple(r) for r in b.similar_classes(sets, 0.5).select("a", "b").collect()}
    class_of = {r["class"] for r in sets.collect()}
    old = b._hot_buckets
    try:
        b._hot_buckets = lambda sets, rarity, threshold, tile: b._signed(sets, rarity, threshold).selectExpr("explode(bands) AS key").distinct().selectExpr("key", "3 AS tiles")
        tiled = {tuple(r) for r in b.similar_classes(sets, 0.5, tile=2).select("a", "b").collect()}
    finally:
        b._hot_buckets = old
    assert tiled == whole and whole and len(class_of) > 50


def test_bands_are_deeper_for_frequent_words():
    rng = np.random.default_rng(4)
    e = [np.sort(rng.choice(2**32, 40, replace=False).astype(np.uint32)) for _ in range(50)]
    signature, won = b._signatures([(x, np.ones(40, np.uint32)) for x in e], b.REGISTERS, b.BAND_REGISTERS)
    known = b.Rarity(1_000_000, np.unique(np.concatenate(e[:25])), np.full(1000, 900_000))
    keys = b.band_keys(signature, known.bits_of(won), known.texts, 0.6)
    sizes = [len(k) for k in keys]
    # Frequent words: as many bands of full depth as there are; rare ones: two registers each, 0.36 ** bands.
    assert set(sizes[:25]) == {b.BANDS} and max(sizes[25:]) <= 20 and 0.64 ** min(sizes[25:]) <= b.MISS < 0.64 ** (min(sizes[25:]) - 1)
    again = b.band_keys(signature[3:5], known.bits_of(won[3:5]), known.texts, 0.6)
    assert all((x == y).all() for x, y in zip(again, keys[3:5]))


def test_bands_that_no_text_needs_are_not_made(monkeypatch):
    rng = np.random.default_rng(5)
    e = [np.sort(rng.choice(2**32, 60, replace=False).astype(np.uint32)) for _ in range(200)]
    signature, won = b._signatures([(x, np.ones(60, np.uint32)) for x in e], b.REGISTERS, b.BAND_REGISTERS)
    known = b.Rarity(150_000, np.empty(0, np.uint32), np.empty(0, np.int64))
    mixed = []
    monkeypatch.setattr(b, "mix64", lambda x: mixed.append(x.size) or mix64(x))
    keys = b.band_keys(signature, known.bits_of(won), known.texts, 0.6)
    assert max(map(len, keys)) < 32 and sum(mixed) < 200 * 32 * 3  # two registers a band; all 128 bands take 128 * 8


def test_signatures_are_made_in_little_memory():
    """The least arrival of each register and the word it belongs to, with no table of texts times words times registers."""
    rng = np.random.default_rng(8)
    vocabulary = rng.choice(2**32, 3000, replace=False).astype(np.uint32)
    e = [np.sort(rng.choice(vocabulary, k, replace=False)) for k in [80] * 1500 + [1, 2, 3000]]
    sets = [(x, np.ones(len(x), np.uint32)) for x in e]
    tracemalloc.start()
    try:
        signature, won = b._signatures(sets, b.REGISTERS, b.BAND_REGISTERS)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16e6  # 3 MB of arrivals, 3 MB of results, a block of each step
    known = b.Rarity(1500, np.sort(vocabulary), np.arange(1, 3001))
    again, rarity = b._signatures(sets, b.REGISTERS, b.BAND_REGISTERS, known)
    assert np.array_equal(signature, again) and np.array_equal(rarity, known.bits_of(won))
    for at in (0, 700, -3, -2, -1):
        times = b.arrivals(e[at], np.ones(len(e[at]), np.int64))
        assert np.array_equal(signature[at], times.min(0)) and np.array_equal(won[at], e[at][times.argmin(0)[: b.BAND_REGISTERS]])


def test_compared_pairs_do_not_grow_with_the_table():
    """Texts that share only frequent words: partners of a text in its buckets, at two sizes."""
    rng = np.random.default_rng(6)
    vocabulary = rng.choice(2**32, 4000, replace=False).astype(np.uint32)
    share = 1 / (1 + np.arange(4000) / 8)
    share /= share.sum()
    per_row = []
    for n in (1000, 4000):
        e = [np.unique(rng.choice(vocabulary, 60, p=share)) for _ in range(n)]
        words, counts = np.unique(np.concatenate(e), return_counts=True)
        signature, won = b._signatures([(x, np.ones(len(x), np.uint32)) for x in e], b.REGISTERS, b.BAND_REGISTERS)
        _, sizes = np.unique(np.concatenate(b.band_keys(signature, b.Rarity(n, words, counts).bits_of(won), n, 0.6)), return_counts=True)
        per_row.append((sizes * (sizes - 1) // 2).sum() / n)
    assert per_row[1] < 2.2 * per_row[0]  # fixed bands compare four times as many


def test_large_classes_meet_in_parts(spark):
    names = [f"n{i:02d}" for i in range(30)]
    members = spark.createDataFrame([(n, 1 if i < 20 else 2, 5) for i, n in enumerate(names)] + [("n29", 1, 5), ("x", 3, 5)], "id string, class long, n long")
    got = [tuple(r) for r in b.expand(members, spark.createDataFrame([(1, 2, 0.9)], "a long, b long, similarity double"), part=4).collect()]
    assert sorted(got) == [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    copies = [tuple(r) for r in b.expand(members, spark.createDataFrame([], "a long, b long, similarity double"), part=4).collect()]
    one, two = names[:20] + ["n29"], names[20:]
    assert sorted(copies) == sorted({(x, y) for g in (one, two) for i, x in enumerate(g) for y in g[i + 1 :]})


def test_empty_table(spark):
    members, links = b.near_duplicates(spark.createDataFrame([], NAMES), "name", ["name"], json_data="content")
    assert members.count() == 0 and b.expand(members, links).count() == 0


def test_long_text_and_min_elements(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " y"), ("c", "one two")], "name string, text string")
    members, links = b.near_duplicates(df, "name", ["text"], min_elements=3)
    assert [tuple(r) for r in b.expand(members, links).collect()] == [("a", "b")]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(30):
        e = rng.integers(0, 2**32, 50, dtype=np.uint64).astype(np.uint32)
        x, y = rng.integers(0, 12, 50), rng.integers(0, 12, 50)
        s = b.signatures([(e[x > 0], x[x > 0].astype(np.uint32)), (e[y > 0], y[y > 0].astype(np.uint32))], 512)
        off.append((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04


def test_weights_are_prefixes():
    """A larger weight never arrives later, and equal weights arrive together."""
    e = np.full(40, 7, np.uint32)
    t = b.arrivals(e, np.arange(1, 41), 64)
    assert (np.diff(t, axis=0) <= 0).all()
    assert np.array_equal(t[4], b.arrivals(np.array([7], np.uint32), np.array([5]), 64)[0])


def test_every_name_has_a_row_however_few_its_words(spark, tmp_path):
    rows = [("a", "ok"), ("b", "OK!"), ("c", "n/a"), ("d", "one two three four"), ("e", ""), ("e", "")]
    rows = [(n, json.dumps({"data": t}), "", 0, 0.0) for n, t in rows] + [("f", None, "", 0, 0.0)]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/knowledge.parquet")
    got = sorted((r["name"], r["class"], r["links"]) for r in p2_near_duplicates(spark, str(tmp_path)).collect())
    by = {n: c for n, c, _ in got}
    assert [n for n, *_ in got] == list("abcdef") and {x for *_, x in got} == {0}
    assert by["a"] == by["b"] and len({by["a"], by["c"], by["d"]} - {None}) == 3 and by["e"] is by["f"] is None
