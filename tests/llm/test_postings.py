import os

import numpy as np
import pytest

from graphmill.llm import postings
from graphmill.llm.postings import CLOSE, CentroidGraph, balanced_centroids, brute_force, similar_vectors
from graphmill.llm.queries import p5_nearest, p5_nearest_all, p5_neighbours

DATA = "/root/testdata/sf0.1"

SCHEMA = "key string, embedding array<float>, direction string, list int"


def frame(spark, keys, x):
    return spark.createDataFrame([(k, None if v is None else [float(a) for a in v], "d", 1) for k, v in zip(keys, x)], SCHEMA)


def clustered(n=600, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    return (centres[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, d))) * rng.uniform(0.1, 9, (n, 1))


@pytest.fixture(scope="module")
def table():
    return clustered()


def test_recall_over_all_neighbours(spark, table):
    keys = [f"k{i:04d}" for i in range(len(table))]
    got = similar_vectors(frame(spark, keys, table), "key", "embedding", k=5, list_size=40)
    found = {(r["key"], r["neighbour"]) for r in got.collect()}
    true = {(keys[i], keys[j]) for i, row in enumerate(brute_force(table, np.arange(len(table)), 5)) for j in row}
    assert len(found & true) >= 0.9 * len(true) and len(found) <= 5 * len(table)


def test_close_pairs_are_all_found(spark):
    x = clustered(300)
    near = x[:100] * 3 + 0.02 * np.random.default_rng(5).normal(size=(100, 16))
    both = np.concatenate([x, near])
    keys = [f"k{i:04d}" for i in range(len(both))]
    got = similar_vectors(frame(spark, keys, both), "key", "embedding", k=5, min_cosine=0.98, list_size=30, **CLOSE)
    found = {tuple(sorted((r["key"], r["neighbour"]))) for r in got.collect()}
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    s = unit @ unit.T
    true = {(keys[i], keys[j]) for i in range(len(both)) for j in range(i + 1, len(both)) if s[i, j] >= 0.98 and ((s[i] > s[i, j]).sum() - 1 < 5 or (s[j] > s[i, j]).sum() - 1 < 5)}
    assert len(found & true) >= 0.99 * len(true) and len(found - true) <= 0.01 * len(true)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    asked = [i for i, r in enumerate(rows) if r["vec_id"] % 100 == 0]
    true = {(rows[i]["vec_id"], rows[j]["vec_id"]) for i, near in zip(asked, brute_force(x, np.array(asked), 10)) for j in near}
    found = {(r["vec_id"], r["neighbour_id"]) for r in p5_neighbours(spark, DATA).collect()}
    assert len(found & true) >= 0.9 * len(true) and len(found) == len(true)


def test_same_directions_ties_and_useless_rows(spark):
    rows = [("a", [1, 0]), ("b", [2, 0]), ("c", [3, 0]), ("d", [0.5, 0]), ("e", [0.98, 0.2]), ("zero", [0, 0]), ("null", None), (None, [1, 0]), ("nan", [float("nan"), 1]), ("a", [1, 0]), ("long", [1, 0, 0])]
    got = similar_vectors(frame(spark, *zip(*rows)), "key", "embedding", k=2, min_cosine=0.9)
    by = {}
    for r in got.orderBy("key", "rank").collect():
        by.setdefault(r["key"], []).append(r["neighbour"])
    assert by == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"], "e": ["a", "b"]}


def test_null_inside_empty_and_queries(spark, table):
    assert similar_vectors(spark.createDataFrame([], SCHEMA), "key", "embedding").count() == 0
    df = spark.createDataFrame([("a", [1.0, None]), ("b", []), ("c", [1.0, 1.0])], "key string, embedding array<float>")
    assert similar_vectors(df, "key", "embedding").count() == 0
    keys = [f"k{i:04d}" for i in range(len(table))]
    got = similar_vectors(frame(spark, keys, table), "key", "embedding", k=3, queries="key LIKE '%00'", list_size=50)
    assert {r["key"] for r in got.collect()} == {k for k in keys if k.endswith("00")}


def test_every_length_is_an_index_of_its_own(spark, table):
    long, short = [f"k{i:04d}" for i in range(300)], [f"s{i:04d}" for i in range(40)]
    both = similar_vectors(frame(spark, long + short, [*table[:300], *table[300:340, :7]]), "key", "embedding", k=3, list_size=30).collect()
    assert {r["key"] for r in both} == {*long, *short} and all(r["key"][0] == r["neighbour"][0] for r in both)
    true = {(short[i], short[j]) for i, near in enumerate(brute_force(table[300:340, :7], np.arange(40), 3)) for j in near}
    assert len({(r["key"], r["neighbour"]) for r in both} & true) >= 0.9 * len(true)


def test_overfull_lists_are_asked_in_parts(spark, table, monkeypatch):
    keys = [f"k{i:04d}" for i in range(300)]
    ask = lambda: {tuple(r) for r in similar_vectors(frame(spark, keys, table[:300]), "key", "embedding", k=4, list_size=60, queries="key < 'k0200'").collect()}
    whole = ask()
    monkeypatch.setattr(postings, "OVERFULL", 0.3)
    assert ask() == whole and len(whole) == 800


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = balanced_centroids(x, 5)
    graph = CentroidGraph.build(centroids)
    ids, sims = graph.search(x[:500], 3)
    assert (ids[:, 0] == (x[:500] @ centroids.T).argmax(1)).mean() > 0.9
    assert (np.diff(sims, axis=1) <= 0).all() and all(len(set(r)) == 3 for r in ids)
    assert len(centroids) >= 4000 / 5


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_many_lists_lose_no_centroid():
    """The search for lists must not depend on how many there are."""
    x, centroids = unit(400, 48, 4), unit(5000, 48, 5)
    ids, sims = CentroidGraph.build(centroids).search(x, 6)
    s = x @ centroids.T
    assert np.array_equal(np.sort(ids, axis=1), np.sort(np.argsort(-s, axis=1)[:, :6], axis=1)) and (np.diff(sims, axis=1) <= 0).all()


def test_beam_ends_when_all_are_expanded(monkeypatch):
    monkeypatch.setattr(postings, "EXACT_LISTS", 100)
    x, centroids = unit(300, 24, 6), unit(3000, 24, 7)
    graph = CentroidGraph.build(centroids)
    ids, _ = graph.search(x, 6)
    best = np.argsort(-(x @ centroids.T), axis=1)[:, :6]
    assert len(graph.entries) < 3000 and np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, best)]) > 0.97


def test_probes_grow_with_the_lists():
    assert postings.probes_for(32) == postings.PROBE < postings.probes_for(1244) < postings.probes_for(20_000)


def test_nearest_of_both_tables_at_any_distance(spark, tmp_path):
    x = unit(1500, 24, 8)
    keys = [f"k{i:04d}" for i in range(len(x))]
    frame(spark, keys[:600], x[:600]).selectExpr("key AS name", "embedding").write.parquet(f"{tmp_path}/knowledge.parquet")
    frame(spark, keys[600:], x[600:]).selectExpr("key AS triple", "embedding").write.parquet(f"{tmp_path}/statement.parquet")
    true = {(keys[i], keys[j]) for i, near in enumerate(brute_force(x, np.arange(len(x)), 5)) for j in near}
    found = {(r["key"], r["neighbour"]) for r in p5_nearest_all(spark, str(tmp_path)).collect()}
    some = {(r["key"], r["neighbour"]) for r in p5_nearest(spark, str(tmp_path)).collect()}
    assert len(found) == len(true) and len(found & true) >= 0.97 * len(true)
    assert some <= found and 5 <= len(some) < len(found) / 20
