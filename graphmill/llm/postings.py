"""The most similar vectors of every vector, from balanced posting lists.

Vectors of the same direction form one class; a class is indexed once.  A bounded sample is split
again and again into a few clusters until each holds no more than its share of a list, which gives
centroids of balanced lists.  Every Python worker keeps them in memory and compares each vector
with all of them, which loses no list; only beyond ``EXACT_LISTS`` they are searched by beam through
a graph that links each to its nearest ones, until no centroid of the beam is left to expand.  A
vector is stored in its nearest list and, when it lies near a boundary, in further lists whose
centroids are at most ``store_ratio`` times as far as the nearest; it probes lists up to
``probe_ratio`` times as far.  Lists are then compared within themselves; those that the sample
shows to be far larger than others are asked in parts, each part against the whole list.  Vectors
of each length are an index of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import materialise

#: Vectors that the centroids are fitted on: so many, beyond 100 times that a hundredth, and at most so many and so many bytes.
#: Every vector is indexed.
SAMPLE, MOST_SAMPLED, SAMPLE_BYTES = 40_000, 200_000, 64 << 20
#: A list estimated to hold so many times its share is asked in parts.
OVERFULL = 8
#: Bytes of entries that a task of the comparison is to read.
TASK_BYTES = 12 << 20
LIST_SIZE = 400
#: Centroids are broadcast: at most so many, of so many numbers.
MAX_LISTS = 65_536
#: Lists a vector is stored in and probes, and how much farther than the nearest these may be.
STORE, PROBE = 3, 16
STORE_RATIO, PROBE_RATIO = 1.3, 2.0
#: Probes at any distance grow as this times the lists to this power, which held the recall in measurements.
PROBE_SHARE, PROBE_POWER = 0.46, 0.75
#: The same for neighbours of high cosine only, which share a list or lie in lists next to each other.
CLOSE = {"store": 4, "probe": 4, "store_ratio": 1.4, "probe_ratio": 1.4}
#: Up to so many lists a vector is compared with every centroid: there that is cheaper than a beam as well.
EXACT_LISTS = 32_768
LINKS, BEAM, EXPAND, ENTRIES = 24, 128, 32, 64
#: Similarities to centroids that are held at a time.
_CELLS = 1 << 22
#: Tables of repeated directions, and what is found for them, are broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_BLOCK = 2048


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, direction, vec``: unit vectors as float32 bytes, copies of a key in a batch once.

    Null keys and vectors, vectors with null, NaN or infinite numbers and all-zero ones are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, marks, packed = [], [], []
            lengths = frame["_vec"].map(len).to_numpy() if len(frame) else np.array([], int)
            for length in np.unique(lengths):
                part = frame[lengths == length]
                x = np.array(part["_vec"].tolist(), np.float64).reshape(len(part), int(length))
                norm = np.sqrt((x * x).sum(1)) if length else np.zeros(len(part))
                good = np.isfinite(norm) & (norm > 0)
                unit = (x[good] / norm[good, None]).astype(np.float32)
                keys += part["_key"].to_numpy()[good].tolist()
                rounded = np.round(unit.astype(np.float64), 6) + 0.0  # the same direction at another length
                marks += [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rounded]
                packed += [u.tobytes() for u in unit]
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "direction": np.array(marks, np.int64), "vec": pd.Series(packed, dtype=object)}).drop_duplicates(["key", "direction"])

    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(vector).cast("array<double>").alias("_vec"))
    rows = rows.where(F.col("_key").isNotNull() & F.col("_vec").isNotNull() & ~F.exists(F.coalesce("_vec", F.array()), lambda v: v.isNull()))
    return rows.mapInPandas(run, "key string, direction long, vec binary")


def balanced_centroids(sample: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Centroids of clusters of at most ``leaf`` sampled vectors each, by splitting over and over."""
    rng = np.random.default_rng(seed)
    todo, centroids = [np.arange(len(sample))], []
    while todo:
        members = todo.pop()
        x = sample[members]
        if len(members) <= leaf:
            centroids.append(x.mean(0))
            continue
        k = int(min(16, max(2, -(-len(members) // leaf))))
        centre = x[rng.choice(len(x), k, replace=False)]
        for _ in range(6):
            near = (x @ centre.T).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, x)
            size = np.bincount(near, minlength=k)
            sums[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))] if (size == 0).any() else 0
            centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        near = (x @ centre.T).argmax(1)
        parts = [members[near == c] for c in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # all the same
            centroids.append(x.mean(0))
        else:
            todo += parts
    c = np.array(centroids, np.float32)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


@dataclass
class CentroidGraph:
    """Centroids, the links between them and the entry points of a search."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    parts: np.ndarray | None = None

    @classmethod
    def build(cls, centroids: np.ndarray, links: int = LINKS, entries: int = ENTRIES) -> CentroidGraph:
        n = len(centroids)
        if n <= EXACT_LISTS:
            return cls(centroids, np.empty((n, 0), np.int32), np.arange(n, dtype=np.int32))
        near = np.empty((n, min(links, max(n - 1, 1))), np.int32)
        for a in range(0, n, 1024):
            s = centroids[a : a + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2 if n > 1 else 1
            near[a : a + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if n > 1 else 0
        # Every fourth centroid is an entry, so that a search begins close to its end.
        return cls(centroids, near, np.unique(np.linspace(0, n - 1, min(n, max(entries, n // 4))).astype(np.int32)))

    def search(self, x: np.ndarray, lists: int, beam: int = BEAM, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row of ``x``: numbers and similarities, best first."""
        exact = len(self.entries) == len(self.centroids)
        block = max(1, min(512, _CELLS // len(self.entries)))
        ids, sims = [], []
        for a in range(0, len(x), block):
            q = x[a : a + block]
            i, s = self._all(q, lists) if exact else self._beam(q, max(beam, 2 * lists), expand)
            ids.append(i[:, :lists])
            sims.append(s[:, :lists])
        return np.concatenate(ids), np.concatenate(sims)

    def _all(self, q: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
        s = q @ self.centroids.T
        n = s.shape[1]
        width = min(lists, n)
        ids = np.argpartition(s, n - width, axis=1)[:, n - width :].astype(np.int32)
        sims = np.take_along_axis(s, ids, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _beam(self, q: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.centroids)
        beam = min(beam, n)
        first = q @ self.centroids[self.entries].T
        width = min(beam, first.shape[1])
        at = np.argpartition(-first, width - 1, axis=1)[:, :width]
        ids, sims = self.entries[at], np.take_along_axis(first, at, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        seen = np.zeros(ids.shape, bool)
        while True:
            # The best of the beam that have not been expanded.
            pick = np.argsort(np.where(seen, 2.0, -sims), axis=1, kind="stable")[:, : min(expand, ids.shape[1])]
            if np.take_along_axis(seen, pick, 1).all():
                break
            source = np.take_along_axis(ids, pick, 1)
            np.put_along_axis(seen, pick, True, 1)
            new = self.links[source].reshape(len(q), -1)
            new_sims = np.matmul(self.centroids[new], q[:, :, None])[:, :, 0]
            ids = np.concatenate([ids, new], 1)
            sims = np.concatenate([sims, new_sims], 1)
            seen = np.concatenate([seen, np.zeros(new.shape, bool)], 1)
            # Of a centroid reached more than once the expanded entry stays.
            by_id = np.argsort(ids * 2 + ~seen, axis=1, kind="stable")
            ids, sims, seen = (np.take_along_axis(v, by_id, 1) for v in (ids, sims, seen))
            again = ids[:, 1:] == ids[:, :-1]
            sims[:, 1:][again], seen[:, 1:][again] = -3, True
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, seen = (np.take_along_axis(v, best, 1) for v in (ids, sims, seen))
        return ids, sims


def _graph(vectors: DataFrame, n: int, list_size: int, sample: int) -> CentroidGraph:
    """Fit centroids on a sample by key hash, of ``sample`` vectors on average; ``n`` vectors of one length."""
    size = vectors.select(F.length("vec")).first()[0]
    sample = max(1, min(max(sample, min(n // 100, MOST_SAMPLED)), SAMPLE_BYTES // size))
    part = 1_000_000_000
    chosen = vectors.where(F.pmod(F.xxhash64("key"), F.lit(part)) < max(1, int(part * sample / n))) if n > sample else vectors
    raw = chosen.select("vec").toPandas()["vec"]
    if not len(raw):
        raw = vectors.select("vec").limit(1).toPandas()["vec"]
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
    leaf = max(1, round(list_size * len(x) / n), -(-2 * len(x) // MAX_LISTS))
    graph = CentroidGraph.build(balanced_centroids(x, leaf))
    near, _ = graph.search(x, 1)
    held = np.bincount(near[:, 0], minlength=len(graph.centroids)) * (n / len(x))
    graph.parts = np.maximum(1, np.ceil(held / (OVERFULL * max(list_size, n / len(graph.centroids)))).astype(np.int32))
    return graph


def probes_for(lists: int, effort: float = 1.0) -> int:
    """Lists to probe for neighbours at any distance, of so many lists."""
    return max(PROBE, round(effort * PROBE_SHARE * lists**PROBE_POWER))


ENTRY = "list int, part int, key string, vec binary, stored boolean, asks boolean"


def _assign(shared, store: int, probe: int, store_ratio: float, probe_ratio: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for frame in frames:
            if not len(frame):
                continue
            asking = frame["asks"].to_numpy(bool)
            # Rows that do not ask need their own lists only; many probes go out in small parts.
            for part, lists in ((frame[~asking], store), (frame[asking], max(store, probe))):
                step = max(1, _CELLS // 16 // lists)
                for a in range(0, len(part), step):
                    yield entries(graph, part.iloc[a : a + step], lists)

    def entries(graph: CentroidGraph, frame: pd.DataFrame, lists: int) -> pd.DataFrame:
        x = np.frombuffer(b"".join(frame["vec"]), np.float32).reshape(len(frame), -1)
        ids, sims = graph.search(x, lists)
        far = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
        ratio = far / far[:, :1]
        place = np.arange(ids.shape[1])
        stored = (ratio <= store_ratio) & (place < store)
        asks = (ratio <= probe_ratio) & (place < probe) & frame["asks"].to_numpy(bool)[:, None]
        row, col = np.nonzero(stored | asks)
        number = ids[row, col].astype(np.int32)
        parts = graph.parts[number]
        own = row % parts  # the part in which it asks; it is stored in all
        if (parts > 1).any():
            again = np.repeat(np.arange(len(row)), np.where(stored[row, col], parts, 1))
            nth = np.arange(len(again)) - np.searchsorted(again, again, "left")
            row, col, number, own = row[again], col[again], number[again], own[again]
            part = np.where(stored[row, col], nth, own)
        else:
            part = own
        return pd.DataFrame({"list": number, "part": part.astype(np.int32), "key": frame["key"].to_numpy()[row], "vec": frame["vec"].to_numpy()[row], "stored": stored[row, col], "asks": asks[row, col] & (part == own)})

    return run


def _search_list(k: int, min_cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key", kind="stable", ignore_index=True)
        keys = pdf["key"].to_numpy()
        x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), -1)
        members = np.flatnonzero(pdf["stored"].to_numpy(bool))
        asking = np.flatnonzero(pdf["asks"].to_numpy(bool))
        out = []
        # Blocks on both sides bound the memory; of each block of members the k best go on.
        for a in range(0, len(asking), _BLOCK):
            q = asking[a : a + _BLOCK]
            for b in range(0, len(members), 4 * _BLOCK):
                m = members[b : b + 4 * _BLOCK]
                s = x[q] @ x[m].T
                s[q[:, None] == m[None, :]] = -3
                if len(m) > k:
                    # Ties at the k-th place go to the smaller key: all that reach it are kept here.
                    least = np.maximum(np.partition(s, len(m) - k, axis=1)[:, len(m) - k], np.float32(min_cosine - 1e-6))
                else:
                    least = np.full(len(q), max(min_cosine - 1e-6, -2.0), np.float32)
                i, j = np.nonzero(s >= least[:, None])
                c = s[i, j]
                order = np.lexsort((m[j], -c, i))
                i, j, c = i[order], j[order], c[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
                keep = rank < k
                out.append((keys[q[i[keep]]], keys[m[j[keep]]], q[i[keep]], m[j[keep]]))
        if not out:
            none = np.array([], object)
            return pd.DataFrame({"key": none, "neighbour": none, "cosine": np.array([], float)})
        qi, mi = np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out])
        exact = np.concatenate([np.einsum("ij,ij->i", x[qi[a : a + 65536]].astype(np.float64), x[mi[a : a + 65536]].astype(np.float64)) for a in range(0, max(len(qi), 1), 65536)])
        return pd.DataFrame({"key": np.concatenate([o[0] for o in out]), "neighbour": np.concatenate([o[1] for o in out]), "cosine": np.round(exact, 7)})

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each key, equal cosines by the smaller neighbour; a key has few candidates."""
    pairs = pairs.groupBy("key", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    min_cosine: float = -1.0,
    queries: str | None = None,
    list_size: int = LIST_SIZE,
    sample: int = SAMPLE,
    store: int = STORE,
    probe: int | None = None,
    effort: float = 1.0,
    store_ratio: float = STORE_RATIO,
    probe_ratio: float = PROBE_RATIO,
) -> DataFrame:
    """``key, neighbour, cosine, rank``: for every key the k most similar others of at least ``min_cosine``.

    ``queries`` is a condition on ``key`` that limits which rows ask; all are searched.  Keys of the
    same direction have cosine 1 and rank before all others, the smaller key first.  Copies of a key
    count once.  Null and all-zero vectors take no part; vectors are compared with those of the same
    length.  An empty table gives no row.  Without ``probe`` the probes grow with the lists
    (:func:`probes_for`), by ``effort`` more or fewer.  Recall depends on the probes and is measured in the tests.
    """
    spark = df.sparkSession
    vectors = materialise(unit_vectors(df, key, vector), "vectors")
    # Directions that several keys share: one key stands for them in the index.
    shared = vectors.groupBy("direction").agg(F.min("key").alias("first"), F.max("key").alias("_last")).where(F.col("first") < F.col("_last")).select("direction", "first")
    shared = materialise(shared, "directions")
    n_shared = shared.count()
    if n_shared:
        hint = F.broadcast(shared) if n_shared <= BROADCAST_ROWS else shared
        indexed = vectors.join(hint, "direction", "left").where(F.col("first").isNull() | (F.col("first") == F.col("key"))).select("key", "vec")
        members = materialise(vectors.select("key", "direction").join(hint, "direction").select("key", "first").distinct(), "members")
    else:
        indexed, members = vectors.select("key", "vec"), None
    asks = F.expr(queries) if queries else F.lit(True)
    if members is not None and queries:
        asking = members.where(queries).select(F.col("first").alias("key")).distinct().withColumn("_asks", F.lit(True))
        indexed = indexed.join(F.broadcast(asking) if n_shared <= BROADCAST_ROWS else asking, "key", "left").withColumn("asks", asks | F.coalesce("_asks", F.lit(False))).drop("_asks")
    else:
        indexed = indexed.withColumn("asks", asks)
    near = None
    for size, n, n_asking, bytes_of_key in indexed.groupBy(F.length("vec")).agg(F.count(F.lit(1)), F.count_if("asks"), F.avg(F.length("key"))).collect():
        own = indexed.where(F.length("vec") == size)
        graph = _graph(own, n, list_size, sample)
        probes = probe or probes_for(len(graph.centroids), effort)
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil((n * store + n_asking * max(store, probes)) * (size + bytes_of_key + 24) / TASK_BYTES))
        shown = spark.sparkContext.broadcast(graph)
        entries = own.select("key", "vec", "asks").mapInPandas(_assign(shown, store, probes, store_ratio, probe_ratio), ENTRY)
        part = entries.repartition(tasks, "list", "part").groupBy("list", "part").applyInPandas(_search_list(k, min_cosine), "key string, neighbour string, cosine double")
        near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], "key string, neighbour string, cosine double, rank int")
    near = _top(near.where(F.col("cosine") >= min_cosine), k).select("key", "neighbour", "cosine")
    if members is not None:
        # Each class of a direction: its k + 1 smallest keys are all that any row can need of it.
        order = Window.partitionBy("first").orderBy("key")
        few = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("first", F.col("key").alias("mate"))
        few = F.broadcast(few) if n_shared * (k + 1) <= BROADCAST_ROWS else few
        near = near.join(few.withColumnRenamed("first", "neighbour"), "neighbour", "left").select("key", F.coalesce("mate", "neighbour").alias("neighbour"), "cosine")
        near = materialise(_top(near, k).select("key", "neighbour", "cosine"), "near")
        # What a class found holds for its members, of which one class may have most: few rows a class, so these are broadcast.
        asked = near.join(hint.select(F.col("first").alias("key")), "key", "left_semi").withColumnRenamed("key", "first")
        asked = F.broadcast(asked) if n_shared * k <= BROADCAST_ROWS else asked
        others = near.join(hint.select(F.col("first").alias("key")), "key", "left_anti")
        of_members = members.join(asked, "first").select("key", "neighbour", "cosine")
        own = members.join(few, "first").where(F.col("key") != F.col("mate")).select("key", F.col("mate").alias("neighbour"), F.lit(1.0).alias("cosine"))
        near = others.unionByName(of_members).unionByName(own)
        if queries:
            near = near.where(queries)
        near = _top(near, k).select("key", "neighbour", "cosine")
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return near.withColumn("rank", F.row_number().over(order))


def brute_force(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k most similar rows of each query row, for measuring recall."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[queries] @ unit.T
    s[np.arange(len(queries)), queries] = -3
    return np.argsort(-s, axis=1, kind="stable")[:, :k]
