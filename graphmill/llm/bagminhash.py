"""Near-duplicate texts by BagMinHash signatures, bands and exact verification.

A text is a weighted set: each word with its number of occurrences (or 1, see ``weights``).  For
each word and each of the signature's registers a Poisson process runs over (time, weight level);
a register keeps the earliest time of any point whose level lies below the weight of its word.  Two
texts then agree in a register with probability equal to their weighted Jaccard similarity.  The
weight axis is cut into octaves [0,1), [1,2), [2,4), [4,8) ...: whole octaves below the weight give
their first arrival directly, the octave that holds the weight is split down a binary hierarchy, so
that a weight costs its logarithm, squared, and not its value.  Weights are discretised to
multiples of ``1/resolution``.

Texts whose word weights are the same form one class; the search runs over classes.  Registers are
banded, each band as deep as its words demand: registers are added to its key until the words that
won them would be expected together in no more than ``BUCKET`` texts, so frequent words make deep
bands, rare ones shallow bands, and buckets do not grow with the table.  A text goes on with
further bands until a pair at the threshold would miss it in all of them with probability ``MISS``
at most; of two texts the one that stops first decides, so that bound holds for every pair.  Texts
that meet in a bucket are compared by one bit of every register, and pairs above a lower
confidence bound of the similarity are verified on the words themselves.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.words import data_of, hash32, mix64, words
from graphmill.session import materialise

REGISTERS = 256
#: Bands take their registers from the first so many; the others serve the comparison of bits.
BAND_REGISTERS = 128
#: Texts expected in a bucket, and the probability with which a pair at the threshold may meet in none.
BUCKET, MISS = 16, 0.001
#: Registers in a band and bands of a text, at most.
DEPTH, BANDS = 8, 128
#: Words of fewer texts than this share count as having it; at most so many words are sent to the workers (12 bytes each).
LEAST_SHARE, MOST_WORDS = 2e-4, 500_000
#: Pairs are dropped before verification where the similarity that the bits suggest is this many deviations too low.
DEVIATIONS = 3.0
#: A bucket estimated to hold more classes is compared in tiles of so many, each pair of tiles being one task's work.
TILE = 20_000
#: Identifiers are broadcast up to this many (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Pairs compared at a time; numbers worked on at a time, so that they stay in a core's cache; texts and bands whose keys are made at a time.
_PAIRS, _BLOCK, _TEXTS, _STRIP = 1 << 19, 1 << 15, 2048, 16


def _unit(seed: np.ndarray, node: int) -> np.ndarray:
    """Uniform numbers in (0, 1) of a node of the hierarchy, one for each seed."""
    with np.errstate(over="ignore"):
        h = mix64(seed + np.uint64((node * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def arrivals(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """First arrival below each element's weight, for every register: float32 [elements, registers]."""
    return _arrivals(elements, weights, registers).T


def _arrivals(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The same by register: float32 [registers, elements]."""
    out = np.empty((registers, len(elements)), np.float32)
    lanes = mix64(np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for w in np.unique(weights):
        at = np.flatnonzero(weights == w)
        own = elements[at].astype(np.uint64)
        step = max(1, _BLOCK // len(at))
        for a in range(0, registers, step):
            out[a : a + step, at] = _earliest(mix64(lanes[a : a + step, None] ^ own[None, :]), int(w)) if w >= 1 else np.inf
    return out


def _earliest(seed: np.ndarray, w: int) -> np.ndarray:
    """First arrival below weight ``w`` of the processes of each seed."""
    best = -np.log(_unit(seed, 1))  # level [0, 1), rate 1
    octave = 0
    while (1 << octave) < w:  # levels [2**octave, 2**(octave + 1)), rate 2**octave
        low, width = 1 << octave, 1 << octave
        first = -np.log(_unit(seed, 2 + octave)) / width
        path = 2 + octave
        while w < low + width:  # the weight ends inside: split the process
            if w == low:
                first = np.full_like(first, np.inf)
                break
            half = width // 2
            path = path * 2 + 64
            to_left = _unit(seed, path) < 0.5
            other = first - np.log(_unit(seed, path + 1)) / half
            left, right = np.where(to_left, first, other), np.where(to_left, other, first)
            if w >= low + half:
                best = np.minimum(best, left)
                low, first, path = low + half, right, path + 1
            else:
                first = left
            width = half
        best = np.minimum(best, first)
        octave += 1
    return best


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures of (elements, weights) pairs, float32 [sets, registers]; no set may be empty."""
    return _signatures(sets, registers, 0)[0]


def _signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int, named: int, rarity: Rarity | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and of each of the first ``named`` registers the element that won it, or that element's ``rarity``: [sets, named]."""
    sizes = np.array([len(e) for e, _ in sets])
    pairs = np.concatenate([e.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64) for e, w in sets])
    where, known = pd.factorize(pairs, sort=True)
    elements = (known >> np.uint64(32)).astype(np.uint32)
    # Times are positive: as whole numbers they have the same order, with room below for the element's number.
    table = _arrivals(elements, (known & np.uint64(0xFFFFFFFF)).astype(np.int64), registers).view(np.uint32)
    numbers = np.arange(len(known), dtype=np.uint64)
    marks = elements if rarity is None else rarity.bits_of(elements)
    out, won = np.empty((registers, len(sets)), np.uint32), np.empty((named, len(sets)), marks.dtype)
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], _BLOCK), "right"))  # sets of about a block of words
    parts = [(a, b, where[ends[a] - sizes[a] : ends[b - 1]], ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])) for a, b in zip(cuts, [*cuts[1:], len(sets)])]
    for r, times in enumerate(table):
        if r < named:
            both = times.astype(np.uint64) << np.uint64(32) | numbers
            for a, b, rows, starts in parts:
                least = np.minimum.reduceat(both.take(rows, mode="clip"), starts)
                out[r, a:b] = least >> np.uint64(32)
                won[r, a:b] = marks[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        else:
            for a, b, rows, starts in parts:
                out[r, a:b] = np.minimum.reduceat(times.take(rows, mode="clip"), starts)
    return out.view(np.float32).T, won.T


def bits(signature: np.ndarray) -> np.ndarray:
    """One mixed bit of every register, packed: uint8 [sets, registers / 8]."""
    mixed = mix64(signature.view(np.uint32).astype(np.uint64))
    return np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1)


@dataclass
class Rarity:
    """In how many texts words occur: the frequent ones, by ascending hash, and the number of texts."""

    texts: int
    words: np.ndarray
    counts: np.ndarray

    def bits_of(self, elements: np.ndarray) -> np.ndarray:
        """-log of the share of texts that have each element, float32."""
        share = np.full(elements.shape, LEAST_SHARE)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, elements), len(self.words) - 1)
            share = np.maximum(share, np.where(self.words[at] == elements, self.counts[at] / max(self.texts, 1), 0.0))
        return -np.log(np.minimum(share, 1.0)).astype(np.float32)


@functools.lru_cache(2)
def _paths(bands: int, depth: int, registers: int) -> np.ndarray:
    """Which register each step of each band takes; every register comes once before any comes again."""
    rng = np.random.default_rng(7)
    return np.stack([np.concatenate([rng.permutation(registers) for _ in range(-(-bands // registers))])[:bands] for _ in range(depth)], 1)


def band_keys(signature: np.ndarray, rarity: np.ndarray, texts: int, threshold: float, bucket: int = BUCKET, miss: float = MISS, depth: int = DEPTH, bands: int = BANDS) -> list[np.ndarray]:
    """The 63-bit keys of every text's bands: int64 arrays.  ``rarity`` belongs to the words that won the first registers."""
    n, registers = rarity.shape
    values, rarity = signature[:, :registers].T.view(np.uint32).astype(np.uint64), rarity.T
    path = _paths(bands, depth, registers)
    wanted = np.log(max(texts / bucket, 1.0 + 1e-9))
    seeds = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    out, used = np.empty((n, bands), np.int64), np.zeros(n, np.int64)
    # Missed by all bands before this one; the band is needed while that is above what may be missed.
    left, missed = np.arange(n), np.ones(n)
    for first in range(0, bands, _STRIP):
        taken = path[first : first + _STRIP]
        keys = np.repeat(seeds[first : first + _STRIP, None], len(left), 1)
        found, deep = np.zeros(keys.shape, np.float32), np.zeros(keys.shape, np.int64)
        for step in range(depth):
            more = found < wanted
            if not more.any():
                break
            cells = np.ix_(taken[:, step], left)
            keys = np.where(more, mix64(keys ^ values[cells]), keys)
            found += np.where(more, rarity[cells], 0)
            deep += more
        after = np.cumprod(np.concatenate([missed[None], 1 - np.minimum(threshold ** deep.astype(np.float64), 1 - 1e-12)]), axis=0)
        out[left, first : first + len(keys)] = (keys >> np.uint64(1)).astype(np.int64).T
        used[left] += (after[:-1] > miss).sum(0)
        left, missed = left[after[-1] > miss], after[-1][after[-1] > miss]
        if not len(left):
            break
    return [k[:u] for k, u in zip(out, used)]


SETS = "id string, class long, n long, total long, elements binary, weights binary"


def weighted_sets(df: DataFrame, id: str, text: list[str], weights: str = "bag", json_data: str | None = None, min_elements: int = 1, resolution: int = 1) -> DataFrame:
    """``id, class, n, total, elements, weights`` of every row that has at least ``min_elements`` different words.

    The words are those of all ``text`` columns and of field ``data`` of ``json_data`` together.
    ``weights``: "bag" counts occurrences, "set" gives each word 1.  Rows with a null ``id``, or with
    content that has no data, give nothing.  ``class`` is a 64-bit fingerprint of words and weights.
    """
    if weights not in ("bag", "set"):
        raise ValueError(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, seen = [], {}
            for values in frame.itertuples(index=False, name=None):
                if values[0] is None:
                    continue
                found = [w for v in values[1 : 1 + len(text)] for w in words(v)]
                if json_data:
                    data = data_of(values[-1])
                    if data is None:
                        continue
                    found += words(data)
                counts = Counter(found)
                if len(counts) < max(1, min_elements):
                    continue
                names = list(counts)
                elements = hash32(names)
                weight = np.ones(len(names), np.int64) if weights == "set" else np.array([counts[w] * resolution for w in names], np.int64)
                order = np.lexsort((weight, elements))
                elements, weight = elements[order], weight[order].astype(np.uint32)
                packed = elements.tobytes(), weight.tobytes()
                mark = xxhash.xxh3_64_intdigest(packed[0] + packed[1]) - (1 << 63)
                if (values[0], mark) not in seen:  # copies within the batch
                    seen[values[0], mark] = None
                    rows.append((values[0], mark, len(names), int(weight.sum()), *packed))
            yield pd.DataFrame(rows, columns=["id", "class", "n", "total", "elements", "weights"])

    columns = [F.col(id).cast("string").alias("_0")] + [F.col(c).cast("string").alias(f"_{i + 1}") for i, c in enumerate(text)]
    if json_data:
        columns.append(F.col(json_data).cast("string").alias("_j"))
    return df.select(*columns).mapInPandas(run, SETS)


def word_rarity(sets: DataFrame) -> Rarity:
    """Counts over all texts; of words, those of at least a share that bounds their number whatever the table's size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words, counts = np.unique(np.frombuffer(b"".join(frame["elements"]), np.uint32), return_counts=True)
            yield pd.DataFrame({"word": words.astype(np.int64), "n": counts.astype(np.int64)})

    texts, sizes = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not texts:
        return Rarity(0, np.empty(0, np.uint32), np.empty(0, np.int64))
    share = max(LEAST_SHARE, sizes / texts / MOST_WORDS)  # all words' counts add up to ``sizes``
    counts = sets.select("elements").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= share * texts).toPandas().sort_values("word")
    return Rarity(texts, frequent["word"].to_numpy(np.uint32), frequent["n"].to_numpy(np.int64))


def _signed(sets: DataFrame, rarity: Broadcast, threshold: float) -> DataFrame:
    """``class, total, sketch, bands array<long>``: one row of a class for each batch of its members."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Rarity = rarity.value
        for frame in frames:
            frame = frame.drop_duplicates("class")
            if not len(frame):
                continue
            unpacked = [(np.frombuffer(e, np.uint32), np.frombuffer(w, np.uint32)) for e, w in zip(frame["elements"], frame["weights"])]
            signature, rarities = _signatures(unpacked, REGISTERS, BAND_REGISTERS, known)
            parts = [slice(a, a + _TEXTS) for a in range(0, len(frame), _TEXTS)]
            bands = [k for p in parts for k in band_keys(signature[p], rarities[p], known.texts, threshold)]
            sketch = [x.tobytes() for p in parts for x in bits(signature[p])]
            yield pd.DataFrame({"class": frame["class"].to_numpy(), "total": frame["total"].to_numpy(), "sketch": sketch, "bands": bands})

    return sets.select("class", "total", "elements", "weights").mapInPandas(run, "class long, total long, sketch binary, bands array<long>")


def _possible(sketch: np.ndarray, total: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, deviations: float) -> np.ndarray:
    """Which pairs of rows the sketches and total weights leave at ``threshold`` or above.  ``sketch`` is [words, rows]."""
    n_bits = len(sketch) * 64
    agree = (1 + threshold) / 2
    most = n_bits * (1 - agree) + deviations * np.sqrt(n_bits * agree * (1 - agree))  # differing bits
    differ = np.bitwise_count(sketch[0][i] ^ sketch[0][j]).astype(np.int16)
    for word in sketch[1:]:
        differ += np.bitwise_count(word[i] ^ word[j])
    at = np.flatnonzero(differ <= most)
    x, y = total[i[at]], total[j[at]]
    return at[np.minimum(x, y) >= threshold * np.maximum(x, y)]


def _runs(starts: np.ndarray, n: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run, in chunks; in a run across tiles only those of different sides."""
    ends = np.append(starts[1:], n)
    partners = np.repeat(ends, ends - starts) - np.arange(n) - 1  # rows after each one in its run
    upto = np.cumsum(partners)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _PAIRS, "right")))
        count = partners[first:last]
        i = np.repeat(np.arange(first, last), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        if side.any():
            across = (side[i] == 0) | (side[i] != side[j])
            i, j = i[across], j[across]
        yield i, j
        first = last


def _bucket_pairs(threshold: float, deviations: float):
    """mapInPandas over rows sorted by ``key, tile``: candidate pairs of classes."""

    def candidates(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, total, side = rows["class"].to_numpy(), rows["total"].to_numpy(), rows["side"].to_numpy()
        sketch = np.ascontiguousarray(np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(ids), -1).T)
        found = [np.empty((0, 2), np.int64)]
        for i, j in _runs(starts, len(ids), side):
            at = _possible(sketch, total, i, j, threshold, deviations)
            pair = np.stack([ids[i[at]], ids[j[at]]], 1)
            found.append(np.sort(pair[pair[:, 0] != pair[:, 1]], 1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the bucket that the next frame may continue
        for frame in frames:
            if not len(frame):
                continue
            key, tile = frame["key"].to_numpy(), frame["tile"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            if held and (held[-1]["key"].iloc[-1] != key[0] or held[-1]["tile"].iloc[-1] != tile[0]):
                yield candidates(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))
                held = []
            if len(starts) == 1:
                held.append(frame)
                continue
            if held:
                yield candidates(pd.concat([*held, frame.iloc[: starts[1]]], ignore_index=True), np.zeros(1, np.int64))
                frame, starts = frame.iloc[starts[1] :], starts[1:] - starts[1]
            if len(starts) > 1:
                yield candidates(frame.iloc[: starts[-1]], starts[:-1])
            held = [frame.iloc[starts[-1] :]]
        if held:
            yield candidates(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))

    return run


def _hot_buckets(sets: DataFrame, rarity: Broadcast, threshold: float, tile: int) -> DataFrame:
    """``key, tiles`` of buckets that a sample of classes shows to be large, with the number of tiles they need.

    Only where work goes depends on it: a bucket may be tiled or not without any change of result.
    """
    one_in = 64
    sampled = _signed(sets.where(F.pmod(F.xxhash64("class"), F.lit(one_in)) == 0), rarity, threshold).dropDuplicates(["class"])
    counts = sampled.select(F.explode("bands").alias("key")).groupBy("key").count().where(F.col("count") * one_in > tile)
    return counts.select("key", F.ceil(F.col("count") * one_in / tile).cast("int").alias("tiles"))


def similar_classes(sets: DataFrame, threshold: float = 0.8, deviations: float = DEVIATIONS, tile: int = TILE) -> DataFrame:
    """Pairs ``a, b, similarity`` of classes (a < b) with weighted Jaccard similarity >= ``threshold``, verified.

    ``sets`` comes from :func:`weighted_sets` and should be materialised.  Every pair returned is
    exact; a pair at the threshold is found with probability 1 - ``MISS``, less 0.0013 for the
    comparison of bits, and more similar ones more surely.
    """
    known = word_rarity(sets)
    rarity = sets.sparkSession.sparkContext.broadcast(known)
    entries = _signed(sets, rarity, threshold).select("class", "total", "sketch", F.explode("bands").alias("key"))
    none = [F.lit(0).alias("tile"), F.lit(0).alias("side")]
    hot = materialise(_hot_buckets(sets, rarity, threshold, tile), "hot") if known.texts > tile else None
    n_hot = hot.count() if hot is not None else 0
    if n_hot:
        entries = entries.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "key", "left")
        own = F.pmod(F.hash("class"), F.col("tiles"))
        # Tile pair (i, j), i <= j, is number i * tiles + j; a class sits on the first side of one row of pairs and the second of one column.
        across = F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda t: F.struct((F.least(own, t) * F.col("tiles") + F.greatest(own, t) + 1).alias("tile"), F.when(own == t, 0).when(own < t, 1).otherwise(2).alias("side")),
        )
        whole = F.array(F.struct(*none))
        entries = entries.select("key", "class", "total", "sketch", F.inline(F.when(F.col("tiles").isNull(), whole).otherwise(across)))
    else:
        entries = entries.select("key", "class", "total", "sketch", *none)
    met = entries.repartition("key", "tile").sortWithinPartitions("key", "tile")
    candidates = materialise(met.mapInPandas(_bucket_pairs(threshold, deviations), "a long, b long").distinct(), "candidates")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ids = F.broadcast(ids) if 2 * candidates.count() <= BROADCAST_IDS else ids
    texts = sets.join(ids, "class", "left_semi").groupBy("class").agg(F.first(F.struct("elements", "weights")).alias("s"))
    joined = candidates.join(texts.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(texts.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, b, ea, wa, eb, wb in frame.itertuples(index=False, name=None):
                ea, wa, eb, wb = (np.frombuffer(x, np.uint32) for x in (ea, wa, eb, wb))
                _, x, y = np.intersect1d(ea, eb, assume_unique=False, return_indices=True)
                both = int(np.minimum(wa[x], wb[y]).sum())
                either = int(wa.sum()) + int(wb.sum()) - both
                out.append((a, b, both / either if both >= threshold * either - 1e-9 else -1.0))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    flat = joined.select("a", "b", F.col("sa.elements").alias("ea"), F.col("sa.weights").alias("wa"), F.col("sb.elements").alias("eb"), F.col("sb.weights").alias("wb"))
    return flat.mapInPandas(verify, "a long, b long, similarity double").where("similarity >= 0")


def near_duplicates(df: DataFrame, id: str, text: list[str], weights: str = "bag", threshold: float = 0.8, json_data: str | None = None, min_elements: int = 1, **search: int) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members`` is ``id, class, n`` of every text, ``links`` the pairs of classes.

    Copies of a text share a class and are not expanded into pairs.  Texts with fewer than
    ``min_elements`` different words, null and empty texts belong to no class.  Null columns count
    as empty; ties cannot arise; an empty table gives two empty results; other columns are ignored.
    """
    sets = materialise(weighted_sets(df, id, text, weights, json_data, min_elements), "sets")
    return sets.select("id", "class", "n").distinct(), similar_classes(sets, threshold, **search)


def expand(members: DataFrame, links: DataFrame, part: int = 1000) -> DataFrame:
    """Pairs of ids ``id_a < id_b``: members of linked classes, and members of the same class.

    A class of many members meets its partners in parts of about ``part`` members, each pair of
    parts being its own work.
    """
    links = materialise(links, "links")
    members = materialise(members.select("id", "class").distinct(), "members")
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    ids = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialise(sizes.join(ids.withColumn("linked", F.lit(True)), "class", "left").where(F.col("linked") | (F.col("n") > 1)).select("class", F.ceil(F.col("n") / part).cast("int").alias("parts")), "wanted")
    hint = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = members.join(hint, "class").select("id", "class", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    alone = links.select("a", "b").unionByName(wanted.select(F.col("class").alias("a"), F.col("class").alias("b")))
    of = lambda side: hint.select(F.col("class").alias(side), F.col("parts").alias(f"parts_{side}"))
    both = alone.join(of("a"), "a").join(of("b"), "b")
    split = both.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)).alias("part_a"), "parts_b").select("a", "b", "part_a", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)).alias("part_b"))
    side = lambda s, name: rows.select(F.col("class").alias(s), F.col("part").alias(f"part_{s}"), F.col("id").alias(name))
    pairs = split.join(side("a", "x"), ["a", "part_a"]).join(side("b", "y"), ["b", "part_b"])
    pairs = pairs.where(F.when(F.col("a") == F.col("b"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
