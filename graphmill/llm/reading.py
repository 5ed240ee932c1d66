"""Reading level of documents from a Rasch-style model of words and documents.

Every document has a latent level and every word a difficulty.  A running word of document d is
word w with probability proportional to exp(ease_w + difficulty_w * level_d): the harder a word,
the faster its share rises with the level.  The two sides are fitted in turn.  Given the words, the
level of a document depends only on its length and its summed difficulties; given the levels,
binned, each word is a Poisson regression on its counts by bin.  A pass over the corpus computes
levels and adds up counts by word and bin, in each task first and then in the cluster; only that
table, of a size that does not depend on the documents, reaches the driver.  The scale has its sense from word lengths, with which it starts, and its level
marks from human labels, by the cut points that contradict fewest of them.

The vocabulary is the words in at least ``MIN_SHARE`` of the documents, of which there are at most
(mean different words of a document) / MIN_SHARE.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.words import words
from graphmill.session import materialise

MIN_SHARE = 0.001
MIN_DOCS = 3
BINS = np.linspace(-4.0, 4.0, 41)
ITERATIONS = 5
#: Labelled documents used to set the level marks, at most so many by hash of their identifier.
LABELLED = 20_000
MIN_WORDS = 60
LEVELS = (1, 2, 3, 4, 5)

#: Spellings of languages, by the first letters of what a lang column says.
LANGUAGES = {"en": "en", "de": "de", "ge": "de", "fr": "fr", "es": "es", "sp": "es", "zh": "zh", "ch": "zh", "cn": "zh"}

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^\s{0,3}#{1,6}(\s|$)")
_UNDERLINE = re.compile(r"^\s*(=+|-{2,}|\*{3,}|_{3,})\s*$")
_TABLE = re.compile(r"^\s*\|.*\|?\s*$")
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:(?:[-*+•]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?)?(?:\[(?:user|assistant|system|tool)\]\s*:?|(?:user|assistant|system|tool|human|ai)\s*:)?\s*", re.IGNORECASE)
_CODE_SPAN = re.compile(r"`[^`\n]*[(){}=<>;][^`\n]*`")


def prose(text: str | None) -> list[str]:
    """Paragraphs of running prose: no code, tables or headings, and no list, quote or role markers."""
    if not text:
        return []
    lines, fenced = text.split("\n"), False
    paragraphs, current = [], []
    for number, line in enumerate(lines):
        if _FENCE.match(line):
            fenced = not fenced
            line = ""
        elif fenced:
            continue
        elif _TABLE.match(line) or _UNDERLINE.match(line) or line.startswith(("    ", "\t")) and not current and not _MARKER.match(line).group().strip():
            line = ""
        elif _HEADING.match(line):
            line = ""
        elif number + 1 < len(lines) and re.match(r"^(=+|-{3,})\s*$", lines[number + 1]) and line.strip():
            line = ""  # an underlined heading
        marker = _MARKER.match(line).group()
        if not line.strip() or marker.strip():
            if current:
                paragraphs.append(" ".join(current))
                current = []
        if line.strip():
            current.append(_CODE_SPAN.sub(" ", line[len(marker) :]))
    if current:
        paragraphs.append(" ".join(current))
    return [p for p in paragraphs if p.strip()]


def language(column: str):
    """A lang column's value as one of en, de, fr, es, zh; null where it is null or says something else."""
    start = F.lower(F.substring(F.trim(F.col(column).cast("string")), 1, 2))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, start)


def _prose(rows: DataFrame) -> DataFrame:
    """``_id, _lang, _prose``: the words of each paragraph between spaces, a paragraph to a line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = ["\n".join(" ".join(words(p)) for p in prose(text)) for text in frame["_text"]]
            yield pd.DataFrame({"_id": frame["_id"], "_lang": frame["_lang"], "_prose": lines})

    return rows.select("_id", "_lang", "_text").mapInPandas(run, "_id string, _lang string, _prose string")


def _word_documents(rows: DataFrame) -> DataFrame:
    """``lang, word, n``: in how many documents of a language a word of prose occurs; word null counts documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        for frame in frames:
            for lang, text in zip(frame["_lang"], frame["_prose"]):
                of = counts.setdefault(lang, Counter())
                of[None] += 1
                of.update(set(text.split()))
                if len(of) > 500_000:
                    yield _rows(counts)
                    counts = {}
        yield _rows(counts)

    def _rows(counts: dict[str, Counter]) -> pd.DataFrame:
        return pd.DataFrame([(lang, w, n) for lang, of in counts.items() for w, n in of.items()], columns=["lang", "word", "n"])

    partial = rows.where(F.col("_lang").isNotNull()).select("_lang", "_prose").mapInPandas(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _vocabulary(rows: DataFrame, lang: str, min_share: float) -> tuple[dict[str, float], list[str]]:
    """Log odds of words for ``lang`` against the other languages, and the words of ``lang`` for the model."""
    counts = materialise(_word_documents(rows), "words")
    total = {r["lang"]: r["n"] for r in counts.where(F.col("word").isNull()).collect()}
    own, other = total.get(lang, 0), sum(n for k, n in total.items() if k != lang)
    is_own = F.col("lang") == lang
    by_word = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum(F.when(is_own, F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(is_own, 0).otherwise(F.col("n"))).alias("other"))
    frequent = by_word.where((F.col("own") >= max(MIN_DOCS, min_share * own)) | (F.col("other") >= max(MIN_DOCS, min_share * other))).orderBy("word")
    odds, model = {}, []
    for r in frequent.collect():
        odds[r["word"]] = float(np.log((r["own"] + 0.5) / (own + 1)) - np.log((r["other"] + 0.5) / (other + 1)))
        if r["own"] >= max(MIN_DOCS, min_share * own) and (odds[r["word"]] > -0.7 or not other):
            model.append(r["word"])
    return odds, model


BAGS = "doc_id string, lang string, n_words long, terms binary, counts binary"


def _bags(rows: DataFrame, lang: str, odds: dict[str, float], model: list[str]) -> DataFrame:
    """``doc_id, lang, n_words, terms, counts`` of the paragraphs written in ``lang``."""
    shared = rows.sparkSession.sparkContext.broadcast((odds, {w: i for i, w in enumerate(model)}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds, number = shared.value
        for frame in frames:
            out = []
            for doc, said, text in zip(frame["_id"], frame["_lang"], frame["_prose"]):
                kept, score, n_own, n_all = Counter(), 0.0, 0, 0
                for paragraph in text.split("\n"):
                    found = paragraph.split(" ") if paragraph else []
                    here = sum(odds.get(w, 0.0) for w in found)
                    score += here
                    n_all += len(found)
                    if here > 0 or here == 0 and said == lang:
                        kept.update(found)
                        n_own += len(found)
                is_own = said == lang or said is None and score > 0 and 2 * n_own > n_all
                terms = sorted((number[w], c) for w, c in kept.items() if w in number)
                out.append((doc, lang if is_own else said, n_own if is_own else n_all, np.array([t for t, _ in terms], np.int32).tobytes() if is_own else b"", np.array([c for _, c in terms], np.int32).tobytes() if is_own else b""))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "n_words", "terms", "counts"])

    return rows.mapInPandas(run, BAGS)


def _unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of a frame end to end, and the document each belongs to."""
    terms = np.frombuffer(b"".join(frame["terms"]), np.int32)
    counts = np.frombuffer(b"".join(frame["counts"]), np.int32).astype(np.float64)
    sizes = frame["terms"].map(len).to_numpy() // 4 if len(frame) else np.array([], int)
    return terms, counts, np.repeat(np.arange(len(frame)), sizes)


def levels_of(difficulty: np.ndarray, ease: np.ndarray, terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Most likely level of each document, under a standard normal prior; NaN without any known word."""
    exponents = ease[:, None] + difficulty[:, None] * BINS[None, :]
    top = exponents.max(0)
    log_z = top + np.log(np.exp(exponents - top).sum(0))
    n = np.bincount(doc, counts, n_docs)
    summed = np.bincount(doc, counts * difficulty[terms], n_docs)
    fit = summed[:, None] * BINS[None, :] - n[:, None] * log_z[None, :] - BINS[None, :] ** 2 / 2
    best = fit.argmax(1)
    inner = np.clip(best, 1, len(BINS) - 2)
    a, b, c = (np.take_along_axis(fit, (inner + d)[:, None], 1)[:, 0] for d in (-1, 0, 1))
    bend = a - 2 * b + c
    step = np.where(bend < 0, 0.5 * (a - c) / np.where(bend < 0, bend, -1.0), 0.0)
    level = BINS[inner] + np.clip(step, -1, 1) * (BINS[1] - BINS[0])
    return np.where(n > 0, level, np.nan)


def fit_words(table: np.ndarray, centres: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ease and difficulty of each word from its counts by level bin: penalised Poisson regressions, all at once."""
    total = table.sum(0)
    used = total > 0
    table, offset, x = table[:, used], np.log(total[used]), centres[used]
    ease = np.log((table.sum(1) + 0.5) / total.sum())
    difficulty = np.zeros(len(table))
    for _ in range(25):
        mean = np.exp(np.clip(ease[:, None] + difficulty[:, None] * x + offset, -50, 50))
        gap = table - mean
        g0, g1 = gap.sum(1), (gap * x).sum(1) - ridge * difficulty
        h00, h01, h11 = mean.sum(1) + 1e-9, (mean * x).sum(1), (mean * x * x).sum(1) + ridge
        det = h00 * h11 - h01**2
        ease = ease + np.clip((h11 * g0 - h01 * g1) / det, -1, 1)
        difficulty = difficulty + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
    return ease, difficulty


def _counts_by_bin(bags: DataFrame, ease: np.ndarray, difficulty: np.ndarray, shift: float, scale: float, start: bool) -> tuple[np.ndarray, float, float]:
    """Counts by word and level bin over all documents, with the mean and deviation of the levels.

    Tasks give the cells they have met, which are added up in the cluster; at most one row for each
    word and bin, and three for the moments (cells below 0), come to the driver.
    """
    shared = bags.sparkSession.sparkContext.broadcast((ease, difficulty))
    shape = (len(ease), len(BINS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ease, difficulty = shared.value
        table, moments = np.zeros(shape[0] * shape[1]), np.zeros(3)
        for frame in frames:
            terms, counts, doc = _unpack(frame)
            if not len(terms):
                continue
            if start:  # mean word length
                n = np.bincount(doc, counts, len(frame))
                level = np.where(n > 0, np.bincount(doc, counts * difficulty[terms], len(frame)) / np.maximum(n, 1), np.nan)
            else:
                level = levels_of(difficulty, ease, terms, counts, doc, len(frame))
            level = (level - shift) / scale
            known = ~np.isnan(level)
            moments += [known.sum(), level[known].sum(), (level[known] ** 2).sum()]
            if scale == 1.0 and start:
                continue
            cell = np.clip(np.rint((np.nan_to_num(level) - BINS[0]) / (BINS[1] - BINS[0])), 0, len(BINS) - 1).astype(np.int64)
            table += np.bincount(terms.astype(np.int64) * shape[1] + cell[doc], counts, len(table))
        met = np.flatnonzero(table)
        yield pd.DataFrame({"cell": np.concatenate([[-3, -2, -1], met]), "n": np.concatenate([moments, table[met]])})

    sums = bags.where(F.length("terms") > 0).select("terms", "counts").mapInPandas(run, "cell long, n double")
    total = sums.groupBy("cell").agg(F.sum("n").alias("n")).select(F.col("cell").cast("int"), "n").toPandas()
    moments, cells = np.zeros(3), total[total["cell"] >= 0]
    for cell, n in total[total["cell"] < 0].itertuples(index=False):
        moments[int(cell) + 3] = n
    table = np.bincount(cells["cell"], cells["n"], shape[0] * shape[1]).reshape(shape)
    mean = moments[1] / max(moments[0], 1)
    return table, mean, float(np.sqrt(max(moments[2] / max(moments[0], 1) - mean**2, 1e-12)))


def fit(bags: DataFrame, model: list[str], iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Ease and difficulty of the model's words, by alternating passes over the documents."""
    lengths = np.array([min(len(w), 15) for w in model], np.float64)
    flat = np.zeros(len(model))
    _, mean, deviation = _counts_by_bin(bags, flat, lengths, 0.0, 1.0, True)
    table, _, _ = _counts_by_bin(bags, flat, lengths, mean, deviation, True)
    ease, difficulty = fit_words(table, BINS)
    mean, deviation = 0.0, 1.0
    for _ in range(iterations - 1):
        table, mean, deviation = _counts_by_bin(bags, ease, difficulty, 0.0, 1.0, False)
        ease, difficulty = fit_words(table, (BINS - mean) / deviation)
    return ease, difficulty


def level_marks(level: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Where levels 2 to 5 begin: cut points that contradict the fewest labels, in ascending order.

    Of several equally good stretches the widest is cut, in its middle.  Without labels the marks
    divide the standard normal distribution evenly.
    """
    if not len(level):
        return np.array([-0.84, -0.25, 0.25, 0.84])
    order = np.argsort(level, kind="stable")
    level, label = level[order], label[order]
    edges = np.concatenate([[level[0] - 0.5], (level[1:] + level[:-1]) / 2, [level[-1] + 0.5]])
    width = np.concatenate([[0.5], level[1:] - level[:-1], [0.5]])
    marks = []
    for wanted in LEVELS[1:]:
        above = label >= wanted - 0.5
        wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum((~above)[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        marks.append(edges[best[np.argmax(width[best])]])
    return np.maximum.accumulate(marks)


def reading_levels(documents: DataFrame, labels: DataFrame, lang: str = "en", iterations: int = ITERATIONS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, lang, n_words, difficulty, level`` of every document, one row for each identifier.

    ``n_words`` counts words of running prose in the document's language, ``level`` is 1 to 5.
    Documents in other languages and those without any word of the vocabulary have neither
    difficulty nor level.  The language is what the lang column says; where that is null or unknown
    it is what the words of labelled documents suggest.  Null and empty texts have 0 words.  Labels
    that are null or outside 1 to 5 are left out, a rater's copies count once, and several raters
    of a document are averaged.  Of repeated identifiers the row with the most words of prose, then
    the greatest other values, counts.  Tables may be empty.
    """
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("_id"), language("lang").alias("_lang"), F.col("text").alias("_text"))
    rows = materialise(_prose(rows), "prose")  # cut once, read by the counts of words and by the bags
    odds, model = _vocabulary(rows, lang, min_share)
    bags = materialise(_bags(rows, lang, odds, model), "bags")
    ease, difficulty = fit(bags, model, iterations) if model else (np.zeros(0), np.zeros(0))
    shared = documents.sparkSession.sparkContext.broadcast((ease, difficulty))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ease, difficulty = shared.value
        for frame in frames:
            level = np.full(len(frame), np.nan)
            if len(ease) and len(frame):
                terms, counts, doc = _unpack(frame)
                if len(terms):
                    level = levels_of(difficulty, ease, terms, counts, doc, len(frame))
            yield frame[["doc_id", "lang", "n_words"]].assign(difficulty=level)

    scored = bags.mapInPandas(run, "doc_id string, lang string, n_words long, difficulty double").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = scored.withColumn("difficulty", F.when(~F.isnan("difficulty"), F.col("difficulty")))
    once = labels.where(F.col("reading_level").between(LEVELS[0], LEVELS[-1]) & F.col("doc_id").isNotNull()).groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("l"))
    rated = once.groupBy("doc_id").agg(F.avg("l").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = scored.where(F.col("difficulty").isNotNull()).join(rated, "doc_id").select("doc_id", "difficulty", "label").distinct().toPandas()
    marks = level_marks(known["difficulty"].to_numpy(np.float64), known["label"].to_numpy(np.float64))
    level = F.lit(1)
    for mark in marks:
        level = level + F.when(F.col("difficulty") >= float(mark), 1).otherwise(0)
    final = scored.withColumn("level", F.when(F.col("difficulty").isNotNull(), level))
    once = final.groupBy("doc_id").agg(F.max(F.struct("n_words", "lang", "difficulty", "level")).alias("r"))
    return once.select("doc_id", "r.lang", "r.n_words", "r.difficulty", "r.level")
