"""Retrieval and answer metrics as aggregations over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.plans.shards import running_totals

KS = (1, 3, 5, 10, 50)

#: The ability that a question type tests.
ABILITIES = {
    "single-session-user": "information_extraction",
    "single-session-assistant": "information_extraction",
    "single-session-preference": "information_extraction",
    "multi-session": "multi_session_reasoning",
    "knowledge-update": "knowledge_updates",
    "temporal-reasoning": "temporal_reasoning",
}
#: Words that token F1 leaves out, and the endings it strips, the first that fits.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can
to of in for on with at by from it its this that these those i me my we our you your he she they them their and or but not no if
then so as up out about into over""".split()
ENDINGS = "ication ation tion sion ment ness ence ance ible able ful ous ive ing ied ies ed er ly al es".split()


def recall_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Whether any expected item is among the first k; true where nothing is expected."""
    nothing = F.coalesce(F.size(expected), F.lit(0)) <= 0
    return nothing | F.coalesce(F.arrays_overlap(F.slice(F.coalesce(retrieved, F.array().cast("array<string>")), 1, k), expected), F.lit(False))


def gain(place: int | Column) -> Column | float:
    """The weight of a place counted from 0: one over the bits of place + 1."""
    if isinstance(place, int):
        return 1.0 / (place + 1).bit_length()
    return F.lit(1.0) / F.length(F.bin(place + 1))


def ndcg_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Normalised gain of the first k for yes-or-no relevance, each repeated hit counting; 1 where nothing is expected."""
    top = F.slice(F.coalesce(retrieved, F.array().cast("array<string>")), 1, k)
    hits = F.transform(top, lambda item, i: F.when(F.array_contains(expected, item), F.lit(1.0) / F.length(F.bin(i.cast("long") + 1))).otherwise(0.0))
    ideal = F.element_at(F.array(*[F.lit(sum(gain(i) for i in range(n))) for n in range(1, k + 1)]), F.least(F.greatest(F.size(expected), F.lit(1)), F.lit(k)))
    total = F.aggregate(hits, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, F.lit(1.0)).otherwise(total / ideal)


def retrieval_report(results: DataFrame, by: list[str], expected: str, methods: dict[str, str], ks: tuple[int, ...] = KS) -> DataFrame:
    """``method, <by>, k, n, recall, ndcg`` with subtotals: rows whose ``by`` are null are totals.

    ``methods`` maps a name to the column of retrieved items, best first.
    """
    per_method = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("found")) for m, c in methods.items()])
    rows = results.select(*by, F.col(expected).alias("_expected"), F.inline(per_method))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), recall_at(F.col("found"), F.col("_expected"), k).cast("double").alias("r"), ndcg_at(F.col("found"), F.col("_expected"), k).alias("g")) for k in ks])
    flat = rows.select("method", *by, F.inline(cells))
    return flat.groupBy("method", "k", *by).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"))


def with_totals(results: DataFrame, by: str, value: dict[str, Column]) -> DataFrame:
    """Aggregates for each value of ``by`` and for all rows, the latter as OVERALL."""
    rolled = results.rollup(by).agg(F.grouping(by).alias("_total"), *[c.alias(n) for n, c in value.items()])
    return rolled.withColumn(by, F.when(F.col("_total") == 1, F.lit("OVERALL")).otherwise(F.col(by))).drop("_total")


def nearest_index(values: DataFrame, by: list[str], value: str, percents: list[int], rows_per_shard: int = 25_000) -> DataFrame:
    """Percentiles without interpolation: the value at position n * q div 100 of the sorted values.

    ``<by>, n, p<q>...``.  Values are counted by group first; running totals over the different
    values, in shards where a group has many, pick the places.  Nothing is collected.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    joined = running_totals(counts, by, value, "_c", rows_per_shard).join(sizes, by)
    at = lambda q: F.min(F.when(F.col("_upto") > F.expr(f"n * {q} div 100"), F.col(value))).alias(f"p{q}")
    return joined.groupBy(*by, "n").agg(*[at(q) for q in percents])


def latency_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``<by>, n, min, p50, p99, max`` of a column of microseconds."""
    ends = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return nearest_index(values, by, value, [50, 99]).join(ends, by).select(*by, "n", "min", "p50", "p99", "max")


def ability(question_type: Column) -> Column:
    """What a question type tests; anything that mentions ``abs`` tests abstention."""
    table = F.create_map(*[F.lit(x) for pair in ABILITIES.items() for x in pair])
    return F.when(F.contains(question_type, F.lit("abs")), "abstention").otherwise(F.coalesce(F.try_element_at(table, question_type), F.lit("unknown")))


def canonical_type(question_type: Column) -> Column:
    return F.regexp_replace(question_type, "_abs$", "")


def session_of(key: Column) -> Column:
    """The second part of ``question__session__turn_n``; null where there is none."""
    return F.try_element_at(F.split(key, "__"), F.lit(2))


def _stem(word: Column) -> Column:
    """A word without its first fitting ending, if three letters remain; words of three letters stay."""
    result = F.when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    for ending in reversed(ENDINGS):
        n = len(ending)
        result = F.when(F.endswith(word, F.lit(ending)) & (F.length(word) >= n + 3), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(result)
    return F.when(F.length(word) <= 3, word).otherwise(result)


def answer_tokens(text: Column) -> Column:
    """The set of stemmed words of a text, without stop words and single characters."""
    bare = F.split(F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]|\s+", " ")), " +")
    kept = F.filter(bare, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, _stem))


def token_f1(predicted: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall of token sets; 0 where either is empty or null."""
    common = F.size(F.array_intersect(predicted, gold)).cast("double")
    precision, recall = common / F.nullif(F.size(predicted), F.lit(0)), common / F.nullif(F.size(gold), F.lit(0))
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def score_summary(scores: DataFrame, by: list[str], score: str, rows_per_shard: int = 25_000) -> DataFrame:
    """``<by>, n, mean, median, deviation`` of scores; the deviation is that of a sample.

    The median, exact and between the two middle values of an even number, is read off running
    totals of the different values, so no group's values meet in one task.
    """
    known = scores.where(F.col(score).isNotNull())
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("deviation"))
    counts = known.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    totals = running_totals(counts, by, score, "_c", rows_per_shard).join(sums, by)
    at = lambda place: F.min(F.when(F.col("_upto") > F.expr(place), F.col(score)))
    middle = (at("(n - 1) div 2") + at("n div 2")) / 2
    return totals.groupBy(*by, "n", "mean", "deviation").agg(middle.alias("median")).select(*by, "n", "mean", "median", "deviation")


def accuracy_report(judged: DataFrame, type_column: str, correct: str) -> DataFrame:
    """``label, correct, n, accuracy`` by type, for abstention, over all, and pooled over answerable types."""
    of_type = F.when(ability(F.col(type_column)) == "abstention", F.lit("abstention")).otherwise(canonical_type(F.col(type_column)))
    by_type = judged.groupBy(of_type.alias("label")).agg(F.sum(F.col(correct).cast("long")).alias("correct"), F.count(F.lit(1)).alias("n"))
    pooled = by_type.select(F.inline(F.array(F.struct(F.lit("overall").alias("label"), "correct", "n"), F.struct(F.when(F.col("label") != "abstention", F.lit("task-averaged")).alias("label"), "correct", "n"))))
    pooled = pooled.where(F.col("label").isNotNull()).groupBy("label").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))
    return by_type.unionByName(pooled).withColumn("accuracy", F.col("correct") / F.col("n"))


def improvement(report: DataFrame, better: str, base: str, value: str = "recall") -> DataFrame:
    """``k, delta``: how much one method's value exceeds another's."""
    wide = report.groupBy("k").pivot("method", [better, base]).agg(F.first(value))
    return wide.select("k", (F.col(better) - F.col(base)).alias("delta"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A fixed random sample of ``n`` rows, the same for the same seed whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def throughput(rows: int, seconds: float) -> float:
    return rows / seconds if seconds > 0 else 0.0
