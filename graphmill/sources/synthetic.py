"""Made-up knowledge, statements and queries of a given size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.errors import ValidationError
from graphmill.functions.content import content_column, triple_column
from graphmill.operators.fulltext import sanitise

ENTITIES, PREDICATES = 24, 20
#: Different statements that exist: subject and object differ.
MOST_STATEMENTS = ENTITIES * (ENTITIES - 1) * PREDICATES
TAGS = 19
SCALES = {"small": (1_000, 2_000, 20, 40), "medium": (10_000, 11_040, 100, 200), "large": (50_000, 11_040, 500, 1_000)}
#: Words of a topic that are searched for.
QUERY_WORDS = 6
_VERBS = "moved reviewed merged measured replaced delayed".split()
_NOUNS = "cache queue parser ledger index schema router planner buffer worker".split()


def _pick(words: list[str], *parts: Column | int | str) -> Column:
    seeds = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64(*seeds), F.lit(len(words))).cast("int"))


def _sentences(id: Column, least: int, most: int, seed: int) -> Column:
    """From ``least`` to ``most`` words in sentences of eight."""
    n = F.pmod(F.xxhash64(id, F.lit(seed)), F.lit((most - least) // 8 + 1)).cast("int") + least // 8 + 1
    one = lambda i: F.concat_ws(" ", F.lit("The"), _pick(_NOUNS, id, i, seed, 1), F.lit("of"), F.concat(F.lit("team"), (F.pmod(F.xxhash64(id, i), F.lit(50))).cast("string")), F.lit("was"), _pick(_VERBS, id, i, seed, 2), F.lit("by"), F.concat(_pick(_NOUNS, id, i, seed, 3), F.lit(".")))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), " ")


def needle_topic(i: Column) -> Column:
    """Twenty topics, over and over."""
    n = F.pmod(i, F.lit(20)).cast("string")
    return F.concat(F.lit("Rare protocol "), F.concat(F.lit("zeta"), n), F.lit(" handles "), F.concat(F.lit("omega"), n), F.lit(" records with checksum "), F.concat(F.lit("sigma"), n))


def needle_query(topic: str) -> str:
    """The part of a topic that is searched for: its first words."""
    return sanitise(" ".join(topic.split()[:QUERY_WORDS]))


def knowledge(spark: SparkSession, rows: int, needles: int, seed: int = 42) -> DataFrame:
    """``name, content``: needles first by number, then filler, in any order."""
    if needles > rows:
        raise ValidationError("more needles than rows")
    ids = spark.range(rows).withColumnRenamed("id", "i")
    is_needle = F.col("i") < needles
    number = F.when(is_needle, F.col("i")).otherwise(F.col("i") - needles)
    name = F.when(is_needle, F.format_string("needle_%04d", number)).otherwise(F.format_string("knowledge_%06d", number))
    hidden = F.concat(F.format_string("NEEDLE_%04d: ", number), needle_topic(number), F.lit(". This row was hidden on purpose."))
    labels = F.transform(F.sequence(F.lit(1), F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(4)).cast("int") + 1), lambda k: F.concat(F.lit("tag"), F.pmod(F.xxhash64("i", k), F.lit(TAGS)).cast("string")))
    marks = F.when(is_needle, F.array(F.lit("benchmark"), F.lit("needle"))).otherwise(F.array_distinct(labels))
    return ids.select(name.alias("name"), content_column(F.when(is_needle, hidden).otherwise(_sentences(F.col("i"), 30, 100, seed)), marks).alias("content"))


def statements(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """``triple, subject, predicate, object, content``: ``rows`` different statements in a fixed random order."""
    if rows > MOST_STATEMENTS:
        raise ValidationError(f"only {MOST_STATEMENTS} different statements exist")
    every = spark.range(MOST_STATEMENTS).withColumnRenamed("id", "i")
    chosen = every.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(rows)
    s, rest = (F.col("i") / ((ENTITIES - 1) * PREDICATES)).cast("int"), F.pmod("i", F.lit((ENTITIES - 1) * PREDICATES))
    o, p = (rest / PREDICATES).cast("int"), F.pmod(rest, F.lit(PREDICATES))
    o = F.when(o >= s, o + 1).otherwise(o)
    name = lambda c: F.concat(F.lit("Entity"), c.cast("string"))
    parts = chosen.select("i", name(s).alias("subject"), F.concat(F.lit("relation"), p.cast("string")).alias("predicate"), name(o).alias("object"))
    told = F.pmod(F.xxhash64("i", F.lit(seed + 1)), F.lit(10)) < 3
    data = F.when(told, _sentences(F.col("i"), 5, 20, seed)).otherwise("")
    return parts.select(triple_column(F.col("subject"), F.col("predicate"), F.col("object")).alias("triple"), "subject", "predicate", "object", content_column(data).alias("content"))


def queries(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """``query, expected``: half of them for needles, half for pairs of words with no known answer."""
    topics = spark.range(count // 2).select(F.format_string("needle_%04d", "id").alias("expected"), F.substring_index(needle_topic(F.col("id")), " ", QUERY_WORDS).alias("query"))
    pairs = spark.range(count - count // 2).select(F.lit(None).cast("string").alias("expected"), F.concat_ws(" ", _pick(_NOUNS, F.col("id"), seed, 1), _pick(_VERBS, F.col("id"), seed, 2)).alias("query"))
    return topics.unionByName(pairs)
