"""Queries of this package's operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bagminhash, bisect_split, borda, leaks, packing, percentiles, postings, reading
from graphmill.llm.oracles import ORACLES
from graphmill.session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of knowledge names whose sets of words are similar to 0.6 or more."""
    knowledge = table(spark, folder, "knowledge")
    members, links = bagminhash.near_duplicates(knowledge, "name", ["name"], weights="set", threshold=0.6, json_data="content", min_elements=24)
    return bagminhash.expand(members, links).select(F.col("id_a").alias("name_a"), F.col("id_b").alias("name_b"))


def p2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Each knowledge row's class and number of similar classes, by the overlap of its word multiset.

    A class is named by its smallest name.  A name whose data has no word, or that has no data, has
    a null class and no links; a name saved with different texts has a row for each.
    """
    knowledge = table(spark, folder, "knowledge")
    members, links = bagminhash.near_duplicates(knowledge, "name", [], weights="bag", threshold=0.8, json_data="content")
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("class").agg(F.min("id").alias("first")).join(ends, "class", "left")
    names = knowledge.where(F.col("name").isNotNull()).select(F.col("name").alias("id")).distinct()
    rows = names.join(members.join(classes, "class"), "id", "left")
    return rows.select(F.col("id").alias("name"), F.col("first").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge names whose data has more tokens than its shelf allows."""
    pieces = bisect_split.split_knowledge(table(spark, folder, "knowledge"), table(spark, folder, "local_config"), only_split=True, with_text=False)
    return pieces.where("piece = 0").select(F.col("id").alias("name")).distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all knowledge rows, by name and content once."""
    knowledge = table(spark, folder, "knowledge").select("name", "shelf", "content").where(F.col("content").isNotNull())
    # Only the rows of names that occur again are compared with each other.
    again = knowledge.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias("again"))
    marked = materialise(again, "again")
    marked = F.broadcast(marked) if marked.count() <= bagminhash.BROADCAST_IDS else marked
    same = F.col("name").eqNullSafe(F.col("again"))
    rows = knowledge.join(marked, same, "left_anti").unionByName(knowledge.join(marked, same, "left_semi").distinct())
    return bisect_split.split_knowledge(rows, table(spark, folder, "local_config")).withColumnRenamed("id", "name").drop("first_token")


def fused(spark: SparkSession, folder: str) -> DataFrame:
    fts, vec = table(spark, folder, "fts_result"), table(spark, folder, "vec_result")
    scores = [(fts, F.col("question_id"), F.col("key"), F.col("rank")), (vec, F.col("question_id"), F.col("key"), F.col("distance"))]
    return borda.borda(scores)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first key of each question that has hits of both kinds."""
    fts, vec = table(spark, folder, "fts_result"), table(spark, folder, "vec_result")
    first = borda.first_of(fused(spark, folder)).select(F.col("group").alias("question_id"), F.col("item").alias("key"))
    return first.join(fts.select("question_id").distinct(), "question_id", "left_semi").join(vec.select("question_id").distinct(), "question_id", "left_semi")


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranking of every question."""
    return borda.positions(fused(spark, folder)).select(F.col("group").alias("question_id"), F.col("item").alias("key"), "points", "found_in", "place")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One ranking of the keys in the two lists of each run and question, by their places; copies of a row count once."""
    rows = table(spark, folder, "eval_result")
    group = F.to_json(F.array("run_id", "question_id")).alias("g")
    keyed = rows.where(F.col("run_id").isNotNull() & F.col("question_id").isNotNull())
    listed = lambda keys: keyed.select(group, F.posexplode(keys).alias("place", "key"))
    scores = [(listed(c), F.col("g"), F.col("key"), F.col("place")) for c in ("fts_top_keys", "vec_top_keys")]
    placed = borda.positions(borda.borda(scores)).withColumn("g", F.from_json("group", "array<string>"))
    return placed.select(F.col("g")[0].alias("run_id"), F.col("g")[1].alias("question_id"), F.col("item").alias("key"), "points", "found_in", "place")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    knowledge = table(spark, folder, "knowledge").select(F.col("name").alias("key"), "embedding")
    return knowledge.unionByName(table(spark, folder, "statement").select(F.col("triple").alias("key"), "embedding"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keys with cosine of 0.95 or more, one being among the five most similar of the other."""
    near = postings.similar_vectors(vectors(spark, folder), "key", "embedding", k=5, min_cosine=0.95, **postings.CLOSE)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar embeddings of every hundredth embedding."""
    near = postings.similar_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", k=10, queries="cast(key AS bigint) % 100 = 0", list_size=100)
    return near.select(F.col("key").cast("long").alias("vec_id"), F.col("neighbour").cast("long").alias("neighbour_id"), "cosine", "rank")


def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar keys of both tables, at any distance, of a hundredth of the keys."""
    return postings.similar_vectors(vectors(spark, folder), "key", "embedding", k=5, queries="pmod(xxhash64(key), 100) = 0")


def p5_nearest_all(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar keys of both tables, at any distance, of every key, from a third of the lists that :func:`p5_nearest` probes."""
    return postings.similar_vectors(vectors(spark, folder), "key", "embedding", k=5, effort=0.35)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of latencies whose 90th percentile exceeds 8 times the median."""
    counts = percentiles.materialise(percentiles.latency_counts(table(spark, folder, "eval_result")), "counts")
    found = percentiles.bisect_percentiles(counts, [50, 90], min_rows=30)
    wide = found.groupBy("g").agg(F.max(F.when(F.col("q") == 50, F.col("lo"))).alias("median"), F.max(F.when(F.col("q") == 90, F.col("lo"))).alias("p90"))
    return wide.where(F.col("p90") > 8 * F.col("median")).select("g.run_id", "g.question_type", "g.side")


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th and 99th percentile of every group of latencies."""
    counts = percentiles.materialise(percentiles.latency_counts(table(spark, folder, "eval_result")), "counts")
    found = percentiles.bisect_percentiles(counts, [50, 90, 99])
    return found.select("g.run_id", "g.question_type", "g.side", "q", "n", F.col("lo").alias("value"))


def p7_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the sequences of its shelf."""
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "local_config"))


def passages(spark: SparkSession, folder: str, whole_from: int | None = None) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_item"), whole_from=whole_from)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that share 12 words in a row or more with them."""
    return passages(spark, folder).select(F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id")).distinct()


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked passage with its place in the document; items of 5 to 11 words where they stand whole."""
    return passages(spark, folder, whole_from=5).select(F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"), "start", "end", "item_word", "n_words").distinct()


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Language, words of prose, difficulty and reading level of every document."""
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_label"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """English documents with 60 words of prose or more, of reading level 4 or 5."""
    levels = p9_levels(spark, folder)
    return levels.where((F.col("lang") == "en") & (F.col("n_words") >= reading.MIN_WORDS) & (F.col("level") >= 4)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p2_found p2_near_duplicates p3_found p3_pieces p4_found p4_ranking p4_runs p5_found p5_neighbours p5_nearest p5_nearest_all p6_found p6_percentiles p7_sequences p8_found p8_passages p9_found p9_levels"
    return {name: globals()[name] for name in names.split()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
