"""Ranked full-text search: an inverted index as DataFrames, boolean queries, weighted BM25.

The index has the tables ``postings`` (term, doc_id, tokens, column, position; ``tokens`` is the
document's length) and ``docs`` (doc_id, catalog, key, content, tokens), and one row of corpus
statistics; a saved one also ``terms``, with the number of documents of each.  Terms are folded and,
if asked, stemmed once for each different word of a batch.  A query touches the postings of its own
terms.  Documents that have changed since are set apart by :meth:`FullTextIndex.changed`.
"""

from __future__ import annotations

import operator
import os
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.errors import ParseError
from graphmill.functions.content import joined, synonyms, tags
from graphmill.functions.segmentation import PAIRS, Segmenter
from graphmill.functions.stemming import fold, fold_column, porter, stem_column
from graphmill.session import materialise

#: Column weights and the constants of BM25.
WEIGHTS = {"key": 10.0, "data": 1.0, "tags": 5.0, "synonyms": 3.0}
K1, B = 1.2, 0.75
#: Documents of a word whose postings one task writes.
HOT_POSTINGS = 100_000
LEAST_IDF = 1e-6
#: Fixed value: punctuation that a query's text loses.
PUNCTUATION = ":\"'*^+-().?!,/`{}[]~@#%;&|<>"

_TOKEN = r"[\p{L}\p{N}\p{M}\p{Co}]+"


def fields(key: Column, content: Column, segmenter: Segmenter = PAIRS) -> dict[str, Column]:
    """The four searched texts of a row."""
    data = F.coalesce(F.get_json_object(content, "$.data"), F.lit(""))
    return {n: segmenter.column(c) for n, c in {"key": key, "data": data, "tags": joined(tags(content)), "synonyms": joined(synonyms(content))}.items()}


def knowledge_docs(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(F.lit("knowledge").alias("catalog"), F.col("name").alias("key"), "content")


def statement_docs(statement: DataFrame) -> DataFrame:
    return statement.select(F.lit("statement").alias("catalog"), F.col("triple").alias("key"), "content")


@dataclass
class FullTextIndex:
    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    stem: bool
    weights: dict[str, float]
    buckets: int | None = None
    terms: DataFrame | None = None
    cut: DataFrame | None = None
    segmenter: Segmenter = PAIRS

    @classmethod
    def build(cls, docs: DataFrame, stem: bool = True, texts: dict[str, Column] | None = None, weights: dict[str, float] | None = None, segmenter: Segmenter = PAIRS) -> FullTextIndex:
        """Index ``catalog, key, content`` rows, of which each (catalog, key) should occur once.

        ``texts`` names the searched texts as columns over ``docs``; without it they are those of
        :func:`fields`.  The document number is a hash of catalog and key.
        """
        texts = texts or fields(F.col("key"), F.col("content"), segmenter)
        tokens = F.array(*[F.struct(F.lit(n).alias("column"), F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"({_TOKEN})"), F.lit(1)).alias("words")) for n, t in texts.items()])
        cut = docs.select(F.xxhash64("catalog", "key").alias("doc_id"), "catalog", "key", "content", tokens.alias("texts"))
        return cls._of(cut, stem, weights or WEIGHTS, segmenter)

    @classmethod
    def _of(cls, cut: DataFrame, stem: bool, weights: dict[str, float], segmenter: Segmenter) -> FullTextIndex:
        """The index of documents whose texts are cut into words."""
        size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.size(t["words"]))
        sized = cut.withColumn("tokens", size)
        raw = sized.select("doc_id", "tokens", F.inline("texts")).select("doc_id", "tokens", "column", F.posexplode("words").alias("position", "raw"))
        postings = raw.withColumn("term", (stem_column if stem else fold_column)("raw")).select("term", "doc_id", "tokens", "column", "position")
        stats = sized.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("tokens").alias("mean_tokens"))
        return cls(postings, sized.select("doc_id", "catalog", "key", "content", "tokens"), stats, stem, weights, cut=cut, segmenter=segmenter)

    def save(self, path: str, buckets: int = 16) -> FullTextIndex:
        """Write the index, postings in folders by a hash of the term, and open it.

        Within a folder they lie in the order of term and document; those of a word in more than
        ``HOT_POSTINGS`` documents are spread over tasks by document.
        """
        spark = self.docs.sparkSession
        once = self if self.cut is None else FullTextIndex._of(materialise(self.cut, "cut"), self.stem, self.weights, self.segmenter)
        postings = materialise(once.postings, "postings")
        terms = postings.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"))
        bucket = F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket")
        terms.select("term", "docs", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(os.path.join(path, "terms"))
        terms = spark.read.parquet(os.path.join(path, "terms"))
        # Fewer than all postings / HOT_POSTINGS.
        hot = terms.where(F.col("docs") > HOT_POSTINGS).select("term", F.ceil(F.col("docs") / HOT_POSTINGS).alias("parts"))
        placed = postings.join(F.broadcast(hot), "term", "left").withColumn("part", F.pmod(F.hash("doc_id"), F.coalesce("parts", F.lit(1)))).withColumn("bucket", bucket)
        placed.repartition("bucket", "part").drop("part", "parts").sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(os.path.join(path, "postings"))
        once.docs.write.parquet(os.path.join(path, "docs"))
        once.stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(os.path.join(path, "stats"))
        return FullTextIndex.load(spark, path, self.stem, self.weights, self.segmenter)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stem: bool = True, weights: dict[str, float] | None = None, segmenter: Segmenter = PAIRS) -> FullTextIndex:
        """Open a saved index.  Its statistics are written last, so an index without them is not complete."""
        stats = spark.read.schema("n_docs double, mean_tokens double, buckets int").parquet(os.path.join(path, "stats"))
        schemas = {
            "postings": "term string, doc_id long, tokens long, column string, position int, bucket int",
            "docs": "doc_id long, catalog string, key string, content string, tokens long",
            "terms": "term string, docs long, bucket int",
        }
        postings, docs, terms = (spark.read.schema(schemas[part]).parquet(os.path.join(path, part)) for part in ("postings", "docs", "terms"))
        known = stats.first()
        return cls(postings, docs, spark.createDataFrame([known]), stem, weights or WEIGHTS, known["buckets"], terms, segmenter=segmenter)

    def changed(self, keys: DataFrame, docs: DataFrame) -> FullTextIndex:
        """The index after a change: ``catalog, key`` of documents whose entries no longer hold, and those that replace them.

        Both should be small and cheap to read again.  Searches count documents anew, as the counts kept are of before.
        """
        gone = keys.select(F.xxhash64("catalog", "key").alias("doc_id")).distinct()
        fresh = FullTextIndex.build(docs, self.stem, None, self.weights, self.segmenter)
        postings = fresh.postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets)))
        kept = self.postings.join(gone, "doc_id", "left_anti")
        tokens = lambda of, sign: of.agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.coalesce(F.sum("tokens"), F.lit(0))).alias("t"))
        before = self.stats.select(F.col("n_docs").alias("n"), (F.col("n_docs") * F.coalesce("mean_tokens", F.lit(0.0))).alias("t"))
        sums = before.unionByName(tokens(self.docs.join(gone, "doc_id", "left_semi"), -1)).unionByName(tokens(fresh.docs, 1))
        stats = sums.agg(F.sum("n").alias("n_docs"), (F.sum("t") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean_tokens"))
        return FullTextIndex(kept.select(*postings.columns).unionByName(postings), self.docs.join(gone, "doc_id", "left_anti").unionByName(fresh.docs), stats, self.stem, self.weights, self.buckets, segmenter=self.segmenter)

    def terms_of(self, word: str) -> list[str]:
        found = [fold(t) for t in re.findall(r"[^\W_]+", _keep_marks(word.lower()))]
        return [porter(t) for t in found] if self.stem else found

    def search(self, text: str, catalog: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
        """``id, catalog, key, content, rank`` of matching rows, the smallest rank being the best.

        Rows of equal rank come in the order of catalog and key.  ``limit`` None gives all matches.
        """
        tree, phrases = parse_search(text, self.terms_of, self.segmenter)
        ranked = self._ranked(tree, phrases)
        only = self.docs if catalog is None else self.docs.where(F.col("catalog") == catalog)
        if limit is not None:  # contents are fetched for the page only
            ranked = ranked.join(only.select("doc_id", "catalog", "key"), "doc_id").orderBy("rank", "catalog", "key").offset(offset).limit(limit).select("doc_id", "rank")
        found = ranked.join(only, "doc_id").select(F.col("doc_id").alias("id"), "catalog", "key", "content", "rank")
        return found if limit is None else found.orderBy("rank", "catalog", "key")

    def _ranked(self, tree, phrases: list[tuple[str, ...]]) -> DataFrame:
        wanted = sorted({t for p in phrases for t in p})
        if not wanted:
            return self.docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("rank"))
        rows = self.postings.where(F.col("term").isin(wanted))
        if self.buckets:  # folded to numbers by the optimiser: only their folders are read
            rows = rows.where(F.col("bucket").isin(self._folders(wanted)))
        weight = reduce(lambda c, kv: c.when(F.col("column") == kv[0], F.lit(kv[1])), self.weights.items(), F.when(F.lit(False), 0.0))
        hits = reduce(DataFrame.unionByName, [self._phrase(rows, p).select("doc_id", "tokens", F.lit(i).alias("phrase"), weight.alias("w")) for i, p in enumerate(phrases)])
        per = hits.groupBy("doc_id", "tokens").agg(*[F.sum(F.when(F.col("phrase") == i, F.col("w"))).alias(f"tf{i}") for i in range(len(phrases))])
        if self.terms is not None and all(len(p) == 1 for p in phrases):
            # Kept with the index: one row for each word of the query.
            near = self.terms.where(F.col("term").isin(wanted) & F.col("bucket").isin(self._folders(wanted)))
            docs = {r["term"]: r["docs"] for r in near.collect()}
            counts = {f"n{i}": F.lit(float(docs.get(p[0], 0))) for i, p in enumerate(phrases)}
            stats = self.stats.first()
            scored = per.withColumns(counts | {"n_docs": F.lit(stats["n_docs"]), "mean_tokens": F.lit(stats["mean_tokens"])})
        else:
            found_in = per.agg(*[F.count(f"tf{i}").cast("double").alias(f"n{i}") for i in range(len(phrases))])
            one = F.lit(1).alias("_one")
            stats = self.stats.select(one, "n_docs", "mean_tokens").join(found_in.select(one, "*"), "_one")
            scored = per.select(one, "*").join(F.broadcast(stats), "_one")
        rank = F.lit(0.0)
        counted = dict(_counted(tree, lambda i: F.col(f"tf{i}").isNotNull(), F.lit(True)))
        for i in range(len(phrases)):
            tf = F.when(counted.get(i, F.lit(False)), F.coalesce(f"tf{i}", F.lit(0.0))).otherwise(0.0)
            idf = F.ln((F.col("n_docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            rank = rank - idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("tokens") / F.col("mean_tokens")))
        holds = _holds(tree, lambda i: F.col(f"tf{i}").isNotNull())
        return scored.where(holds).select("doc_id", rank.alias("rank"))

    def _folders(self, terms: list[str]) -> list[Column]:
        return [F.pmod(F.hash(F.lit(t)), F.lit(self.buckets)) for t in terms]

    @staticmethod
    def _phrase(rows: DataFrame, phrase: tuple[str, ...]) -> DataFrame:
        """Every place where the words of a phrase follow each other."""
        found = rows.where(F.col("term") == phrase[0]).select("doc_id", "tokens", "column", "position")
        for step, term in enumerate(phrase[1:], 1):
            later = rows.where(F.col("term") == term).select("doc_id", "column", (F.col("position") - step).alias("position"))
            found = found.join(later, ["doc_id", "column", "position"], "left_semi")
        return found


def _keep_marks(word: str) -> str:
    """Compose letters with their marks, so that marks do not split a word."""
    return unicodedata.normalize("NFC", word)


def sanitise(text: str) -> str:
    """Query text without punctuation, single-spaced."""
    return re.sub(" +", " ", text.translate({ord(c): " " for c in PUNCTUATION})).strip(" ")


def parse_search(text: str, terms, segmenter: Segmenter = PAIRS) -> tuple:
    """A boolean tree over phrase numbers, and the phrases.

    Words side by side must all occur; then NOT, AND, OR in falling precedence.  A word that is cut
    into several terms is a phrase, one without any term is left out.  The tree is a number,
    ("and" | "or" | "not", left, right), or None where nothing is left to match.
    """
    words = sanitise(segmenter.text(text)).split()
    if not words:
        raise ParseError("empty search")
    for word in words:
        if re.search(r"[\x00-\x7f]", word) and re.search(r"[^\w\x1a]", re.sub(r"[^\x00-\x7f]", "", word), re.ASCII):
            raise ParseError(f"syntax error near {word!r}")
    phrases: list[tuple[str, ...]] = []
    at = 0

    def group():
        nonlocal at
        node, any_word = None, False
        while at < len(words) and words[at] not in ("AND", "OR", "NOT"):
            any_word = True
            phrase = tuple(terms(words[at]))
            at += 1
            if phrase:
                phrases.append(phrase)
                node = len(phrases) - 1 if node is None else ("and", node, len(phrases) - 1)
        if not any_word:
            raise ParseError("syntax error: an operator without its operand")
        return node

    def level(name: str, inner):
        nonlocal at
        node = inner()
        while at < len(words) and words[at] == name:
            at += 1
            right = inner()
            node = (name.lower(), node, right)
        return node

    tree = level("OR", lambda: level("AND", lambda: level("NOT", group)))
    return tree, phrases


def _holds(tree, phrase) -> Column:
    if tree is None:
        return F.lit(False)
    if isinstance(tree, int):
        return phrase(tree)
    name, left, right = tree
    if name == "not":
        return _holds(left, phrase) & ~_holds(right, phrase)
    return (operator.and_ if name == "and" else operator.or_)(_holds(left, phrase), _holds(right, phrase))


def _counted(tree, phrase, when: Column):
    """(phrase, condition) pairs: a phrase adds to the rank only where its side of every OR holds."""
    if isinstance(tree, int):
        yield tree, when
    elif tree is not None:
        name, left, right = tree
        for side in (left, right)[: 1 if name == "not" else 2]:
            yield from _counted(side, phrase, when & _holds(side, phrase) if name == "or" else when)
