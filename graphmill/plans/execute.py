"""Queries over tables: scan, filter, semi joins, order, page, shape.  Everything stays lazy."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.errors import ModelUnavailable, ValidationError
from graphmill.functions.vectors import cosine_distance
from graphmill.operators.fulltext import FullTextIndex, knowledge_docs, statement_docs
from graphmill.operators.graph import k_hop
from graphmill.plans.compile import KEY, Options, Query, Search, Similar, Walk, compile_query
from graphmill.plans.expressions import parse, parse_text

OUTPUT = {
    "knowledge": ["name", "content", "created_at"],
    "statement": ["triple", "subject", "predicate", "object", "content", "created_at", "tr_start", "tr_end"],
}


class Embedder(Protocol):
    def embed(self, text: str) -> Sequence[float]: ...


@dataclass
class Tables:
    """What a query runs over.  Each key occurs once; the index covers both tables and may be a function that opens it."""

    knowledge: DataFrame | None = None
    statement: DataFrame | None = None
    index: FullTextIndex | Callable[[], FullTextIndex] | None = None
    embedder: Embedder | None = None

    def of(self, target: str) -> DataFrame:
        found = getattr(self, target)
        if found is None:
            raise ValidationError(f"no {target} table")
        return found

    def full_text(self) -> FullTextIndex:
        if self.index is None:
            docs = [shape(t) for t, shape in ((self.knowledge, knowledge_docs), (self.statement, statement_docs)) if t is not None]
            self.index = FullTextIndex.build(docs[0] if len(docs) == 1 else docs[0].unionByName(docs[1]))
        return self.index() if callable(self.index) else self.index

    def vector(self, text: str) -> Sequence[float]:
        if self.embedder is None:
            raise ModelUnavailable("no embedding model")
        return self.embedder.embed(text)


@dataclass
class Answer:
    """The rows of a query and how many they are: those returned, after limit and offset."""

    rows: DataFrame

    @cached_property
    def total_count(self) -> int:
        return self.rows.count()

    def counted(self) -> DataFrame:
        """The rows with ``total_count``."""
        return self.rows.join(F.broadcast(self.rows.agg(F.count(F.lit(1)).alias("total_count"))))


def nearest(table: DataFrame, key: str, vector: Sequence[float], limit: int) -> DataFrame:
    """``<key>, content, distance`` of the closest rows by cosine; zero vectors come last, rows without vector never."""
    rows = table.where(F.col("embedding").isNotNull()).select(key, "content", cosine_distance(F.col("embedding"), vector).alias("distance"))
    return rows.orderBy("distance", key).limit(limit)


def similar(tables: Tables, vector: Sequence[float], target: str = "knowledge", limit: int = 10) -> DataFrame:
    """Closest rows of one table, or of ``both`` as ``catalog, key, content, distance``."""
    if target in KEY:
        return nearest(tables.of(target), KEY[target], vector, limit)
    if target != "both":
        raise ValidationError(f"target must be knowledge, statement or both, not {target!r}")
    parts = [nearest(tables.of(t), k, vector, limit).select(F.lit(t).alias("catalog"), F.col(k).alias("key"), "content", "distance") for t, k in KEY.items()]
    return parts[0].unionByName(parts[1]).orderBy("distance", "catalog", "key").limit(limit)


def _keys(source: Search | Similar | Walk, query: Query, tables: Tables) -> DataFrame:
    """The keys a source admits, as one column named like the target's key."""
    key, options = KEY[query.target], query.options
    if isinstance(source, Search):
        # The page of the search is the page of the query: its limit and offset apply twice.
        found = tables.full_text().search(source.text, options.catalog or query.target, options.limit, options.offset)
        return found.select(F.col("key").alias(key))
    if isinstance(source, Similar):
        return nearest(tables.of(query.target), key, tables.vector(source.text), options.limit).select(key)
    return k_hop(tables.of("statement"), source.subject, source.predicate, source.depth).select(key)


def run(query: Query, tables: Tables, page: bool = True) -> DataFrame:
    """The rows of a compiled query, newest first, equal times by key; all of them in any order without ``page``."""
    options: Options = query.options
    if options.limit < 0 or options.offset < 0:
        raise ValidationError("limit and offset must not be negative")
    rows = tables.of(query.target)
    for predicate in query.predicates:
        rows = rows.where(predicate)
    for source in query.sources:
        rows = rows.join(_keys(source, query, tables), KEY[query.target], "left_semi")
    rows = rows.select(*OUTPUT[query.target])
    if not page:
        return rows
    return rows.orderBy(F.desc("created_at"), KEY[query.target]).offset(options.offset).limit(options.limit)


def execute(expression: Any, tables: Tables, page: bool = True) -> DataFrame:
    """Parse, compile and run an expression, given as JSON text or as a decoded value."""
    return run(compile_query(parse_text(expression) if isinstance(expression, str) else parse(expression)), tables, page)
