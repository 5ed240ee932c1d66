"""A shelf: a folder with knowledge, statements, a search index and archived files.

Each table has a base, Parquet files of unique keys in the order of their keys, and a log of
batches written since: whole states of keys, or their deletion, the newest counting.  Reading the
state joins the keys of the log against the base, so filters and columns reach the base's scan;
writing a batch is one append; :meth:`Shelf.compact` writes a new base.  Every base and batch is a
folder that counts from the moment its job has ended (``_SUCCESS``), and folders are never changed:
a crash leaves the old state or the new one.  The search index is kept in the same way and
brought up to date by what the log says has changed.

Paths are those of Spark's own file systems; nothing but single archived files passes the driver.
"""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from graphmill.errors import AlreadyExists, ModelUnavailable, NotFound, ValidationError
from graphmill.functions.content import Content, embedding_text, triple_key
from graphmill.functions.segmentation import PAIRS, Segmenter
from graphmill.functions.vectors import vector_literal
from graphmill.operators.fulltext import FullTextIndex, knowledge_docs, statement_docs
from graphmill.plans.compile import KEY
from graphmill.plans.execute import Answer, Tables, execute, similar
from graphmill.session import materialise, ship_package
from graphmill.sources.files import Files

COLUMNS = {
    "knowledge": "name string, content string, created_at timestamp_ntz, embedding array<float>",
    "statement": "triple string, subject string, predicate string, object string, content string, created_at timestamp_ntz, tr_start timestamp_ntz, tr_end timestamp_ntz, embedding array<float>",
}
LOG = "seq long, op string, "
#: Rows of a base lie in this order, so that scans by these columns skip most files and row groups.
ORDER = {"knowledge": ["name"], "statement": ["subject", "predicate", "object", "triple"]}
#: The search index is written anew when more rows than this share of it, and than this many, have changed.
STALE_SHARE, STALE_ROWS = 0.1, 10_000
BROADCAST_KEYS = 1_000_000
#: Texts that an embedder gets at once.
EMBED_BATCH = 64


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in COLUMNS[table].split(", ")]


def latest(rows: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each key, that of the greatest ``order``; rows with a null key vanish.

    Copies are combined before the shuffle.  Equal orders are settled by the row's other values.
    """
    others = columns or [c for c in rows.columns if c not in (key, order)]
    state = F.struct(F.col(order).alias(order), *others)
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(state).alias("_s"))
    return best.select(key, "_s.*")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """:func:`latest` where few keys are repeated: only the rows of those keys are shuffled."""
    repeated = materialise(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), "repeated")
    hint = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated
    once = rows.where(F.col(key).isNotNull()).join(hint, key, "left_anti")
    return once.unionByName(latest(rows.join(hint, key, "left_semi"), key, order))


class Shelf:
    """One folder of tables.  ``embedder`` turns text into vectors, where there is one; ``segmenter`` cuts what has no spaces."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike, name: str | None = None, embedder=None, segmenter: Segmenter = PAIRS):
        ship_package(spark)
        self.spark, self.path, self.embedder, self.segmenter = spark, str(path).rstrip("/"), embedder, segmenter
        self.name = name or os.path.basename(self.path) or "default"
        self.files = Files(spark)
        self.files.make(self._in("archives"))
        self._index: tuple[int, FullTextIndex] | None = None
        self._stamp = 0

    # tables

    def _in(self, *parts: str) -> str:
        return "/".join([self.path, *parts])

    def _complete(self, folder: str, prefix: str, last: str = "") -> list[tuple[int, str]]:
        """(number, path) of the folders ``<prefix><number>`` whose writing, of ``last`` in them, has ended, the newest last."""
        found = [(int(e.name.removeprefix(prefix)), e.path) for e in self.files.list(folder) if e.is_folder and e.name.startswith(prefix) and e.name.removeprefix(prefix).isdigit()]
        return sorted((n, p) for n, p in found if self.files.exists(f"{p}{last}/_SUCCESS"))

    def _bases(self, table: str) -> list[tuple[int, str]]:
        return self._complete(self._in(table), "base-")

    def _batches(self, table: str, after: int = 0) -> list[tuple[int, str]]:
        return [(n, p) for n, p in self._complete(self._in(table, "log"), "") if n > after]

    def _now(self) -> int:
        """A number greater than all before it."""
        self._stamp = max(time.time_ns(), self._stamp + 1)
        return self._stamp

    def version(self) -> int:
        """The number of the last change; 0 for an empty shelf."""
        return max([0, *[n for t in KEY for n, _ in [*self._bases(t)[-1:], *self._batches(t)[-1:]]]])

    def _changes(self, table: str, after: int) -> DataFrame | None:
        """The newest state of every key changed after a version: ``op`` and the table's columns."""
        batches = self._batches(table, after)
        if not batches:
            return None
        log = self.spark.read.schema(LOG + COLUMNS[table]).parquet(*[p for _, p in batches])
        return latest(log, KEY[table], "seq").drop("seq")

    def table(self, table: str) -> DataFrame:
        """The current state of ``knowledge`` or ``statement``."""
        bases = self._bases(table)
        base = self.spark.read.schema(COLUMNS[table]).parquet(bases[-1][1]) if bases else None
        changed = self._changes(table, bases[-1][0] if bases else 0)
        if changed is None:
            return base if base is not None else self.spark.createDataFrame([], COLUMNS[table])
        put = changed.where(F.col("op") == "put").select(*_names(table))
        return put if base is None else base.join(changed.select(KEY[table]), KEY[table], "left_anti").select(*_names(table)).unionByName(put)

    @property
    def knowledge(self) -> DataFrame:
        return self.table("knowledge")

    @property
    def statement(self) -> DataFrame:
        return self.table("statement")

    def _append(self, table: str, rows: DataFrame, op: str = "put") -> None:
        seq = self._now()
        stamped = rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), *[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in _names(table)])
        wanted = self.spark.createDataFrame([], LOG + COLUMNS[table]).schema
        stamped.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(self._in(table, "log", str(seq)))

    def _write_base(self, table: str, rows: DataFrame, version: int) -> None:
        wanted = self.spark.createDataFrame([], COLUMNS[table]).schema
        typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
        typed.repartitionByRange(*ORDER[table]).sortWithinPartitions(*ORDER[table]).write.parquet(self._in(table, f"base-{version}"))

    def load(self, table: str, rows: DataFrame, order: str = "created_at") -> None:
        """Fill an empty table: of rows with the same key the one of the greatest ``order`` counts; null keys are left out."""
        if self._bases(table) or self._batches(table):
            raise AlreadyExists(f"{table} is not empty")
        self._write_base(table, newest(rows, KEY[table], order), self._now())

    def _one(self, table: str, values: dict) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(n) for n in _names(table))], COLUMNS[table])

    # rows

    def get(self, table: str, key: str):
        """A row by its key, or None; the key's filter reaches the Parquet scan."""
        return self.table(table).where(F.col(KEY[table]) == key).first()

    def create_many(self, table: str, rows: DataFrame, skip_existing: bool = False) -> None:
        """Append rows of new keys.  A key that exists, or occurs twice, is an error unless it is to be skipped."""
        key = KEY[table]
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.lit(datetime.now(UTC).replace(tzinfo=None)))
        known = self.table(table).select(key)
        if skip_existing:
            self._append(table, rows.dropDuplicates([key]).join(known, key, "left_anti"))
            return
        twice = rows.groupBy(key).count().where("count > 1").select(key)
        clash = rows.select(key).join(known, key, "left_semi").unionByName(twice).first()
        if clash:
            raise AlreadyExists(f"{table} {clash[0]!r} exists")
        self._append(table, rows)

    def put_many(self, table: str, rows: DataFrame) -> None:
        """Write whole states of keys, known or new; of a repeated key the greatest row counts, null keys are left out."""
        key = KEY[table]
        self._append(table, latest(rows.withColumn("_same", F.lit(0)), key, "_same").drop("_same"))

    def _embed(self, text: str) -> list[float] | None:
        """The vector of a text; None where there is no model or it fails."""
        try:
            return vector_literal(self.embedder.embed(text)) if self.embedder else None
        except ModelUnavailable:
            return None

    def create_knowledge(self, name: str, content: Content):
        values = {"name": name, "content": content.to_json(), "created_at": datetime.now(UTC).replace(tzinfo=None), "embedding": self._embed(content.embedding_text(name))}
        self.create_many("knowledge", self._one("knowledge", values))
        return self.get("knowledge", name)

    def create_statement(self, subject: str, predicate: str, obj: str, content: Content, tr_start: datetime | None = None, tr_end: datetime | None = None):
        key = triple_key(subject, predicate, obj)
        values = {"triple": key, "subject": subject, "predicate": predicate, "object": obj, "content": content.to_json(), "tr_start": tr_start, "tr_end": tr_end}
        values |= {"created_at": datetime.now(UTC).replace(tzinfo=None), "embedding": self._embed(content.embedding_text(key))}
        self.create_many("statement", self._one("statement", values))
        return self.get("statement", key)

    def update(self, table: str, key: str, content: Content, **changes):
        """New content for a key; its creation time stays, and so does its vector where no model gives a new one."""
        row = self.get(table, key)
        if row is None:
            raise NotFound(f"no {table} {key!r}")
        vector = self._embed(content.embedding_text(key))
        values = row.asDict() | {"content": content.to_json()} | changes
        self._append(table, self._one(table, values | ({"embedding": vector} if vector is not None else {})))
        return self.get(table, key)

    def delete(self, table: str, key: str) -> None:
        if self.get(table, key) is None:
            raise NotFound(f"no {table} {key!r}")
        self._append(table, self._one(table, {KEY[table]: key}), "delete")

    def delete_many(self, table: str, keys: DataFrame) -> None:
        """Delete all keys of a one-column table; unknown ones are ignored."""
        self._append(table, keys.select(F.col(keys.columns[0]).alias(KEY[table])).distinct(), "delete")

    def set_embedding(self, table: str, key: str, vector: Sequence[float] | None) -> None:
        """Store or, with None, clear a vector; an unknown key changes nothing."""
        row = self.get(table, key)
        if row is not None:
            self._append(table, self._one(table, row.asDict() | {"embedding": None if vector is None else vector_literal(vector)}))

    def with_embeddings(self, table: str) -> DataFrame:
        return self.table(table).where(F.col("embedding").isNotNull())

    def without_embeddings(self, table: str) -> DataFrame:
        return self.table(table).where(F.col("embedding").isNull())

    def backfill(self) -> dict[str, int]:
        """Embed every row that has no vector: how many were created, were there before, or failed.

        ``skipped`` counts knowledge rows only.  Executors embed partitions in batches; a row whose
        text cannot be embedded counts as an error and stays without a vector.
        """
        if self.embedder is None or not getattr(self.embedder, "available", True):
            raise ModelUnavailable("no embedding model")
        totals = {"created": 0, "skipped": self.with_embeddings("knowledge").count(), "errors": 0}
        for table, key in KEY.items():
            missing = self.without_embeddings(table)
            text = embedding_text(F.col(key), F.col("content"))
            valid = F.get_json_object("content", "$.tags").isNotNull()
            rows = missing.withColumn("_text", F.when(valid, text))
            done = materialise(embed_column(rows, "_text", self.embedder).drop("_text"), "embedded")
            counts = done.agg(F.count("embedding"), F.count(F.lit(1))).first()
            totals["created"] += counts[0]
            totals["errors"] += counts[1] - counts[0]
            if counts[0]:
                self._append(table, done.where(F.col("embedding").isNotNull()))
        return totals

    def compact(self) -> None:
        """Write the current state of both tables as their new base.

        What the new base replaces is kept until the next time, for queries that are still running.
        """
        for table in KEY:
            bases, batches = self._bases(table), self._batches(table)
            if not batches or bases and batches[-1][0] <= bases[-1][0]:
                continue
            self._write_base(table, self.table(table), batches[-1][0])
            kept = bases[-1][0] if bases else 0
            for number, path in [*bases[:-1], *[x for x in batches if x[0] <= kept]]:
                self.files.delete(path)
        if self._complete(self.path, "index-", "/stats"):
            self.rebuild_index()

    # queries

    def tables(self) -> Tables:
        return Tables(self.knowledge, self.statement, self.full_text, self.embedder)

    def _docs(self, of=None) -> DataFrame:
        of = of or self.table
        return knowledge_docs(of("knowledge")).unionByName(statement_docs(of("statement")))

    def full_text(self) -> FullTextIndex:
        """The search index of the current state: the one kept with the shelf, brought up to date.

        It is written at the first search, and again when much has changed since.
        """
        version = self.version()
        if self._index and self._index[0] == version:
            return self._index[1]
        kept = self._complete(self.path, "index-", "/stats")
        # Batches from before the last base but one are gone.
        known_since = max([0, *[self._bases(t)[-2][0] for t in KEY if len(self._bases(t)) > 1]])
        if not kept or kept[-1][0] < known_since:
            return self.rebuild_index()
        number, path = kept[-1]
        index = FullTextIndex.load(self.spark, path, segmenter=self.segmenter)
        if number < version:
            changes = {t: self._changes(t, number) for t in KEY}
            changed = [c.select(F.lit(t).alias("catalog"), F.col(KEY[t]).alias("key"), "op", "content") for t, c in changes.items() if c is not None]
            rows = materialise(changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1]), "changed") if changed else None
            n = rows.count() if rows is not None else 0
            if n > max(STALE_ROWS, STALE_SHARE * index.stats.first()["n_docs"]):
                return self.rebuild_index()
            if n:
                index = index.changed(rows.select("catalog", "key"), rows.where(F.col("op") == "put").select("catalog", "key", "content"))
        self._index = version, index
        return index

    def rebuild_index(self) -> FullTextIndex:
        """Write the search index of the current state to the shelf."""
        version, kept = self.version(), self._complete(self.path, "index-", "/stats")
        path = self._in(f"index-{version}")
        if not kept or kept[-1][0] < version:
            FullTextIndex.build(self._docs(), segmenter=self.segmenter).save(path)
            for _, old in kept[:-1]:
                self.files.delete(old)
        self._index = version, FullTextIndex.load(self.spark, path, segmenter=self.segmenter)
        return self._index[1]

    def query(self, expression) -> DataFrame:
        return execute(expression, self.tables())

    def answer(self, expression) -> Answer:
        """The rows of a query with their number."""
        return Answer(self.query(expression))

    def search(self, text: str, catalog: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return self.full_text().search(text, catalog, limit, offset)

    def similar(self, text: str, target: str = "knowledge", limit: int = 10) -> DataFrame:
        tables = self.tables()
        return similar(tables, tables.vector(text), target, limit)

    # archives

    def _inside(self, relative: str) -> str:
        """The path of an archived file; ``relative`` may not lead out of the archive."""
        plain = os.path.normpath(relative)
        if not relative or os.path.isabs(plain) or plain.split("/")[0] in ("..", "."):
            raise ValidationError(f"{relative!r} is outside the archive")
        return self._in("archives", plain)

    def store_archive(self, source: str | os.PathLike, relative: str) -> str:
        target = self._inside(relative)
        self.files.upload(source, target)
        return target

    def archive_path(self, relative: str) -> str | None:
        full = self._inside(relative)
        return full if self.files.exists(full) else None

    def list_archives(self) -> list[str]:
        return [e.name for e in self.files.walk(self._in("archives"))]

    def archive_files(self) -> DataFrame:
        """``path, modificationTime, length`` of archived files, without reading them."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self._in("archives")).select("path", "modificationTime", "length")

    def export(self, destination: str | os.PathLike) -> None:
        """Write the current tables and copy the archives; settings, models and index stay behind.

        The destination is a shelf; a state that is there already is replaced by a newer base.
        """
        out = Shelf(self.spark, destination)
        for table in KEY:
            out._write_base(table, self.table(table), out._now())
        for entry in self.files.walk(self._in("archives")):
            self.files.copy(entry.path, out._inside(entry.name))


def embed_column(rows: DataFrame, text: str, embedder) -> DataFrame:
    """``rows`` with column ``embedding`` from a text column, in batches; null where there is no text, or no vector can be had for it.

    Faults of other kinds than a missing model or a text it refuses end the query.
    """
    others = [c for c in rows.columns if c != "embedding"]
    fields = [f for f in rows.schema if f.name != "embedding"]
    schema = StructType([*fields, StructField("embedding", ArrayType(FloatType()))])

    def one(value: str) -> list[float] | None:
        try:
            return vector_literal(embedder.embed(value))
        except (ModelUnavailable, ValidationError):
            return None

    def several(values: list[str]) -> list[list[float] | None]:
        """One call for the batch where the embedder has it; if that fails, text by text, so that one bad text costs itself only."""
        if hasattr(embedder, "embed_batch"):
            try:
                return [vector_literal(v) for v in embedder.embed_batch(values)]
            except (ModelUnavailable, ValidationError):
                pass
        return [one(v) for v in values]

    def run(frames):
        for frame in frames:
            there = [i for i, value in enumerate(frame[text]) if value is not None]
            vectors: list[list[float] | None] = [None] * len(frame)
            for a in range(0, len(there), EMBED_BATCH):
                part = there[a : a + EMBED_BATCH]
                for i, vector in zip(part, several([frame[text].iloc[i] for i in part])):
                    vectors[i] = vector
            yield frame[others].assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    return rows.select(*others).mapInPandas(run, schema)
