"""Continuous periods and gaps of overlapping time intervals.

Two-level merge.  A subject with more than ``rows_per_shard`` intervals is cut into time shards at
approximate quantiles of its interval starts; its intervals are clipped to the shards they touch,
a stretch that covers whole shards being kept once per pair of shards instead of once per row.
Each shard is merged on its own.  Coverage that touches a shard boundary is then stitched: of a
subject at most a few rows per shard take part in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.plans.shards import bounds_below, lower_bound, shard_bounds, upper_bound, with_bounds
from graphmill.session import materialise

#: Stands for "no end" inside the operator.
FOREVER = (1 << 63) - 1
ROWS_PER_SHARD = 25_000


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970-01-01 of the stored time, whatever the session's time zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(F.col(column))
    span = F.col(column) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), span)
    seconds = part("DAY").cast("bigint") * 86_400 + part("HOUR").cast("bigint") * 3_600 + part("MINUTE").cast("bigint") * 60
    return seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def covered(df: DataFrame, subject: str, start: str, end: str) -> DataFrame:
    """Rows ``_k, _lo, _hi`` that cover anything: start present, end later than it or absent (= for ever).

    A null subject belongs to nobody and covers nothing.  A start beyond the representable range
    cannot occur: both columns are timestamps.
    """
    rows = df.select(F.col(subject).alias("_k"), micros(df, start).alias("_lo"), micros(df, end).alias("_hi"))
    rows = rows.where(F.col("_k").isNotNull() & F.col("_lo").isNotNull() & (F.col("_hi").isNull() | (F.col("_hi") > F.col("_lo"))))
    return rows.withColumn("_hi", F.coalesce("_hi", F.lit(FOREVER)))


def _islands(pieces: DataFrame, by: list[str], keep: list[str] = []) -> DataFrame:
    """Merge pieces that overlap or touch within ``by``; ``keep`` columns are constant within it."""
    order = Window.partitionBy(*by).orderBy("_lo")
    before = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_new", F.when(before.isNull() | (F.col("_lo") > before), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.max(c).alias(c) for c in keep]).drop("_island")


def _local(rows: DataFrame, rows_per_shard: int) -> tuple[DataFrame, bool]:
    """Islands ``_k, _shard, _lo, _hi, _from, _to`` merged within each shard; whether any key was cut."""
    # Of intervals with the same start the longest says all; written once, for it is read several times.
    rows = materialise(rows.groupBy("_k", "_lo").agg(F.max("_hi").alias("_hi")), "intervals")
    bounds = shard_bounds(rows, ["_k"], "_lo", rows_per_shard)
    if bounds is None:
        none = F.lit(None).cast("bigint")
        return _islands(rows, ["_k"]).select("_k", F.lit(0).alias("_shard"), "_lo", "_hi", none.alias("_from"), none.alias("_to")), False
    placed = with_bounds(rows, bounds, ["_k"], "_lo").withColumns({"_first": bounds_below(F.col("_lo")), "_last": bounds_below(F.col("_hi"), inclusive=False)})
    clip = lambda shard: F.struct(
        shard.alias("_shard"),
        F.greatest("_lo", lower_bound(shard)).alias("_lo"),
        F.least("_hi", upper_bound(shard)).alias("_hi"),
        lower_bound(shard).alias("_from"),
        upper_bound(shard).alias("_to"),
    )
    ends = F.when(F.col("_first") == F.col("_last"), F.array(clip(F.col("_first")))).otherwise(F.array(clip(F.col("_first")), clip(F.col("_last"))))
    clipped = placed.select("_k", F.inline(ends))
    # Shards that a row covers from bound to bound: one row for each first such shard, then one for each shard.
    runs = placed.where(F.col("_last") > F.col("_first") + 1).groupBy("_k", "_first").agg(F.max("_last").alias("_last"))
    full = runs.select("_k", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)).alias("_shard")).distinct()
    shard = F.col("_shard")
    full = with_bounds(full, bounds, ["_k"], "_shard").select("_k", "_shard", lower_bound(shard).alias("_lo"), upper_bound(shard).alias("_hi"), lower_bound(shard).alias("_from"), upper_bound(shard).alias("_to"))
    pieces = clipped.unionByName(full).groupBy("_k", "_shard", "_lo").agg(F.max("_hi").alias("_hi"), F.max("_from").alias("_from"), F.max("_to").alias("_to"))
    return _islands(pieces, ["_k", "_shard"], ["_from", "_to"]), True


def merge_intervals(df: DataFrame, subject: str = "subject", start: str = "tr_start", end: str = "tr_end", rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Continuous periods: ``<subject>, period_start_us, period_end_us`` (null end = for ever).

    Intervals are half open; those that touch are one period.  Rows with a null subject, a null
    start, or an end at or before the start cover nothing; repeated rows change nothing; an empty
    table gives no period.  Other columns, whatever their names, are ignored.
    """
    islands, cut = _local(covered(df, subject, start, end), rows_per_shard)
    if cut:
        touching = F.coalesce(F.col("_lo") == F.col("_from"), F.lit(False)) | F.coalesce(F.col("_hi") == F.col("_to"), F.lit(False))
        inner = islands.where(~touching).select("_k", "_lo", "_hi")
        islands = inner.unionByName(_islands(islands.where(touching), ["_k"]))
    ends = F.when(F.col("_hi") != FOREVER, F.col("_hi"))
    return islands.select(F.col("_k").alias(subject), F.col("_lo").alias("period_start_us"), ends.alias("period_end_us"))


def interval_gaps(df: DataFrame, subject: str = "subject", start: str = "tr_start", end: str = "tr_end", rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Holes between a subject's first start and last end: ``<subject>, gap_start_us, gap_end_us``.

    Inputs as for :func:`merge_intervals`.  Holes inside a shard come from its own islands, holes
    across shards from one row per shard, so no subject's periods meet in one task.
    """
    islands, cut = _local(covered(df, subject, start, end), rows_per_shard)
    order = Window.partitionBy("_k", "_shard").orderBy("_lo")
    gaps = islands.select("_k", F.lag("_hi").over(order).alias("_a"), F.col("_lo").alias("_b")).where(F.col("_a").isNotNull())
    if cut:
        edges = islands.groupBy("_k", "_shard").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        before = F.max("_hi").over(Window.partitionBy("_k").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
        gaps = gaps.unionByName(edges.select("_k", before.alias("_a"), F.col("_lo").alias("_b")).where(F.col("_b") > F.col("_a")))
    return gaps.select(F.col("_k").alias(subject), F.col("_a").alias("gap_start_us"), F.col("_b").alias("gap_end_us"))
