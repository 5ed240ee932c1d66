"""Ordered shards for hot keys: no key, however large, ends up in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import materialise

#: A broadcast table of shard bounds may take so many bytes; beyond, the join shuffles by key and salt.
BROADCAST_BYTES = 8 << 20
#: Tables of one row a key are broadcast up to this many rows; beyond, keys of so many rows and more are split.
BROADCAST_ROWS, HOT_ROWS = 200_000, 100_000
SALTS = 64


def shard_bounds(df: DataFrame, keys: list[str], value: str, rows_per_shard: int, max_shards: int = 20_000) -> DataFrame | None:
    """Cut points of ``value`` for every key with more than ``rows_per_shard`` rows.

    Returns a table ``keys, _bounds array<bigint>`` of hot keys only, or None where no key is hot.
    One map-side combined count finds the hot keys; their cut points are approximate quantiles,
    as many as the key's own rows ask for, whose error moves rows between shards but never changes
    a result.  ``max_shards`` bounds the length of ``_bounds``, not the rows: past it the shards grow.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.least(F.ceil(F.col("_n") / rows_per_shard), F.lit(max_shards)).cast("int")
    top, hot, total = counts.where(F.col("_n") > rows_per_shard).agg(F.max("_n"), F.count(F.lit(1)), F.sum(wanted)).first()
    if not hot:
        return None
    n = min(max_shards, math.ceil(top / rows_per_shard))
    cuts = [i / n for i in range(1, n)]
    few = counts.where(F.col("_n") > rows_per_shard).select(*keys, wanted.alias("_shards"))
    few = F.broadcast(few) if hot <= BROADCAST_ROWS else few
    quantiles = df.join(few, keys).groupBy(*keys, "_shards").agg(F.percentile_approx(value, cuts, max(10_000, 10 * n)).alias("_cuts"))
    # A key of fewer rows than the largest takes every so manieth of the quantiles.
    own = F.transform(F.sequence(F.lit(1), F.col("_shards") - 1), lambda i: F.get("_cuts", F.greatest(F.floor(i * n / F.col("_shards")).cast("int") - 1, F.lit(0))))
    bounds = materialise(quantiles.select(*keys, F.array_sort(F.array_distinct(own)).alias("_bounds")), "bounds")
    return F.broadcast(bounds) if total * 8 + hot * 64 <= BROADCAST_BYTES else bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def with_bounds(df: DataFrame, bounds: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``df`` with the ``_bounds`` of its keys; a table too large to broadcast is joined by a salt from ``spread`` as well."""
    if "_salt" not in bounds.columns:
        return df.join(bounds, keys, "left")
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(bounds, [*keys, "_salt"], "left").drop("_salt")


def bounds_below(value: Column, inclusive: bool = True) -> Column:
    """How many cut points are at or (not ``inclusive``) strictly below ``value``: the shard's number, by binary search."""
    size = F.size("_bounds")
    steps = F.array(*[F.lit(1 << i) for i in range(15, -1, -1)])

    def step(found: Column, width: Column) -> Column:
        cut = F.get("_bounds", found + width - 1)
        below = (cut <= value) if inclusive else (cut < value)
        return found + F.when((found + width <= size) & below, width).otherwise(0)

    return F.when(F.col("_bounds").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))


def lower_bound(shard: Column) -> Column:
    """First value of a shard; null for the first shard."""
    return F.when(shard > 0, F.get("_bounds", shard - 1))


def upper_bound(shard: Column) -> Column:
    """First value past a shard; null for the last."""
    return F.get("_bounds", shard)


def running_totals(counts: DataFrame, keys: list[str], value: str, weight: str, rows_per_shard: int = 25_000) -> DataFrame:
    """``counts`` with ``_upto``: the sum of ``weight`` over the key's rows up to this ``value``.

    Each (keys, value) occurs once.  A hot key is summed in ordered shards: their totals are added up
    first, one row for each shard, and every shard then runs on from what lies before it.
    """
    bounds = shard_bounds(counts, keys, value, rows_per_shard)
    if bounds is None:
        order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_upto", F.sum(weight).over(order))
    placed = with_bounds(counts, bounds, keys, value).withColumn("_shard", bounds_below(F.col(value))).drop("_bounds")
    sizes = placed.groupBy(*keys, "_shard").agg(F.sum(weight).alias("_size"))
    ahead = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select(*keys, "_shard", ahead.alias("_ahead")).where("_ahead is not null")
    order = Window.partitionBy(*keys, "_shard").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.coalesce("_ahead", F.lit(0)) + F.sum(weight).over(order)
    return placed.join(ahead, [*keys, "_shard"], "left").withColumn("_upto", upto).drop("_shard", "_ahead")


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: str) -> DataFrame:
    """Left join of ``right``, which has one row for each of ``keys`` and in ``weight`` its rows on the left.

    No key's rows meet in one task: a small ``right`` is broadcast; of a large one the keys with
    ``HOT_ROWS`` rows or more are (there are few of them), and their rows, as those with a null key,
    are spread by a hash of ``spread`` over the join of the others.
    """
    right = materialise(right, "right")
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, "left")
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(weight) >= HOT_ROWS).select(*keys, F.struct(*values).alias("_hot"))
    found = left.join(F.broadcast(hot), keys, "left")
    apart = F.col("_hot").isNotNull()
    for key in keys:
        apart = apart | F.col(key).isNull()
    found = found.withColumn("_salt", F.when(apart, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(0))
    rest = right.where(F.col(weight) < HOT_ROWS).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_rest"))
    joined = found.join(rest, [*keys, "_salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(F.col("_hot")[v], F.col("_rest")[v]).alias(v) for v in values])


def row_numbers(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each of ``groups`` by ``order``, which must settle every tie.

    Rows are range-partitioned by group and order, so a large group is cut into stretches; each is
    numbered on its own, on from what lies before it.
    """
    ranged = materialise(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select(*groups, "_part", ahead.alias("_ahead")).where("_ahead is not null")  # fewer than there are partitions
    within = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    numbered = ranged.withColumn(name, within).join(F.broadcast(ahead), [*groups, "_part"], "left")
    return numbered.withColumn(name, (F.col(name) + F.coalesce("_ahead", F.lit(0))).cast("int")).drop("_part", "_ahead")
