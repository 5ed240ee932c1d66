"""One ranking from several scores by Borda count.

Within a group every score is turned into competition ranks, equal scores sharing the mean of the
places they take.  Items without a score share the mean of the places left after those with one,
so they stand below all of them.  An item's points are the weighted sum of (N - rank) over the
scores, N being the number of items of the group; ties go to the smaller identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.plans.shards import attach, row_numbers, running_totals
from graphmill.session import materialise

ROWS_PER_SHARD = 25_000


def mean_ranks(scored: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``_g, _v`` (a score for each item) to ``_g, _v, _c, _rank``: one row per different score of a group, with its items.

    Ranks rise from the smallest score; equal ones share the mean place.  Scores are counted before
    they are ordered, and a group with many different scores is ordered in shards, so the size of a
    group does not matter.
    """
    values = scored.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(values, ["_g"], "_v", "_c", rows_per_shard)
    return placed.select("_g", "_v", "_c", (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias("_rank"))


def borda(scores: list[tuple[DataFrame, Column, Column, Column]], weights: list[float] | None = None, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Points of every item: ``group, item, points, found_in`` (how many scores it has).

    ``scores``: for each score its table and column expressions for group, item and value, the
    smaller value being the better (negate a score of which more is better).  Rows with a null
    group or item are left out.  A null or NaN value is no score, yet its item takes part.  Of an
    item's repeated rows the best value counts.  Tables may be empty, and groups may lack a score
    altogether: all their items then share the middle place.
    """
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores):
        raise ValueError("one weight for each score")
    long = []
    for i, (table, group, item, value) in enumerate(scores):
        value = value.cast("double")
        rows = table.select(group.cast("string").alias("_g"), item.cast("string").alias("_item"), F.when(~F.isnan(value), value + F.lit(0.0)).alias("_v"))
        long.append(rows.where(F.col("_g").isNotNull() & F.col("_item").isNotNull()).select("_g", "_item", *[(F.col("_v") if i == j else F.lit(None).cast("double")).alias(f"_v{j}") for j in range(len(scores))]))
    items = reduce(DataFrame.unionByName, long).groupBy("_g", "_item").agg(*[F.min(f"_v{j}").alias(f"_v{j}") for j in range(len(scores))])
    items = materialise(items, "items")  # read by the sizes, every score's ranks and the sum
    sizes = items.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"_v{j}").alias(f"_n{j}") for j in range(len(scores))])
    points, found = F.lit(0.0), F.lit(0)
    ranked = attach(items, sizes, ["_g"], "_n", "_item")
    for j, weight in enumerate(weights):
        ranks = mean_ranks(items.where(F.col(f"_v{j}").isNotNull()).select("_g", F.col(f"_v{j}").alias("_v")), rows_per_shard)
        ranks = ranks.select("_g", F.col("_v").alias(f"_v{j}"), F.col("_c").alias(f"_c{j}"), F.col("_rank").alias(f"_r{j}"))
        ranked = attach(ranked, ranks, ["_g", f"_v{j}"], f"_c{j}", "_item")
        missing = (F.col(f"_n{j}") + 1 + F.col("_n")) / 2.0
        points = points + F.lit(float(weight)) * (F.col("_n") - F.coalesce(f"_r{j}", missing))
        found = found + F.col(f"_v{j}").isNotNull().cast("int")
    return ranked.select(F.col("_g").alias("group"), F.col("_item").alias("item"), points.alias("points"), found.alias("found_in"))


def first_of(ranking: DataFrame) -> DataFrame:
    """The first item of each group: most points, of equals the smaller identifier."""
    best = ranking.groupBy("group").agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("item").alias("item"))).alias("b"))
    return best.select("group", F.col("b.item").alias("item"), (-F.col("b.p")).alias("points"))


def positions(ranking: DataFrame) -> DataFrame:
    """The whole ranking with its place in the group: ``group, item, points, found_in, place``.

    Places count items with more points, and among equal points items with a smaller identifier; a
    large group is numbered in stretches.
    """
    return row_numbers(ranking, ["group"], [F.desc("points"), F.col("item")], "place")
