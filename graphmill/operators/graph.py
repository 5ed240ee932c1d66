"""Bounded walks over statements, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import materialise

#: Nodes of a level that are looked up by value, which reaches the scan; up to so many the driver holds them; beyond, the frontier is a table.
FEW, HELD = 1_000, 50_000
#: Frontiers are broadcast up to this many nodes; beyond, the join shuffles.
BROADCAST_NODES = 500_000


def k_hop(statements: DataFrame, start: str, predicate: str | None, depth: int) -> DataFrame:
    """``triple, hops``: statements within ``depth`` forward steps of ``start``, with the fewest steps.

    Each level looks up the frontier's nodes, each node once, so cycles and parallel paths add no
    rows.  With ``predicate`` every step must have it.  A small frontier is a filter on the subject,
    which skips the files and row groups of a table in that order, one of up to ``HELD`` nodes a
    broadcast list; a larger one is written down, counted and joined.
    """
    edges = statements.select("triple", "subject", "predicate", "object").where(F.col("triple").isNotNull())
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    edges = edges.select("triple", F.col("subject").alias("_from"), F.col("object").alias("_to"))
    level = edges.where(F.col("_from") == start)
    reached = level.select("triple", F.lit(1).alias("hops"))
    spark = statements.sparkSession
    seen = {start}
    visited: DataFrame | None = None
    for hop in range(2, depth + 1):
        nodes = level.select(F.col("_to").alias("_from")).where(F.col("_from").isNotNull()).distinct()
        some = None
        if visited is None:
            some = [r[0] for r in nodes.limit(HELD + 1).collect()] if len(seen) <= HELD else []
            some = [v for v in some if v not in seen] if len(some) <= HELD and len(seen) <= HELD else None
        else:
            nodes = nodes.join(visited, "_from", "left_anti")
        if some is not None:
            if not some:
                break
            seen.update(some)
            level = edges.where(F.col("_from").isin(some)) if len(some) <= FEW else edges.join(F.broadcast(spark.createDataFrame([(v,) for v in some], "_from string")), "_from", "left_semi")
        else:
            if visited is None:
                visited = spark.createDataFrame([(v,) for v in seen], "_from string")
                nodes = nodes.join(F.broadcast(visited), "_from", "left_anti")
            frontier = materialise(nodes, "frontier")
            n = frontier.count()
            if not n:
                break
            visited = visited.unionByName(frontier)
            level = materialise(edges.join(F.broadcast(frontier) if n <= BROADCAST_NODES else frontier, "_from", "left_semi"), "level")
        reached = reached.unionByName(level.select("triple", F.lit(hop).alias("hops")))
    return reached.groupBy("triple").agg(F.min("hops").alias("hops"))


def reachable(statements: DataFrame, start: str, predicate: str | None, depth: int) -> DataFrame:
    """The statements of :func:`k_hop` with all their columns and ``hops``."""
    return statements.join(k_hop(statements, start, predicate, depth), "triple")
