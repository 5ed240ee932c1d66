"""Streams of rows into a shelf.  An extension: nothing here is needed for queries over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphmill.plans.compile import KEY
from graphmill.sources.store import Shelf, newest


def ingest(rows: DataFrame, shelf: Shelf, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of ``knowledge`` or ``statement`` rows: the row of the latest ``created_at`` of a key wins.

    That holds within a batch and across batches: a late row that is not newer than what the shelf
    has is left out, and so is a batch that is delivered again after a failure.
    """
    key = KEY[table]

    def write(batch: DataFrame, number: int) -> None:
        there = shelf.table(table).select(key, F.struct("created_at").alias("_there"))
        rows = newest(batch, key, "created_at").join(there, key, "left")
        shelf._append(table, rows.where(F.col("_there").isNull() | F.coalesce(F.col("created_at") > F.col("_there.created_at"), F.col("created_at").isNotNull())).drop("_there"))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def activity(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, end, <kind>, n``: events per window and kind, closed once the watermark has passed."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = stamped.groupBy(F.window("_t", width), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")
