"""Hits as a stream: running totals with watermarks, and placement of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.operators.placement import PlacementOptions, placements


def hit_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, node, hits, best) by tumbling windows of found_at; redeliveries of a hit within ``late`` count once."""
    once = stream.where("node is not null").withWatermark("found_at", late).dropDuplicatesWithinWatermark(["hit_id"])
    counts = once.groupBy(F.window("found_at", window), "node").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    return counts.select(F.col("window.start").alias("start"), "node", "hits", "best")


def place_stream(hits: DataFrame, queries: DataFrame, targets: DataFrame, path: str, checkpoint: str, options: PlacementOptions = PlacementOptions()):
    """Starts a query that places each micro-batch's queries and appends the placements to ``path``, tagged with the batch.

    Targets are fixed while the stream runs. A batch that is run again after a failure writes its own folder anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        placements(df, queries, targets, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
