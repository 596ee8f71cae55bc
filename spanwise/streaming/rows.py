"""Interval operators on streams.

Operators that look at one row at a time (``bounds.outside_bounds``,
``windows.tile``, ``bounds.events``) run on a streaming frame as they are. What
needs a frame's other rows is joined to a stored target set here, or done batch
by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import floor_div, overlaps_expr


def overlaps_static(stream: DataFrame, targets: DataFrame, bin_width: int, by: Sequence[str] = ("grp",), slack: int = 0) -> DataFrame:
    """``idx, idx2`` of a stream's rows and stored targets, by bins of a fixed width.

    ``slack`` must not be negative. No state: each row is joined when it comes.
    """
    if slack < 0:
        raise ValueError("slack must not be negative")
    low, high = F.col("start") - slack, F.col("end") + slack
    right = targets.select(*by, F.col("idx").alias("idx2"), F.col("start").alias("start2"), F.col("end").alias("end2"))

    def bins(df: DataFrame, s, e) -> DataFrame:
        return df.withColumn("__bin", F.explode(F.sequence(floor_div(s, bin_width), floor_div(e - 1, bin_width))))

    joined = bins(stream, low, high).join(bins(right, F.col("start2"), F.col("end2")), [*by, "__bin"])
    once = F.col("__bin") == floor_div(F.greatest(low, F.col("start2")), bin_width)
    return joined.filter(once & overlaps_expr("start", "end", "start2", "end2", slack)).select("idx", "idx2")


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``operator(batch)`` of each micro-batch under ``path/batch=<number>``; a repeated batch replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
