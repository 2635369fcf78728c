"""Streaming forms of two batch jobs: quota counts and ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def quota_counts(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """``key``, ``day``, ``used`` of a stream of calls, by tumbling UTC days; calls later than ``late`` are left out."""
    return calls.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "key").agg(F.count(F.lit(1)).alias("used")).select("key", F.to_date("w.start").alias("day"), "used")


def write_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``apply`` with its number, which makes repeated batches recognisable."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
