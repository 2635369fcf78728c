"""Joins of spans of the same text that lie near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(a_start - b_end, b_start - a_end, F.lit(0))


def near_pairs(left: DataFrame, right: DataFrame, key: str, window: int) -> DataFrame:
    """Pairs of spans (``start``, ``end``) of one ``key`` at most ``window`` apart, with ``distance``; those of ``right`` as ``r_start``, ``r_end`` and ``r_`` before its other columns.

    Spans lie in bins of ``window`` characters and meet in the bins that both
    reach, so a long text is many groups; a pair counts in the first bin that
    both have.
    """
    bins = lambda a, z: F.sequence(F.floor(F.greatest(a, F.lit(0)) / window), F.floor(z / window))
    l = left.withColumn("_bin", F.explode(bins(F.col("start") - window, F.col("end") + window)))  # noqa: E741
    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key]).withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"))))
    first = F.greatest(F.floor(F.greatest(F.col("start") - window, F.lit(0)) / window), F.floor(F.col("r_start") / window))
    both = l.join(r, [key, "_bin"]).where(F.col("_bin") == first).drop("_bin")
    return both.withColumn("distance", gap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).where(F.col("distance") <= window)


def nearest(left: DataFrame, right: DataFrame, key: str, window: int, first: Column | None = None) -> DataFrame:
    """For each span of ``left`` the nearest of ``right``; ``first`` (of the pairs' columns) goes before the distance, ties go by ``r_start``.  No row where none is near."""
    own = [key, "start", "end"]
    order = [*([] if first is None else [first]), F.col("distance"), F.col("r_start"), F.col("r_end")]
    return near_pairs(left, right, key, window).withColumn("_rank", F.row_number().over(W.partitionBy(*own).orderBy(*order))).where("_rank = 1").drop("_rank")
