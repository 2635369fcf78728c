"""Links in HTML pages, in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: a link to a chapter's file.
CHAPTER_LINK = r"(?i)/docs/code/\d+/(\d+[A-Z]?)\.rtf"
ANY_LINK = r'href="([^"]+)"'
#: Pages, or runs of pages, that are counted together.
RUN = 1_000


def links(pages: DataFrame, pattern: str = ANY_LINK, key: str = "page_id") -> DataFrame:
    """``key``, ``pos``, ``slug`` of every match's first group."""
    return pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "slug"))


def first_appearances(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Each slug once, where it first appears over all pages.

    A minimum is aggregated in each task before the shuffle, so a link that
    every page has costs one row for each task.
    """
    return found.groupBy("slug").agg(F.min(F.struct(key, "pos")).alias("at")).select("slug", f"at.{key}", "at.pos")


def in_order(first: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds ``place`` by page (a whole number, null first) and position.

    Runs of :data:`RUN` pages are counted first; a window then holds the links of
    one run, and another the counts of up to :data:`RUN` runs.
    """
    run = F.coalesce(F.floor(F.col(key) / RUN), F.lit(-(2**60)))
    of_runs = W.partitionBy("_top").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = first.groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_top", F.floor(F.col("_run") / RUN))
    tops = runs.groupBy("_top").agg(F.sum("_n").alias("_n"))
    tops = tops.select("_top", (F.coalesce(F.sum("_n").over(W.orderBy("_top").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_above"))
    before = runs.withColumn("_before", F.coalesce(F.sum("_n").over(of_runs), F.lit(0))).join(tops, "_top").select("_run", (F.col("_above") + F.col("_before")).alias("_before"))
    ranked = first.withColumn("_run", run).join(before, "_run").withColumn("_rank", F.row_number().over(W.partitionBy("_run").orderBy(key, "pos")))
    return ranked.withColumn("place", F.col("_before") + F.col("_rank")).drop("_run", "_before", "_rank")
