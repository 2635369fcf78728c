"""Point-in-time queries over versions with effective ranges.

``versions`` has ``version_id``, ``node_id``, ``effective_from``,
``effective_to`` (null: open), ``review_status`` and more.  A range is closed
at its start and open at its end.  Of several versions that fit, the one with
the latest start counts, then the one with the greatest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

APPROVED = "approved"


def visible(include_pending: bool = False) -> Column:
    """Approved only; with ``include_pending`` any status, rejected ones too."""
    return F.lit(True) if include_pending else F.col("review_status") == APPROVED


def is_current(include_pending: bool = False) -> Column:
    return F.col("effective_to").isNull() & visible(include_pending)


def latest(versions: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the latest start, then the greatest id."""
    w = W.partitionBy(*keys).orderBy(F.desc("effective_from"), F.desc("version_id"))
    return versions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def current_versions(versions: DataFrame, include_pending: bool = False) -> DataFrame:
    return latest(versions.where(is_current(include_pending)), "node_id")


def history(versions: DataFrame, node_id: int | None = None, include_pending: bool = False) -> DataFrame:
    """Visible versions of a node (or of all), the newest first, with their place."""
    some = versions.where(visible(include_pending))
    some = some if node_id is None else some.where(F.col("node_id") == node_id)
    return some.withColumn("place", F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("effective_from"), F.desc("version_id"))))


def in_force(day: Column) -> Column:
    return (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day))


def versions_at(versions: DataFrame, probes: DataFrame, include_pending: bool = False) -> DataFrame:
    """For each probe (``node_id``, ``day``) the version then in force; no row where there is none.

    An equality join on the node with the range as its other condition: no
    probe meets versions of another node.
    """
    p = probes.select(F.col("node_id"), F.col("day"))
    return latest(p.join(versions.where(visible(include_pending)), "node_id").where(in_force(F.col("day"))), "node_id", "day")


def recent_amendments(nodes: DataFrame, versions: DataFrame, since: Column, limit: int = 100, include_pending: bool = False) -> DataFrame:
    """Visible versions that start on or after ``since``, the newest first, and what they did.

    The limit comes before the classification.  *repealed*: closed, and its
    node is flagged; *amended*: the node has an earlier version of any status;
    else *new*.  The first start of each node comes from one aggregation over
    the nodes at hand, in place of a look-up for each row.
    """
    top = versions.where(visible(include_pending) & (F.col("effective_from") >= since)).orderBy(F.desc("effective_from"), F.desc("version_id")).limit(limit)
    own = top.select("node_id").distinct()
    first = versions.join(F.broadcast(own), "node_id", "left_semi").groupBy("node_id").agg(F.min("effective_from").alias("first_from"))
    kind = F.when(F.col("is_repealed") & F.col("effective_to").isNotNull(), "repealed").when(F.col("first_from") < F.col("effective_from"), "amended").otherwise("new")
    return top.join(first, "node_id").join(nodes.select("node_id", "path", "is_repealed"), "node_id").withColumn("kind", kind)


def review(versions: DataFrame, version_ids: DataFrame, to_status: str) -> DataFrame:
    """Move the pending ones among ``version_ids`` to ``to_status``; adds ``review_outcome`` (changed, skipped, or null if not asked for)."""
    asked = version_ids.select("version_id").distinct().withColumn("_asked", F.lit(True))
    v = versions.join(asked, "version_id", "left")
    pending = F.col("_asked") & (F.col("review_status") == "pending")
    outcome = F.when(pending, "changed").when(F.col("_asked"), "skipped")
    return v.withColumn("review_outcome", outcome).withColumn("review_status", F.when(F.col("review_outcome") == "changed", F.lit(to_status)).otherwise(F.col("review_status"))).drop("_asked")
