"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the same for all nodes of a component) of every node with a link to another.

    In each round every node hands its links to its least neighbour, and links
    within a node go; the rounds end when no link is left.  Nulls have no links; repeated links and
    links in both directions count once; a table without links gives no nodes.
    """
    x, y = F.col(a), F.col(b)
    edges = stored(links.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        step = stored(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("to")), "contraction")
        maps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = stored(moved.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Roots of the last round first: each earlier round's targets are looked up in what comes after it.
    known = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        above = known.select(F.col("node").alias("to"), F.col("root").alias("above"))
        known = step.join(above, "to", "left").select("node", F.coalesce("above", "to").alias("root"))
    if len(maps) > 1:
        known = stored(known, "components")
    return known
