"""Trees of any depth from parent links: ancestors, breadcrumbs, inherited values, subtree counts.

Pointers are doubled: after k rounds a node knows its ancestors up to 2^k
levels above, so a tree of n levels takes log2(n) joins.  Nodes that never
come to a root are on a cycle or below one; they have no ancestors here and
are told apart.  A parent that isn't in the table makes its child a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.scratch import stored

#: Levels beyond which a chain of parents counts as a cycle.
MOST_LEVELS = 4_096


def rooted(nodes: DataFrame) -> DataFrame:
    """``node_id``, ``parent_id`` (null for roots and where the parent is unknown), ``root_id`` (null: on a cycle, or below one).

    ``nodes`` has ``node_id``, each once, and ``parent_id``; null ids are left out.
    """
    own = nodes.where("node_id is not null").select("node_id", F.when(F.col("parent_id") != F.col("node_id"), F.col("parent_id")).alias("parent_id"), F.coalesce(F.col("parent_id") == F.col("node_id"), F.lit(False)).alias("_loop"))
    there = own.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_there"))
    base = own.join(there, "parent_id", "left").select("node_id", F.when(F.col("_there"), F.col("parent_id")).alias("parent_id"), "_loop")
    # A node that is its own parent is a cycle of one.
    state = stored(base.select("node_id", "parent_id", F.when(F.col("_loop"), F.col("node_id")).otherwise(F.coalesce("parent_id", "node_id")).alias("at"), (F.col("parent_id").isNull() & ~F.col("_loop")).alias("done")), "pointers")
    levels = 1
    while levels < MOST_LEVELS and not state.where("not done").isEmpty():
        above = state.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        todo = state.where("not done").join(above, "at").select("node_id", "parent_id", F.col("_at").alias("at"), F.col("_done").alias("done"))
        state = stored(state.where("done").unionByName(todo), "pointers")
        levels *= 2
    return state.select("node_id", "parent_id", F.when(F.col("done"), F.col("at")).alias("root_id"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``node_id``, ``ancestor_id``, ``distance`` (0: itself) of all nodes that have a root."""
    sound = stored(rooted(nodes).where("root_id is not null"), "rooted")
    jump = sound.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    known = stored(sound.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")), "ancestors")
    while not jump.isEmpty():
        # known: up to 2^k - 1 levels above; jump: exactly 2^k.
        step = known.withColumnRenamed("node_id", "_mid").join(jump.select("node_id", F.col("ancestor_id").alias("_mid"), F.col("distance").alias("_far")), "_mid")
        known = stored(known.unionByName(step.select("node_id", "ancestor_id", (F.col("distance") + F.col("_far")).alias("distance"))), "ancestors")
        far = jump.select(F.col("node_id").alias("_mid"), F.col("ancestor_id").alias("_top"), F.col("distance").alias("_far"))
        jump = stored(jump.join(far, F.col("ancestor_id") == F.col("_mid")).select("node_id", F.col("_top").alias("ancestor_id"), (F.col("distance") + F.col("_far")).alias("distance")), "jumps")
    return known


def hierarchy(nodes: DataFrame, label: str, value: str) -> DataFrame:
    """``node_id``, ``cyclic``, ``depth``, ``breadcrumb`` (labels from the root down), ``inherited`` (the nearest ``value`` that isn't null, its own first), ``n_below``.

    A cyclic node has nulls.  A breadcrumb is as long as the node is deep, and
    counts below a node are summed before they move, so a root with all nodes
    below it is no hot group.
    """
    pairs = ancestors(nodes)
    named = pairs.join(nodes.select(F.col("node_id").alias("ancestor_id"), F.col(label).alias("_label"), F.col(value).alias("_value")), "ancestor_id")
    up = named.groupBy("node_id").agg(
        F.max("distance").cast("long").alias("depth"),
        F.transform(F.sort_array(F.collect_list(F.struct("distance", "_label")), asc=False), lambda x: x["_label"]).alias("breadcrumb"),
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("distance"))).alias("inherited"),
    )
    down = pairs.where("distance > 0").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_below"))
    every = nodes.where("node_id is not null").select("node_id").join(up, "node_id", "left").join(down, "node_id", "left")
    return every.select("node_id", F.col("depth").isNull().alias("cyclic"), "depth", "breadcrumb", "inherited", F.when(F.col("depth").isNotNull(), F.coalesce("n_below", F.lit(0))).alias("n_below"))
