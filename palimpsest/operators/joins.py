"""Joins for keys that are often unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that rows without a key are dealt to.
SPREAD = 1_000_000


def left_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on ``key`` that deals rows with a null key evenly: a plain one sends them all to one task.

    Null keys match nothing, as in any join.
    """
    spread = F.when(F.col(key).isNull(), F.expr(f"cast(1 + rand(3) * {SPREAD} as int)")).otherwise(F.lit(0))
    own = left.withColumns({"_known": F.coalesce(key, F.lit(0)), "_spread": spread})
    other = right.where(F.col(key).isNotNull()).withColumn("_spread", F.lit(0)).withColumnRenamed(key, "_known")
    return own.join(other, ["_known", "_spread"], "left").drop("_known", "_spread")
