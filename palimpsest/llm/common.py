"""What the document operators share: inputs, scratch tables, global order.

Every operator starts from :func:`documents_of`, which keeps only the columns
it needs under fixed names.  Extra columns of the input, whatever their names,
can therefore never clash with the operator's own; the ones named in ``carry``
travel along in one struct column ``carried``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` (bigint), ``text`` (string, null as empty), ``carried`` (struct, if asked for)."""
    cols = [docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")]
    if carry:
        cols.append(F.struct(*[docs[c].alias(c) for c in carry]).alias("carried"))
    return docs.select(*cols)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session.  Where it is unset, a session on one
    machine gets a temporary folder; on a cluster that is an error, since no
    executor would see the tables of another.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order_bounds(ids: DataFrame, col: str = "doc_id", rows_per_bucket: int = 2_000, most: int = 65_536) -> list[int]:
    """At most ``most`` ascending ids that cut the rows into even runs.

    Only these bounds reach the driver.  They are approximate quantiles, which
    affects how even the buckets are but no result.
    """
    n = ids.count()
    k = max(1, min(most, n // rows_per_bucket))
    if k == 1:
        return []
    cuts = ids.approxQuantile(col, [i / k for i in range(1, k)], max(0.2 / k, 1e-5))
    return sorted({int(x) for x in cuts})


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>: one literal in the plan, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def order_bucket(col: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``col``: buckets ascend with the id; null ids come first."""
    if not bounds:
        return F.lit(0)
    # Two levels of comparison keep this near 2 * sqrt(len(bounds)) steps a row.
    step = max(1, int(len(bounds) ** 0.5))
    at_most = lambda a: F.size(F.filter(a, lambda h: h <= col))
    g = at_most(long_array(bounds[::step]))
    return F.when(col.isNull() | (g == 0), F.lit(0)).otherwise((g - 1) * step + at_most(F.slice(long_array(bounds), (g - 1) * step + 1, step)))
