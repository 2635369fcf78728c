"""Raw inputs by content, dumps with counts, and event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``content_hash``, ``byte_size``, ``content``, ``storage_path`` of files."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("content_hash"), F.col("length").alias("byte_size"), "content", F.col("path").alias("storage_path"))


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Of the incoming, each content once, if it isn't stored yet; append these."""
    first = incoming.groupBy("content_hash").agg(F.min("storage_path").alias("storage_path"))
    return incoming.join(first, ["content_hash", "storage_path"], "left_semi").join(stored.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def dump(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def reconcile(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """``table``, ``n_source``, ``n_dump``, ``equal``: rows of each table against its dump."""
    out = None
    for name, df in tables.items():
        count = F.count(F.lit(1)).alias("n")
        both = compared(name, df.agg(count), spark.read.parquet(f"{path}/{name}").agg(count))
        out = both if out is None else out.unionByName(both)
    return out


def compared(name: str, source: DataFrame, dump: DataFrame) -> DataFrame:
    """One row of :func:`reconcile`, from two counts ``n``."""
    a, b = source.select(F.lit(name).alias("table"), F.col("n").alias("n_source")), dump.select(F.lit(name).alias("table"), F.col("n").alias("n_dump"))
    return a.join(b, "table").withColumn("equal", F.expr("n_source = n_dump"))


EVENT = "run_id string, seq long, type string, text string, name string, message string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON events; an error's message becomes its text."""
    d = spark.read.schema(EVENT).json(path)
    return d.select("run_id", "seq", "type", F.coalesce("text", "message", "name").alias("text"))
