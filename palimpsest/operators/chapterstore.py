"""A stored corpus that snapshots change in place, chapter by chapter.

Nodes and versions lie in folders for each generation, source, chapter and
bucket.  The newest manifest says which generation of each bucket counts, and
the greatest ids given so far.  An ingest reads the chapters that its snapshot
covers, writes the buckets that it changes as a new generation, and then
appends one manifest: until that is there, everything reads as before, and a
generation without a manifest is never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import ingest
from palimpsest.sources.scratch import stored

#: Sections of a bucket; a larger chapter is made with more buckets, so that one change never rewrites all of it.
BUCKET_ROWS = 100_000
UNIT = ["source", "chapter", "bucket"]


def _bucket(path: Column) -> Column:
    """Of a path in a chapter of ``buckets``; the chapter's own node is in the first."""
    return F.when(path == F.col("chapter"), F.lit(0)).otherwise(F.expr("cast(pmod(xxhash64(path), buckets) as int)"))


class ChapterStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _head(self) -> dict:
        """Of the newest manifest: its version, and the greatest ids so far."""
        return self.spark.read.parquet(f"{self.path}/manifests").groupBy("version").agg(F.max("top_node").alias("top_node"), F.max("top_version").alias("top_version")).orderBy(F.desc("version")).first().asDict()

    def units(self) -> DataFrame:
        """``source``, ``chapter``, ``bucket``, ``buckets``, ``generation`` of all that counts."""
        return self.spark.read.parquet(f"{self.path}/manifests").where(F.col("version") == self._head()["version"]).select(*UNIT, "buckets", "generation")

    def _commit(self, units: DataFrame, version: int, top_node: int, top_version: int) -> None:
        one = units.select(*UNIT, "buckets", "generation").withColumns({"version": F.lit(version), "top_node": F.lit(top_node).cast("long"), "top_version": F.lit(top_version).cast("long")})
        one.coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")

    def _read(self, table: str, units: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Rows of a table in some units (default: all).  The join with the units prunes folders before they are read."""
        every = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")
        # Folder names would be read as numbers where they look like it.
        kinds = {"source": "string", "chapter": "string", "bucket": "int", "generation": "int"}
        schema = ", ".join(f"`{c}` {kinds.get(c, t)}" for c, t in every.dtypes)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        wanted = (self.units() if units is None else units).select(*UNIT, "generation")
        return rows.join(wanted, [*UNIT, "generation"], "left_semi").drop(*{"bucket", "generation"}.difference(keep))

    def nodes(self, units: DataFrame | None = None) -> DataFrame:
        return self._read("nodes", units).drop("chapter")

    def versions(self, units: DataFrame | None = None) -> DataFrame:
        return self._read("versions", units).drop("source", "chapter")

    def _write(self, nodes: DataFrame, versions: DataFrame, buckets: DataFrame, generation: int, held: DataFrame | None = None, until: Column | None = None) -> DataFrame:
        """Write rows as a generation, each version beside its node; the units written.

        ``held`` are older versions with their unit, and rows without a
        ``version_id`` for the nodes whose open versions end at ``until``.  Both
        meet where the bucket is written, so a text moves once.
        """
        n = nodes.withColumn("chapter", F.coalesce("parent_path", "path")).join(buckets, ["source", "chapter"], "left").fillna(1, ["buckets"])
        n = n.withColumns({"bucket": _bucket(F.col("path")), "generation": F.lit(generation)})
        v = versions.join(n.select("node_id", *UNIT), "node_id")
        # A bucket is bounded, so one task may hold it; small ones share a task.
        if held is None:
            v = v.repartition(*UNIT)
        else:
            v = held.withColumn("_held", F.lit(True)).unionByName(v.withColumn("_held", F.lit(False)), allowMissingColumns=True).repartition(*UNIT)
            v = v.withColumn("_ends", F.max(F.col("version_id").isNull()).over(W.partitionBy(*UNIT, "node_id"))).where("version_id is not null")
            v = v.withColumn("effective_to", F.when(F.col("_ends") & F.col("_held") & F.col("effective_to").isNull(), until).otherwise(F.col("effective_to"))).drop("_ends", "_held")
        for name, rows in (("nodes", n.drop("buckets").repartition(*UNIT)), ("versions", v.withColumn("generation", F.lit(generation)))):
            rows.write.mode("append").partitionBy("generation", *UNIT).parquet(f"{self.path}/{name}")
        return n.select(*UNIT, "buckets", "generation").distinct()

    def create(self, nodes: DataFrame, versions: DataFrame) -> None:
        """A corpus of these nodes and versions; every version has a node."""
        nodes = stored(nodes, "nodes")
        sizes = nodes.groupBy("source", F.coalesce("parent_path", "path").alias("chapter")).agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("buckets"))
        old = versions if "enacted_by" in versions.columns else versions.withColumn("enacted_by", F.lit(None).cast("string"))
        units = self._write(nodes, old, sizes, 1)
        top = lambda d, c: d.agg(F.max(c).alias("m")).first()["m"] or 0
        self._commit(units, 1, top(nodes, "node_id"), top(versions, "version_id"))

    def apply(self, parsed: DataFrame, chapters: DataFrame, effective_from: Column) -> DataFrame:
        """Apply a snapshot, and return its changes; see :func:`ingest.apply_nodes` and :func:`ingest.apply_versions` for what they do."""
        head, units = self._head(), self.units()
        generation = head["version"] + 1
        parsed = parsed.withColumn("chapter", F.coalesce("chapter", text.chapter_of(F.col("path"))))
        asked = stored(parsed.select("source", "chapter").unionByName(chapters.select("source", "chapter")).distinct(), "asked")
        near = stored(units.join(asked, ["source", "chapter"], "left_semi"), "units")
        changes = stored(ingest.diff(parsed, chapters, self.nodes(near), self.versions(near)), "changes")

        # Chapters whose own node is new or changes, and buckets of sections that do.
        kept = [F.col("title").alias("heading"), F.coalesce("reserved", F.lit(False)).alias("flag")] if "reserved" in chapters.columns else [F.col("title").alias("heading"), F.lit(None).cast("boolean").alias("flag")]
        own = self.nodes(near.where("bucket = 0")).where("parent_path is null").select("source", F.col("path").alias("chapter"), F.col("heading").alias("was"), "is_repealed")
        tops = chapters.select("source", "chapter", *kept).join(own, ["source", "chapter"], "left").where(~F.col("heading").eqNullSafe(F.col("was")) | ~F.coalesce(F.col("flag") == F.col("is_repealed"), F.col("flag").isNull()))
        sizes = near.select("source", "chapter", "buckets").distinct()
        moved = changes.where("kind <> 'unchanged'").withColumn("chapter", text.chapter_of(F.col("path"))).join(sizes, ["source", "chapter"], "left").fillna(1, ["buckets"])
        touched = moved.select("source", "chapter", _bucket(F.col("path")).alias("bucket"), "buckets")
        touched = touched.unionByName(tops.join(sizes, ["source", "chapter"], "left").fillna(1, ["buckets"]).select("source", "chapter", F.lit(0).alias("bucket"), "buckets"))
        touched = stored(touched.distinct(), "touched")
        if touched.isEmpty():
            return changes

        old = near.join(touched, UNIT, "left_semi")
        titled = chapters.join(touched.where("bucket = 0"), ["source", "chapter"], "left_semi")
        nodes = stored(ingest.apply_nodes(self.nodes(old), parsed, titled, changes, above=head["top_node"]), "nodes-after")
        fresh = ingest.new_versions(nodes, parsed, changes, effective_from, head["top_version"]).drop(*ingest.KEY)
        ended = moved.where("kind in ('amended', 'repealed')").select("source", "chapter", _bucket(F.col("path")).alias("bucket"), "path")
        ended = ended.join(nodes.select("node_id", "source", "path"), ["source", "path"]).select("node_id", *UNIT)
        held = self._read("versions", old, keep=["bucket"]).unionByName(ended, allowMissingColumns=True)
        written = stored(self._write(nodes, fresh, sizes, generation, held, effective_from), "written")
        top = lambda d, c, at_least: max(at_least, d.agg(F.max(c).alias("m")).first()["m"] or 0)
        rest = units.join(written, UNIT, "left_anti")
        self._commit(rest.unionByName(written), generation, top(nodes, "node_id", head["top_node"]), top(self.versions(written), "version_id", head["top_version"]))
        return changes
