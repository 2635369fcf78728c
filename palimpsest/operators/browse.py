"""Browsing: sources, chapters, one chapter, one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators.temporal import current_versions, history


# The type at the top of a source, if it has it, and the types of entries, the first of which names them.
TOP_TYPE, ENTRY_TYPES, NO_LABEL = "chapter", ("rule", "section"), "Entries"


def typed_sources(sources: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """``source``, ``top_type``, ``n_chapters``, ``n_sections``, ``entry_label``, where nodes have a ``node_type``.

    ``types`` are (``source``, ``node_type``, ``level``, ``label``).  Chapters are
    nodes of the top type: *chapter*, or else the type of the least level.
    Entries are nodes of the entry types that the source has, not repealed.
    """
    label = lambda t: F.max(F.when(F.col("node_type") == t, F.col("label")))
    t = types.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("node_type") == TOP_TYPE, F.col("node_type"))), F.min_by("node_type", F.struct("level", "node_type"))).alias("top_type"),
        F.coalesce(*map(label, ENTRY_TYPES), F.lit(NO_LABEL)).alias("entry_label"),
    )
    n = nodes.groupBy("source", "node_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_repealed")).alias("n_live")).join(types.select("source", "node_type").distinct(), ["source", "node_type"], "left_semi")
    n = n.join(t.select("source", "top_type"), "source").groupBy("source").agg(F.sum(F.when(F.col("node_type") == F.col("top_type"), F.col("n"))).alias("n_chapters"), F.sum(F.when(F.col("node_type").isin(*ENTRY_TYPES), F.col("n_live"))).alias("n_sections"))
    out = sources.select("source").join(t, "source", "left").join(n, "source", "left").fillna(0, ["n_chapters", "n_sections"])
    return out.select("source", "top_type", "n_chapters", "n_sections", F.coalesce("entry_label", F.lit(NO_LABEL)).alias("entry_label"))


def list_sources(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source``, ``n_chapters``, ``n_sections`` (not repealed); sources without nodes stay."""
    n = nodes.groupBy("source").agg(F.count_if(F.col("parent_path").isNull()).alias("n_chapters"), F.count_if(F.col("parent_path").isNotNull() & ~F.col("is_repealed")).alias("n_sections"))
    return sources.select("source").join(n, "source", "left").fillna(0, ["n_chapters", "n_sections"])


def list_chapters(nodes: DataFrame, source: str | None = None) -> DataFrame:
    """``source``, ``path``, ``heading``, ``n_sections``, ``place``: plain numbers first, by value."""
    some = nodes if source is None else nodes.where(F.col("source") == source)
    below = some.where("parent_path is not null").groupBy(F.col("source").alias("_s"), F.col("parent_path").alias("_p")).agg(F.count_if(~F.col("is_repealed")).alias("n_sections"))
    top = some.where("parent_path is null")
    out = top.join(below, (F.col("source") == F.col("_s")) & (F.col("path") == F.col("_p")), "left").select("source", "path", "heading", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))
    return out.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(text.number_first_key(F.col("path")))))


def chapter_detail(nodes: DataFrame, source: str, chapter: str, abbreviation: str = "") -> DataFrame:
    """The sections of a chapter that are not repealed, in order of their numbers, with ``citation`` (the path behind the source's ``abbreviation``) and ``division`` (empty where nodes have none)."""
    own = nodes.where((F.col("source") == source) & (F.col("parent_path") == chapter) & ~F.col("is_repealed"))
    key = text.ordinal_key(F.col("path"))
    division = F.coalesce("division", F.lit("")) if "division" in nodes.columns else F.lit("")
    return own.withColumn("place", F.row_number().over(W.partitionBy("parent_path").orderBy(key, "path"))).select("path", "heading", "place", F.btrim(F.concat(F.lit(abbreviation + " "), "path")).alias("citation"), division.alias("division"))


def node_detail(nodes: DataFrame, versions: DataFrame, edges: DataFrame, year: int = 2026) -> DataFrame:
    """One row for each node: current text, number of versions and of outgoing links, its chapter's heading."""
    now = current_versions(versions).select("node_id", "version_id", "body", "effective_from")
    past = history(versions).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_versions"))
    out = edges.groupBy(F.col("from_version").alias("version_id")).agg(F.count(F.lit(1)).alias("n_links"))
    chapter = nodes.where("parent_path is null").select("source", F.col("path").alias("parent_path"), F.col("heading").alias("chapter_heading"))
    d = nodes.join(now, "node_id", "left").join(past, "node_id", "left").join(out, "version_id", "left").join(chapter, ["source", "parent_path"], "left")
    return d.select("node_id", "source", "path", "heading", "chapter_heading", "version_id", "effective_from", text.body_excerpt(F.col("body")).alias("excerpt"), F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
