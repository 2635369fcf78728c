"""Parse, diff, validate and apply snapshots of a versioned corpus.

All steps are DataFrames in, DataFrames out; the caller writes the result.
Snapshot rows have ``source``, ``path``, ``chapter``, ``heading``, ``body`` and
``content_hash``; covered chapters ``source``, ``chapter``, ``title``; nodes
``node_id``, ``source``, ``path``, ``parent_path`` (null for chapters),
``heading``, ``is_repealed``; versions as in :mod:`temporal`, with ``body`` and
``content_hash``.  A path belongs to its source: equal paths of two sources have
nothing to do with each other.  A snapshot has a path once (:func:`validate`
says so where it does not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators.temporal import latest
from palimpsest.sources.scratch import stored

#: More repeals than this share of the sections at hand stop an ingest.
REPEAL_LIMIT = 0.10
#: What a node is known by.
KEY = ["source", "path"]
#: Parts in which new rows are numbered.
PARTS = 1024


def numbered(rows: DataFrame, name: str, above: int) -> DataFrame:
    """Adds ``name``: numbers from ``above`` + 1 on, without gaps, by parts of a hash of :data:`KEY` and in order of it within.

    One row for each part reaches the driver, and no task sees all rows.  The
    rows are stored first, so that they are counted and ranked as the same.
    """
    rows = stored(rows, "unnumbered")
    part = F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int")
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], above
    for k in range(PARTS):
        before.append(total)
        total += sizes.get(k, 0)
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*KEY))
    first = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("_part"))
    return rows.withColumn("_part", part).withColumn(name, first + rank).drop("_part")


def _greatest(df: DataFrame, col: str) -> int:
    return df.agg(F.max(col).alias("m")).first()["m"] or 0


def diff(parsed: DataFrame, chapters: DataFrame, nodes: DataFrame, versions: DataFrame, colon: bool = False) -> DataFrame:
    """``source``, ``path``, ``kind`` (added, amended, unchanged, repealed), ``content_hash``, ``prior_hash``.

    The open version of a path counts, whatever its review status.  A section
    is repealed only if it is missing from a chapter that the snapshot covers.
    """
    open_versions = latest(versions.where("effective_to is null"), "node_id").select("node_id", F.col("content_hash").alias("prior_hash"))
    known = nodes.where("parent_path is not null").join(open_versions, "node_id", "left").select(*KEY, "is_repealed", "prior_hash", F.lit(True).alias("_known"))
    both = parsed.select(*KEY, "content_hash", F.lit(True).alias("_here")).join(known, KEY, "full_outer")
    kind = (
        F.when(F.col("_here").isNull(), F.when(~F.col("is_repealed"), F.lit("repealed")))
        .when(F.col("prior_hash").isNull(), F.lit("added"))
        .when(F.col("prior_hash") == F.col("content_hash"), F.lit("unchanged"))
        .otherwise(F.lit("amended"))
    )
    both = both.select(*KEY, kind.alias("kind"), "content_hash", "prior_hash").where("kind is not null")
    covered = chapters.select("source", F.col("chapter").alias("_chapter")).distinct()
    gone = both.where("kind = 'repealed'").withColumn("_chapter", text.chapter_of(F.col("path"), colon)).join(covered, ["source", "_chapter"], "left_semi").drop("_chapter")
    return both.where("kind <> 'repealed'").unionByName(gone)


def summary(changes: DataFrame) -> DataFrame:
    """One row: how many of each kind."""
    kinds = ("added", "amended", "repealed", "unchanged")
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]).withColumn("is_empty", F.expr("n_added + n_amended + n_repealed = 0"))


def _issues(rows: DataFrame, severity: str, code: str, path: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"), message.alias("message"))


def validate(parsed: DataFrame, changes: DataFrame, references: DataFrame | None = None, chapters: DataFrame | None = None) -> DataFrame:
    """``severity``, ``code``, ``path``, ``message`` of what is wrong with a snapshot and its changes.

    ``references`` (``source``, ``path``, ``reference``) are checked if given; of
    ``chapters`` (``chapter``, ``reserved``, ``n_rules``), those that should have
    rules and have none are warned of.
    """
    out = _issues(parsed.where(F.coalesce(text.strip(F.col("heading")), F.lit("")) == ""), "error", "missing_heading", F.col("path"), F.concat(F.lit("section "), F.col("path"), F.lit(" has no heading")))
    twice = parsed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(_issues(twice, "error", "duplicate_path", F.col("path"), F.format_string("section %s appears %d times in input", "path", "n")))
    total = changes.agg(F.count_if(F.col("kind") == "repealed").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("r") > REPEAL_LIMIT * F.col("n"))
    out = out.unionByName(_issues(total, "error", "unannounced_repeal_wave", F.lit("(corpus)"), F.format_string("%d repeals out of %d in-scope sections", "r", "n")))
    same = F.col("content_hash") == F.col("prior_hash")
    out = out.unionByName(_issues(changes.where((F.col("kind") == "unchanged") & ~same), "error", "hash_drift_unchanged", F.col("path"), F.lit("unchanged section, but its hash differs from the prior one")))
    out = out.unionByName(_issues(changes.where((F.col("kind") == "amended") & same), "error", "hash_drift_amended", F.col("path"), F.lit("amended section, but its hash matches the prior one")))
    if references is not None:
        lost = references.join(parsed.select("source", F.col("path").alias("reference")), ["source", "reference"], "left_anti")
        out = out.unionByName(_issues(lost, "warning", "unresolved_cross_reference", F.col("path"), F.concat(F.lit("refers to "), F.col("reference"), F.lit(", which is not in this run"))))
    if chapters is not None:
        bare = chapters.where("not reserved and n_rules = 0")
        out = out.unionByName(_issues(bare, "warning", "unparsed_content_chapter", F.col("chapter"), F.concat(F.lit("chapter "), F.col("chapter"), F.lit(" has no rules"))))
    return out


def apply_nodes(nodes: DataFrame, parsed: DataFrame, chapters: DataFrame, changes: DataFrame, above: int | None = None) -> DataFrame:
    """The nodes after a snapshot, with ids above the greatest so far (or ``above``) for new ones.

    Missing chapters and sections are made; chapter headings follow the
    snapshot, section headings only with an added or amended text; repealed
    sections are flagged, and one that comes back loses its flag.  Chapters are
    flagged as ``reserved`` says, where ``chapters`` has that column.
    ``metadata`` follows the heading, where any of the tables has that column.
    """
    moved = changes.where("kind in ('added', 'amended')").select(*KEY)
    kinds = {dict(d.dtypes)["metadata"] for d in (nodes, parsed, chapters) if "metadata" in d.columns}
    kind = kinds.pop() if kinds else "string"
    extra = lambda d: (F.col("metadata") if "metadata" in d.columns else F.lit(None)).cast(kind)
    reserved = F.coalesce("reserved", F.lit(False)) if "reserved" in chapters.columns else F.lit(None).cast("boolean")
    wanted = parsed.join(moved, KEY, "left_semi").select(*KEY, F.col("chapter").alias("new_parent"), F.col("heading").alias("new_heading"), extra(parsed).alias("new_metadata"), F.lit(False).alias("flag"))
    wanted = wanted.unionByName(chapters.select("source", F.col("chapter").alias("path"), F.lit(None).cast("string").alias("new_parent"), F.col("title").alias("new_heading"), extra(chapters).alias("new_metadata"), reserved.alias("flag")).dropDuplicates(KEY))
    gone = changes.where("kind = 'repealed'").select(*KEY, F.lit(True).alias("_gone"))
    # Stored once: new ones are numbered, and joined to the others.
    merged = nodes.withColumn("_metadata", extra(nodes)).join(wanted, KEY, "full_outer").join(gone, KEY, "left")
    made = merged.select(
        "node_id",
        *KEY,
        F.coalesce("parent_path", "new_parent").alias("parent_path"),
        F.coalesce("new_heading", "heading").alias("heading"),
        F.when(F.col("_gone"), True).otherwise(F.coalesce("flag", "is_repealed", F.lit(False))).alias("is_repealed"),
        *([F.coalesce("new_metadata", "_metadata").alias("metadata")] if "metadata" in {c for d in (nodes, parsed, chapters) for c in d.columns} else []),
    )
    made = stored(made, "nodes")
    fresh = numbered(made.where("node_id is null").drop("node_id"), "node_id", _greatest(nodes, "node_id") if above is None else above)
    return made.where("node_id is not null").unionByName(fresh)


def apply_versions(versions: DataFrame, nodes: DataFrame, parsed: DataFrame, changes: DataFrame, effective_from: Column, above: int | None = None) -> DataFrame:
    """The versions after a snapshot: amended and repealed ones closed, new ones pending.

    ``nodes`` are those after :func:`apply_nodes`.  New versions get ids above
    the greatest so far, so that of equal starts the later snapshot counts; a
    text that comes back is a version of its own.  ``enacted_by`` is the first
    history note; older versions without it have null.  Parquet tables have no
    MERGE, so this is a new snapshot of the table.
    """
    ids = nodes.select("node_id", *KEY)
    touched = changes.where("kind in ('amended', 'repealed')").join(ids, KEY).select("node_id", F.lit(True).alias("_touched"))
    old = versions if "enacted_by" in versions.columns else versions.withColumn("enacted_by", F.lit(None).cast("string"))
    until = F.when(F.col("_touched") & F.col("effective_to").isNull(), effective_from).otherwise(F.col("effective_to"))
    closed = old.join(touched, "node_id", "left").withColumn("effective_to", until).select(*old.columns)
    new = new_versions(nodes, parsed, changes, effective_from, _greatest(versions, "version_id") if above is None else above)
    return closed.unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)


def new_versions(nodes: DataFrame, parsed: DataFrame, changes: DataFrame, effective_from: Column, above: int) -> DataFrame:
    """The pending versions of added and amended sections, with ids from ``above`` + 1 on, and their :data:`KEY`."""
    ids = nodes.select("node_id", *KEY)
    fresh = parsed.join(changes.where("kind in ('added', 'amended')").select(*KEY), KEY, "left_semi").join(ids, KEY)
    history = F.coalesce(F.try_element_at("history_brackets", F.lit(1)), F.lit("")) if "history_brackets" in parsed.columns else F.lit("")
    return numbered(fresh.withColumn("enacted_by", history), "version_id", above).select(
        *KEY,
        "version_id",
        "node_id",
        "body",
        "content_hash",
        effective_from.alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.lit("pending").alias("review_status"),
        "enacted_by",
    )


def apply_snapshot(nodes: DataFrame, versions: DataFrame, parsed: DataFrame, chapters: DataFrame, effective_from: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and versions after a snapshot; its changes and the new nodes are computed once, and stored."""
    changes = stored(diff(parsed, chapters, nodes, versions), "changes")
    after = stored(apply_nodes(nodes, parsed, chapters, changes), "nodes-after")
    return after, apply_versions(versions, after, parsed, changes, effective_from)


def dry_run(parsed: DataFrame, chapters: DataFrame, nodes: DataFrame, versions: DataFrame, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes and issues of a snapshot; nothing is applied."""
    changes = diff(parsed, chapters, nodes, versions)
    return changes, validate(parsed, changes, references)


def run_row(changes: DataFrame, issues: DataFrame, started: Column, ended: Column) -> DataFrame:
    """One row about an ingest: ``status`` (failed if there is an error, else applied), counts of changes and issues, and its times."""
    found = issues.agg(*[F.count_if(F.col("severity") == k).alias(f"n_{k}s") for k in ("error", "warning")])
    status = F.when(F.col("n_errors") > 0, "failed").otherwise("applied")
    return summary(changes).join(F.broadcast(found)).select(status.alias("status"), "*", started.alias("started_at"), ended.alias("ended_at"))
