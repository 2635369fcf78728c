"""Resolution of citations, links between texts, and the edge table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import citations as grammar
from palimpsest.functions import text
from palimpsest.operators.joins import left_known
from palimpsest.operators.temporal import current_versions, visible

CANDIDATES = 5


def with_citation(df: DataFrame, col: str) -> DataFrame:
    """Adds ``citation``, the parsed value of ``col``."""
    return df.withColumn("citation", grammar.parse(F.col(col)))


def resolve(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Left join of ``citation.path`` to the nodes of the same source: ``node_id`` is null where there is none."""
    n = nodes.select(F.col("source").alias("_source"), F.col("path").alias("_path"), "node_id", "parent_path", "is_repealed")
    return cited.join(n, (F.col("citation.path") == n["_path"]) & (F.col("source") == n["_source"]), "left").drop("_source", "_path")


def candidates(missed: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``key``, ``candidates``: the first paths, in order of their bytes, below the cited chapter.

    The paths of a chapter are ranked once, not for each miss.
    """
    first = nodes.select("source", "path", text.chapter_of(F.col("path")).alias("_chapter")).where(F.col("path").contains("."))
    first = first.withColumn("_rank", F.row_number().over(W.partitionBy("source", "_chapter").orderBy("path"))).where(F.col("_rank") <= CANDIDATES)
    lists = first.groupBy("source", "_chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "path"))), lambda x: x["path"]).alias("candidates"))
    m = missed.select(key, "source", F.col("citation.chapter").alias("_chapter"))
    return m.join(lists, ["source", "_chapter"], "left").select(key, F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def lookup(queries: DataFrame, nodes: DataFrame, versions: DataFrame, include_pending: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """What each (``query_id``, ``source``, ``query``) finds.

    ``outcome``: parse_error, unknown_source (one that ``sources`` hasn't, if
    given), chapter, section, no_version (the node has no visible text) or
    missing; ``node_id``, ``version_id``, ``n_sections`` (of a chapter, see
    :func:`chapter_sections`) and ``candidates`` (of a missing section).
    """
    q = resolve(with_citation(queries, "query"), nodes)
    now = current_versions(versions, include_pending).select("node_id", "version_id")
    q = left_known(q, now, "node_id")
    below = nodes.where("not is_repealed and parent_path is not null").groupBy(F.col("source").alias("_s"), F.col("parent_path").alias("_chapter")).agg(F.count(F.lit(1)).alias("_n"))
    q = q.join(below, (F.col("source") == F.col("_s")) & (F.col("citation.path") == F.col("_chapter")) & F.col("citation.chapter_only"), "left").drop("_s", "_chapter")
    known = F.lit(True)
    if sources is not None:
        q = q.join(sources.select("source", F.lit(True).alias("_known")).distinct(), "source", "left")
        known = F.coalesce("_known", F.lit(False))
    outcome = (
        F.when(F.col("citation").isNull(), "parse_error")
        .when(~known, "unknown_source")
        .when(F.col("node_id").isNull(), "missing")
        .when(F.col("citation.chapter_only"), "chapter")
        .when(F.col("version_id").isNull(), "no_version")
        .otherwise("section")
    )
    q = q.withColumn("outcome", outcome)
    near = candidates(q.where("outcome = 'missing'"), nodes, "query_id")
    q = q.join(near, "query_id", "left")
    return q.select("query_id", "source", "query", "outcome", F.col("citation.path").alias("path"), "node_id", "version_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_sections"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def chapter_sections(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source``, ``chapter``, ``path`` of the live sections of each chapter that :func:`lookup` found, once each, in natural order.

    Rows are sorted by a range shuffle; no task or row holds a whole chapter.
    """
    asked = found.where("outcome = 'chapter'").select("source", F.col("path").alias("parent_path")).distinct()
    live = nodes.where("not is_repealed").join(asked, ["source", "parent_path"], "left_semi")
    return live.orderBy("source", "parent_path", text.natural_key(F.col("path"))).select("source", F.col("parent_path").alias("chapter"), "path")


def lookup_any_source(queries: DataFrame, sources: DataFrame, nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """As :func:`lookup` without a source: in the first, by name, that finds something, else in the first of all.

    One join by path finds the source of each query; it is then looked up once.
    """
    now = current_versions(versions).select("node_id", F.lit(True).alias("_text"))
    live = nodes.join(now, "node_id", "left").where("parent_path is null or _text").groupBy(F.col("path").alias("_path")).agg(F.min("source").alias("_found"))
    first = sources.agg(F.min("source").alias("s")).first()["s"]
    q = with_citation(queries.select("query_id", "query"), "query")
    q = q.join(live, F.col("citation.path") == F.col("_path"), "left").select("query_id", "query", F.coalesce("_found", F.lit(first)).alias("source"))
    return lookup(q, nodes, versions)


_FREE = re.compile(grammar.FREE_TEXT, re.IGNORECASE)
#: Lists of numbers behind one word, and which of their members are meant.
_SERIES = [(grammar.CHAPTER_SERIES, grammar.SERIES_ITEM), (grammar.SECTION_SERIES, grammar.SECTION_ITEM)]


def free_spans(body: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of what has the shape of a citation in a short piece of text, in order; a single character is none."""
    return [(*m.span(), m[0]) for m in _FREE.finditer(body) if len(m[0].strip()) > 1]


def _free(body: Column) -> Column:
    """The same of whole texts, as a Column."""
    return F.filter(grammar.spans(body, grammar.FREE_TEXT), lambda s: F.length(text.strip(s["raw"])) > 1)


def _members(body: Column, series: str, member: str) -> Column:
    inside = lambda s: F.transform(grammar.spans(s["raw"], member), lambda m: F.struct((s["start"] + m["start"]).alias("start"), (s["start"] + m["end"]).alias("end"), m["raw"].alias("raw")))
    return F.flatten(F.transform(grammar.spans(body, series, 1), inside))


def _series(body: Column) -> Column:
    """Members of lists such as "chapters 2, 3 or 4", in order."""
    return F.array_sort(F.concat(*[_members(body, *s) for s in _SERIES]))


def scan(texts: DataFrame, key: str, body: str, series: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of ``key`` (and ``carry``) for each citation in ``body``.

    ``pass`` (1 for members of lists), ``pos``, ``start``, ``end``, ``raw``, and
    what the grammar reads in it: ``path``, ``chapter``, ``chapter_only``,
    ``confident`` (a section, a sign before it, or a member of a list).  Null
    texts have none.
    """
    own = [key, *carry]
    found = texts.select(*own, F.posexplode(_free(F.col(body))).alias("pos", "s")).withColumn("pass", F.lit(0))
    if series:
        found = found.unionByName(texts.select(*own, F.posexplode(_series(F.col(body))).alias("pos", "s")).withColumn("pass", F.lit(1)))
    found = found.select(*own, "pass", "pos", "s.start", "s.end", "s.raw")
    c = grammar.parse(F.col("raw"))
    alone = c["chapter_only"] & ~grammar.has_sign(F.col("raw")) & (F.col("pass") == 0)
    return found.withColumns({"path": c["path"], "chapter": c["chapter"], "chapter_only": F.coalesce(c["chapter_only"], F.lit(False)), "confident": c.isNotNull() & ~F.coalesce(alone, F.lit(False))})


def citation_links(texts: DataFrame, nodes: DataFrame, versions: DataFrame, include_pending: bool = False) -> DataFrame:
    """Links from each text (``node_id``, ``source``, ``body``) to live nodes of its source: ``node_id``, ``raw``, ``target_id``, ``target_path``.

    Only citations with a section or a sign, and members of lists.  Never to
    itself, to a repealed node, or to a section without a visible text.  Of
    equal (raw, target) the first stays, in order of ``pos``.
    """
    live = versions.where(F.col("effective_to").isNull() & visible(include_pending)).select(F.col("node_id").alias("target_id")).distinct()
    found = scan(texts, "node_id", "body", series=True, carry=["source"]).where("confident")
    target = nodes.where("not is_repealed").select(F.col("source").alias("_s"), F.col("path").alias("_p"), F.col("node_id").alias("target_id"), F.col("parent_path").alias("_parent"))
    hit = found.join(target, (found.source == target["_s"]) & (found.path == target["_p"])).where("node_id <> target_id")
    sections = hit.where("_parent is not null").join(live, "target_id", "left_semi")
    hit = sections.unionByName(hit.where("_parent is null"))
    return hit.groupBy("node_id", "raw", "target_id", F.col("path").alias("target_path")).agg(F.min("pos").alias("pos"))


def cross_references(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """The edge table, made anew: ``from_version``, ``to_node``, each once, from every current visible text."""
    now = current_versions(versions).join(nodes.select("node_id", "source"), "node_id")
    links = citation_links(now.select("node_id", "source", "body"), nodes, versions)
    return links.join(now.select("node_id", "version_id"), "node_id").select(F.col("version_id").alias("from_version"), F.col("target_id").alias("to_node")).distinct()


def references_of(node_id: Column | int, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """``direction``, ``version_id``, ``node_id`` (of the other end): outgoing from the node's current text, incoming from open visible texts."""
    now = current_versions(versions)
    out = now.where(F.col("node_id") == node_id).select("version_id").join(edges, F.col("version_id") == F.col("from_version")).select(F.lit("outgoing").alias("direction"), "version_id", F.col("to_node").alias("node_id"))
    shown = versions.where(F.col("effective_to").isNull() & visible()).select("version_id", "node_id")
    into = edges.where(F.col("to_node") == node_id).join(shown, F.col("version_id") == F.col("from_version")).select(F.lit("incoming").alias("direction"), "version_id", "node_id")
    return out.unionByName(into)
