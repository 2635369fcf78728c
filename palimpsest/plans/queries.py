"""Queries of the corpus operators on the driver's tables; SQL for them is in :mod:`oracle`.

Names begin with the operator's place in the inventory.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import citations, similarity, text
from palimpsest.operators import ann, audit, bands, browse, chapterstore, evaluation, fulltext, hierarchy, ingest, links, retrieval, temporal, textindex
from palimpsest.plans import fixtures as fx
from palimpsest.sources import blobs, blobstore, pages, pdf, probes, rtf, rules_text, scratch
from palimpsest.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEADINGS = ["the and of", "der die und", "de la que", "erst"]
WORDS = ["the that", "the or with", '"of the"', "and -the"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def asked(spark: SparkSession, queries: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")


# Sources


@query
def a6_first_links(spark, sf_dir):
    found = pages.links(fx.table(spark, sf_dir, "pages"))
    return pages.first_appearances(found).select("slug", "page_id", F.col("pos").cast("long").alias("pos"))


@query
def a6_links_in_order(spark, sf_dir):
    found = pages.links(fx.table(spark, sf_dir, "pages"))
    return pages.in_order(pages.first_appearances(found)).select("slug", F.col("place").cast("long").alias("place"))


@query
def a1_code_sections(spark, sf_dir):
    _, sections, _ = probes.parse_code(fx.code_probe(spark, sf_dir))
    return sections.select("chapter", "path", "ordinal", "heading", "content_hash", F.array_join("history_brackets", "|").alias("history"))


@query
def a1_skipped_sections(spark, sf_dir):
    return probes.parse_code(fx.code_probe(spark, sf_dir))[2].select("chapter", "number", "reason")


@query
def a1_code_chapters(spark, sf_dir):
    return probes.parse_code(fx.code_probe(spark, sf_dir))[0].select("chapter", "title", "year")


@query
def a2_rules(spark, sf_dir):
    _, rules, _ = probes.parse_rules(fx.rules_probe(spark, sf_dir))
    return rules.select("chapter", "path", "ordinal", "heading", "division", "content_hash")


@query
def a2_rule_chapters(spark, sf_dir):
    return probes.parse_rules(fx.rules_probe(spark, sf_dir))[0].select("chapter", "title", "reserved", "edition", "n_rules")


@query
def a4_chapter_heads(spark, sf_dir):
    return rtf.chapter_heads(fx.rich_chapters(spark, sf_dir)).select("path", "chapter", "title")


@query
def a5_rich_sections(spark, sf_dir):
    found = rtf.with_notes(rtf.sections_of(fx.rich_chapters(spark, sf_dir)))
    return found.select("path", "number", "heading", F.sha2("body", 256).alias("body_hash"), F.array_join("history_brackets", "|").alias("history"), F.array_join("referred_to_in", "|").alias("referred"))


@query
def a9_content_lines(spark, sf_dir):
    return rules_text.content_lines(fx.rule_lines(spark, sf_dir)).groupBy("chapter").agg(F.count(F.lit(1)).alias("n_lines"), F.count("rule").alias("n_heads"), F.count_if("banner").alias("n_banners"))


@query
def a9_pdf_lines(spark, sf_dir):
    of = pdf.pages(fx.pdf_files(spark, sf_dir)).groupBy("path")
    whole = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "lines"))), lambda p: p["lines"])), "\n")
    return of.agg(F.count("page").alias("n_pages"), F.sum(F.size("lines")).alias("n_lines"), F.sha2(whole, 256).alias("lines_hash"), F.count("issue").alias("n_issues"))


@query
def a10_index(spark, sf_dir):
    return rules_text.index(rules_text.content_lines(fx.rule_lines(spark, sf_dir))).select("chapter", "rule", "role", F.col("n").cast("long").alias("n"))


@query
def a11_contents(spark, sf_dir):
    found = rules_text.entries(rules_text.content_lines(fx.rule_lines(spark, sf_dir)), "contents")
    return rules_text.contents(found).select("chapter", "rule", "heading", "division")


@query
def a13_rule_bodies(spark, sf_dir):
    out = rules_text.bodies(rules_text.entries(rules_text.content_lines(fx.rule_lines(spark, sf_dir)), "body"))
    return out.select("chapter", "rule", "heading", F.sha2("prose", 256).alias("prose_hash"), "comment", F.array_join("history", "|").alias("history"))


@query
def a14_rule_notes(spark, sf_dir):
    rules, notes = rules_text.parse(fx.rule_lines(spark, sf_dir).where("line not like 'Rule %:2.1 A%' or chapter % 2 = 0 or line_no < 12"))
    return notes.select("chapter", "rule", "note").unionByName(rules.select("chapter", "rule", F.concat(F.lit("parsed under "), "division").alias("note")))


@query
def a17_new_blobs(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("storage_path"), F.octet_length("text").cast("long").alias("byte_size"))
    return blobs.new_blobs(d, d.where("storage_path % 3 = 0")).select("content_hash", "storage_path", "byte_size")


@query
def a17_blob_store(spark, sf_dir):
    store = blobstore.BlobStore(spark, scratch.folder(spark, "blobs"))
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    store.add(d.where("doc_id % 3 = 0"))
    store.add(d)
    return store.read().select("content_hash", "byte_size", (F.sha2("content", 256) == F.col("content_hash")).alias("whole"))


@query
def a18_code_sink(spark, sf_dir):
    chapters, sections, _ = probes.parse_code(fx.code_probe(spark, sf_dir))
    made = probes.to_probe(sections, chapters, 2026).select(F.from_json("value", probes.CODE_SCHEMA).alias("p"))
    return made.select("p.code_year", F.explode("p.samples").alias("s")).select("code_year", "s.chapter", F.get("s.sections", F.lit(0))["number"].alias("number"), F.sha2(F.get("s.sections", F.lit(0))["body_text"], 256).alias("body_hash"))


@query
def a18_rules_sink(spark, sf_dir):
    rules, notes = rules_text.parse(fx.rule_lines(spark, sf_dir))
    made = probes.to_rules_probe(rules, notes, "2026-04-01").select(F.from_json("value", probes.RULES_SCHEMA).alias("p"))
    return made.select("p.edition_date", F.explode("p.samples").alias("s")).select("edition_date", "s.chapter", F.col("s.rule_count").cast("long").alias("rule_count"), F.array_join(F.transform("s.rules", lambda r: r["number"]), ",").alias("numbers"), F.array_join("s.parse_notes", ",").alias("notes"))


@query
def a19_reconciled(spark, sf_dir):
    counts = lambda t: t.agg(F.count(F.lit(1)).alias("n"))
    names = ("documents", "labels", "events")
    return functools.reduce(DataFrame.unionByName, [blobs.compared(n, counts(fx.table(spark, sf_dir, n)), counts(fx.table(spark, sf_dir, n).where(F.lit(n != "labels")))) for n in names])


# Scalar functions


@query
def b1_visible_versions(spark, sf_dir):
    return fx.versions(spark, sf_dir).where(temporal.is_current()).select("version_id", "node_id")


@query
def b2_one_source(spark, sf_dir):
    return retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), "en").select("version_id", "path")


@query
def b3_chapter_prefix(spark, sf_dir):
    return fx.nodes(spark, sf_dir, headings=False).where(F.col("path").startswith("1.")).select("node_id", "path")


@query
def b4_contains(spark, sf_dir):
    return fx.versions(spark, sf_dir).where(text.contains_folded(F.col("body"), F.lit("THE AND"))).select("version_id")


@query
def b5_normalized_bodies(spark, sf_dir):
    raw = F.concat("text", F.lit("; ; eferred to in §1.2, §3\r\nSee also  \n"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(text.normalized_body(raw)).alias("code_hash"), text.content_hash(text.normalized_body(raw, drop_note=False)).alias("rules_hash"))


@query
def b8_combined_text(spark, sf_dir):
    comment = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("  "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.length(text.combined_text(F.col("text"), comment)).cast("long").alias("n"))


@query
def b9_numbers_and_paths(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False)
    return n.select("node_id", text.trimmed_number(F.concat("path", F.lit(".:"))).alias("number"), text.chapter_of(F.col("path")).alias("chapter"), text.ordinal_of(F.col("path")).alias("ordinal")).where("node_id > 0")


@query
def b12_natural_order(spark, sf_dir):
    from pyspark.sql import Window as W

    n = fx.nodes(spark, sf_dir, headings=False).where("parent_path is not null")
    w = W.partitionBy("source", "parent_path").orderBy(text.natural_key(F.col("path")))
    return n.select("node_id", F.row_number().over(w).cast("long").alias("place"))


@query
def b15_urls(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False).where("node_id > 0")
    template = F.when(F.col("source") == "en", "https://law.example/{year}/{path}.pdf").when(F.col("source") == "de", "https://law.example/{edition}/{path}").otherwise(F.lit(None))
    url = text.filled_url(template, F.lit(2026), F.col("path"))
    return n.select("node_id", url.alias("url"), text.first_filled(F.lit(""), url, F.lit("none")).alias("first_url"))


@query
def b18_snippets(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.body_excerpt(F.col("text")).alias("excerpt"))


@query
def b19_search_snippets(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.search_snippet(F.col("text"), F.lit("zz the und")).alias("snippet"))


@query
def b21_excerpts(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.excerpt_around(F.col("text"), F.lit("And the")).alias("excerpt"))


@query
def b22_collapsed(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse_space(F.col("text")), 256).alias("h"))


@query
def b27_banners(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.groupBy("doc_id").agg(F.count_if(text.all_capitals(F.col("line"))).alias("n_banners"))


# Versions


@query
def c1_current_versions(spark, sf_dir):
    return temporal.current_versions(fx.histories(spark, sf_dir).withColumn("effective_to", F.when(F.col("node_id") % 2 == 0, F.col("effective_to")))).select("node_id", "version_id")


@query
def c2_history(spark, sf_dir):
    return temporal.history(fx.histories(spark, sf_dir)).select("node_id", "version_id", F.col("place").cast("long").alias("place"))


@query
def c3_versions_at(spark, sf_dir):
    return temporal.versions_at(fx.histories(spark, sf_dir), fx.probes(spark, sf_dir)).select("node_id", "day", "version_id")


@query
def c4_recent_amendments(spark, sf_dir):
    out = temporal.recent_amendments(fx.history_nodes(spark, sf_dir), fx.histories(spark, sf_dir), F.lit("2024-02-01").cast("date"), 100)
    return out.select("version_id", "path", "kind")


def _changes(spark, sf_dir):
    return ingest.diff(fx.snapshot(spark, sf_dir), fx.snapshot_chapters(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))


@query
def c5_diff(spark, sf_dir):
    return _changes(spark, sf_dir).select("source", "path", "kind")


@query
def c6_colon_diff(spark, sf_dir):
    """Paths of rules: a colon behind the chapter."""
    with_colon = lambda d: d.withColumn("path", F.replace("path", F.lit("."), F.lit(":")))
    out = ingest.diff(with_colon(fx.snapshot(spark, sf_dir)), fx.snapshot_chapters(spark, sf_dir), with_colon(fx.nodes(spark, sf_dir, headings=False)), fx.versions(spark, sf_dir), colon=True)
    return out.select("source", "path", "kind")


@query
def c7_summary(spark, sf_dir):
    return ingest.summary(_changes(spark, sf_dir))


#: The day from which the snapshot holds.
STARTS = "2026-01-01"


def _applied(spark, sf_dir):
    return ingest.apply_snapshot(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), fx.snapshot(spark, sf_dir), fx.snapshot_chapters(spark, sf_dir), F.lit(STARTS).cast("date"))


@query
def c8_applied_versions(spark, sf_dir):
    return _applied(spark, sf_dir)[1].select("content_hash", "effective_from", "effective_to", "review_status", "enacted_by")


@query
def c8_in_place(spark, sf_dir):
    """The same snapshot, on a stored corpus of which it rewrites the chapters that it changes."""
    held = chapterstore.ChapterStore(spark, scratch.folder(spark, "corpus"))
    held.create(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir))
    held.apply(fx.snapshot(spark, sf_dir), fx.snapshot_chapters(spark, sf_dir), F.lit(STARTS).cast("date"))
    return held.versions().select("content_hash", "effective_from", "effective_to", "review_status", "enacted_by")


@query
def c8_run(spark, sf_dir):
    changes, at = _changes(spark, sf_dir), F.lit("2026-01-01").cast("date")
    return ingest.run_row(changes, ingest.validate(fx.snapshot(spark, sf_dir), changes), at, at).select("status", "n_added", "n_amended", "n_repealed", "n_unchanged", "n_errors", "n_warnings")


@query
def c9_applied_nodes(spark, sf_dir):
    return _applied(spark, sf_dir)[0].select("source", "path", "parent_path", "is_repealed", F.sha2("heading", 256).alias("heading_hash"))


@query
def c11_review(spark, sf_dir):
    v = fx.versions(spark, sf_dir)
    out = temporal.review(v, v.where("version_id % 3 = 0").select("version_id"), "approved")
    return out.groupBy("review_status", "review_outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def c12_issues(spark, sf_dir):
    refs = fx.snapshot(spark, sf_dir).select("source", "path", F.concat("chapter", F.lit(".1")).alias("reference"))
    return ingest.validate(fx.snapshot(spark, sf_dir), _changes(spark, sf_dir), refs).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def c13_bare_chapters(spark, sf_dir):
    """Chapters that should have rules, and have none in the snapshot."""
    parsed = fx.snapshot(spark, sf_dir)
    counts = parsed.groupBy("source", "chapter").agg(F.count(F.lit(1)).alias("n_rules"))
    chapters = fx.snapshot_chapters(spark, sf_dir).join(counts, ["source", "chapter"], "left").fillna(0, ["n_rules"])
    issues = ingest.validate(parsed, _changes(spark, sf_dir), chapters=chapters)
    return issues.where("code = 'unparsed_content_chapter'").select("severity", "code", "path", "message")


@query
def c14_dry_run(spark, sf_dir):
    """What an ingest would do, and what is wrong with it."""
    refs = fx.snapshot(spark, sf_dir).select("source", "path", F.concat("chapter", F.lit(".1")).alias("reference"))
    changes, issues = ingest.dry_run(fx.snapshot(spark, sf_dir), fx.snapshot_chapters(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir), refs)
    return changes.groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(issues.groupBy(F.col("code").alias("what")).agg(F.count(F.lit(1)).alias("n")))


# Retrieval


@query
def d1_postings(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.lit("").alias("heading"), F.col("text").alias("body"))
    return fulltext.postings(docs, "version_id", english=False).groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("at")).alias("tf"))


@query
def d1_index(spark, sf_dir):
    """An index that went through additions, removals and new headings, read back: it counts what one made anew would."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.lit("").alias("heading"), F.col("text").alias("body"), "lang")
    before = d.where("version_id % 3 <> 0").drop("lang")
    after = d.where("version_id % 7 <> 0").select("version_id", F.when(F.col("version_id") % 5 == 0, F.col("lang")).otherwise("").alias("heading"), "body")
    held = textindex.Index(spark, scratch.folder(spark, "text-index"), english=False)
    held.build(before)
    held.update(*textindex.changed_documents(before, after))
    return held.postings(held.state()).groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places")).alias("tf"), F.sum(F.size(F.filter("places", lambda p: p % 2 == 1))).alias("in_headings"))


@functools.cache
def _text_index(application: str, sf_dir: str, english: bool, source: str | None = None) -> textindex.Index:
    """An index of the current versions (of one source); it stays while the application does."""
    spark = SparkSession.getActiveSession()
    held = textindex.Index(spark, scratch.folder(spark, "text-index"), english=english)
    held.build(retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), source).select("version_id", "heading", "body"))
    return held


def _questions(spark, sf_dir, words: int):
    """The first words of every document whose id is divisible by 20."""
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(fulltext.WORD), 0), 1, words)
    return fx.table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(first, " ").alias("query"))


@query
def d2_fulltext(spark, sf_dir):
    hits = _text_index(spark.sparkContext.applicationId, sf_dir, True).search(_questions(spark, sf_dir, 3), limit=50)
    return hits.select("query_id", "version_id", F.round("score", 6).alias("score"), "rank")


@query
def d2_word_ranks(spark, sf_dir):
    hits = _text_index(spark.sparkContext.applicationId, sf_dir, False).search(_questions(spark, sf_dir, 1), limit=50)
    return hits.select("query_id", "version_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def d2_simple_match(spark, sf_dir):
    docs = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir))
    hits = fulltext.search(fulltext.postings(docs, "version_id", english=False), asked(spark, WORDS), limit=None, english=False)
    return hits.select("query_id", "version_id")


@query
def d3_trigram(spark, sf_dir):
    docs = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir))
    return retrieval.trigram_search(docs, _questions(spark, sf_dir, 3), limit=20).select("query_id", "version_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("version_id"), "embedding", "label")


def _asked_vectors(spark, sf_dir):
    """Queries of a search: every row whose id is divisible by 20."""
    return _vectors(spark, sf_dir).where("version_id % 20 = 0").withColumnRenamed("version_id", "query_id")


@query
def d4_vector(spark, sf_dir):
    return retrieval.vector_search(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), limit=10).select("query_id", "version_id", F.round("score", 6).alias("score"))


def _index(spark, sf_dir):
    """A stored index over all vectors, and its model."""
    docs = _vectors(spark, sf_dir)
    model, path = ann.fit(docs), scratch.folder(spark, "vector-index")
    ann.write_index(docs, model, path)
    return ann.read_index(spark, path)


@query
def d4_cells(spark, sf_dir):
    docs = _vectors(spark, sf_dir)
    return ann.search(docs, _asked_vectors(spark, sf_dir), *_index(spark, sf_dir), limit=10).select("query_id", "version_id", F.round("score", 6).alias("score"))


@query
def d4_recall(spark, sf_dir):
    docs, asked_for = _vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)
    found = ann.search(docs, asked_for, *_index(spark, sf_dir), limit=10)
    both = ann.recall(found, retrieval.vector_search(docs, asked_for, limit=10))
    return both.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_exact").alias("n_wanted"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("enough"))


@query
def d5_fusion(spark, sf_dir):
    docs, q = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir)), asked(spark, HEADINGS)
    lists = {"heading": retrieval.trigram_search(docs, q, limit=30), "body": retrieval.trigram_search(docs, q, threshold=0.0, limit=30, col="body")}
    return retrieval.fuse(lists).select("query_id", "version_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def d6_hybrid(spark, sf_dir):
    """Words, headings and vectors, fused: the questions are the first words of documents, with the vectors of the same ids."""
    vectors = _vectors(spark, sf_dir).select("version_id", "embedding")
    docs = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), "en").join(vectors, "version_id", "left")
    index = _text_index(spark.sparkContext.applicationId, sf_dir, True, "en")
    hits = retrieval.hybrid_search(docs, _questions(spark, sf_dir, 3), vectors=_asked_vectors(spark, sf_dir), index=index)
    return hits.select("query_id", "rank", "version_id", "path", F.round("score", 9).alias("score"))


@query
def d7_pending_embeddings(spark, sf_dir):
    v = fx.versions(spark, sf_dir).withColumn("embedding_source_hash", F.when(F.col("version_id") % 3 == 0, F.col("content_hash")).when(F.col("version_id") % 3 == 1, F.lit("old")))
    return retrieval.pending_embeddings(v).select("version_id")


@query
def d8_embeddings(spark, sf_dir):
    v = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir)).withColumn("embedding_source_hash", F.lit(None).cast("string"))
    part = lambda i: F.round(F.element_at("embedding", i).cast("double"), 4)
    return retrieval.embed(v).select("version_id", F.size("embedding").alias("width"), F.round(similarity.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"), part(1).alias("first"), part(-1).alias("last"), "error")


@query
def d13_browse_search(spark, sf_dir):
    docs = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), "en")
    first = docs.agg(F.min(F.struct("version_id", "path")).alias("m")).first()["m"]
    q = asked(spark, ["the reason", first["path"] if first else "1.1"])
    pins = links.lookup(q.withColumn("source", F.lit("en")), fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir)).where("outcome = 'section'")
    return retrieval.browse_search(docs, q, pins.select("query_id", "version_id")).select("query_id", "place", "version_id", "path", "exact", "snippet")


@query
def d14_tool_search(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    docs = retrieval.searchable(n, fx.versions(spark, sf_dir), "en")
    return retrieval.tool_search(docs, n, asked(spark, ["the reason"])).select("query_id", "rank", "version_id", "path", "snippet", "chapter_heading")


# Citations


@query
def e1_parse(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False).where("node_id > 0")
    of_chapter = F.col("node_id") % 6 == 5
    sign = F.element_at(F.array(*[F.lit(s) for s in ("Iowa Code § ", "section ", "I.C. ", "", "§§ ", "ch. ")]), (F.col("node_id") % 6 + 1).cast("int"))
    c = citations.parse(F.concat(sign, F.when(of_chapter, F.col("parent_path")).otherwise(F.col("path")), F.lit("(2)(a) and more")))
    parsed = [c[k].alias(k) for k in ("path", "chapter", "chapter_only")]
    return n.select("node_id", *parsed, F.array_join(c["subdivisions"], "/").alias("subdivisions"), *[citations.render(c, style).alias(style) for style in ("long", "short", "bare")])


@query
def e2_find_all(spark, sf_dir):
    return fx.briefs(spark, sf_dir).select("text_id", F.explode(citations.find_all(F.col("body"))).alias("raw")).groupBy("text_id", "raw").agg(F.count(F.lit(1)).alias("n"))


@query
def e3_spans(spark, sf_dir):
    return links.scan(fx.briefs(spark, sf_dir), "text_id", "body").select("text_id", "start", "end", "raw", "path")


def _lookups(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False)
    kinds = F.array(F.col("path"), F.concat(F.lit("section "), F.col("parent_path"), F.lit(".99999999")), F.concat(F.lit("chapter "), F.col("parent_path")), F.lit("no citation"))
    return n.where("node_id > 0").select(F.col("node_id").alias("query_id"), "source", F.element_at(kinds, (F.col("node_id") % 4 + 1).cast("int")).alias("query"))


@query
def e6_lookup(spark, sf_dir):
    out = links.lookup(_lookups(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))
    return out.select("query_id", "outcome", "version_id", "n_sections", F.array_join("candidates", ",").alias("candidates"))


@query
def e6_chapter_sections(spark, sf_dir):
    found = links.lookup(_lookups(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))
    return links.chapter_sections(found, fx.nodes(spark, sf_dir, headings=False))


@query
def e7_lookup_any_source(spark, sf_dir):
    q = _lookups(spark, sf_dir).select("query_id", "query")
    return links.lookup_any_source(q, fx.sources(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir)).select("query_id", "source", "outcome")


def _linking(spark, sf_dir):
    b = fx.briefs(spark, sf_dir)
    return b.select((F.col("text_id") * 3).alias("node_id"), "source", "body")


@query
def e8_links(spark, sf_dir):
    return links.citation_links(_linking(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir)).select("node_id", "raw", "target_path")


@query
def e9_edges(spark, sf_dir):
    v = fx.versions(spark, sf_dir).join(fx.briefs(spark, sf_dir).select(F.col("text_id").alias("version_id"), F.col("body").alias("brief")), "version_id").withColumn("body", F.col("brief"))
    n = fx.nodes(spark, sf_dir, headings=False)
    e = links.cross_references(n, v)
    return e.join(n.select(F.col("node_id").alias("to_node"), F.col("path").alias("to_path")), "to_node").select("from_version", "to_path")


@query
def e10_references(spark, sf_dir):
    v = fx.versions(spark, sf_dir)
    edges = v.where("version_id % 5 = 0").select(F.col("version_id").alias("from_version"), F.lit(1).cast("long").alias("to_node")).unionByName(v.select(F.lit(1).cast("long").alias("from_version"), F.col("node_id").alias("to_node")).where("to_node % 11 = 0"))
    return links.references_of(1, edges, v)


# Audit


def _checked(spark, sf_dir):
    return audit.validate_citations(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))


@query
def f1_citations(spark, sf_dir):
    return _checked(spark, sf_dir).select("text_id", F.btrim("raw").alias("raw"), "path", "status", F.array_join("candidates", ",").alias("candidates"))


@query
def f1_report(spark, sf_dir):
    return audit.citation_report(_checked(spark, sf_dir))


@query
def f2_quotes(spark, sf_dir):
    out = audit.verify_quotes(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))
    return out.select("text_id", F.sha2("quote", 256).alias("quote_hash"), "path", "status")


@query
def f2_exact_quotes(spark, sf_dir):
    out = audit.verify_quotes(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))
    return out.where("status = 'exact'").select("text_id", F.sha2("quote", 256).alias("quote_hash"), "path", "score")


@query
def f3_nearest_citations(spark, sf_dir):
    """For each number of at least three digits the nearest mention of a section or chapter."""
    texts = fx.briefs(spark, sf_dir)
    words = texts.select("text_id", F.explode(citations.spans(F.col("body"), r"\b(?:section|chapter)\b")).alias("s")).select("text_id", "s.start", "s.end", "s.raw")
    numbers = texts.select("text_id", F.explode(citations.spans(F.col("body"), r"[0-9]{3,}")).alias("s")).select("text_id", "s.start", "s.end")
    return bands.nearest(numbers, words, "text_id", audit.WINDOW).select("text_id", "start", "end", "r_start", F.lower("r_raw").alias("word"), "distance")


@query
def f4_fuzzy_quotes(spark, sf_dir):
    b = fx.briefs(spark, sf_dir).withColumn("body", F.regexp_replace("body", r'(, ".{20}).', "$1#"))
    out = audit.verify_quotes(b, fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir))
    return out.select("text_id", "status", F.round("score", 6).alias("score"), "passage")


@query
def f5_audit(spark, sf_dir):
    cites, quotes, fresh = audit.audit(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir), F.lit("2024-06-01").cast("date"))
    return fresh.select("text_id", "version_id", "effective_from")


@query
def f6_audit_report(spark, sf_dir):
    parts = audit.audit(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False), fx.versions(spark, sf_dir), F.lit("2024-06-01").cast("date"))
    return audit.audit_report(*parts).select("text_id", "n_citations", "n_valid", "n_quotes", "n_exact", "n_amended", "citation_rows", "quote_rows")


@query
def f6_audit_tables(spark, sf_dir):
    texts, n, since = fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir), "2024-06-01"
    parts = audit.audit(texts, n, fx.versions(spark, sf_dir), F.lit(since).cast("date"))
    out = audit.audit_tables(texts, n, *parts, since, url=F.concat(F.lit("https://law.example/"), "path"))
    return out.select("text_id", F.sha2("citations", 256).alias("citations_hash"), F.sha2("amended_since", 256).alias("amended_hash"))


@query
def f8_payloads(spark, sf_dir):
    out = audit.citation_payloads(fx.briefs(spark, sf_dir), fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir))
    return out.select("text_id", "error", "n_citations", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["path"], c["status"], F.length(F.coalesce(c["excerpt"], F.lit(""))))), ",").alias("citations"))


@query
def f7_definitions(spark, sf_dir):
    v = fx.versions(spark, sf_dir).withColumn("body", F.concat("body", F.lit('\n1. "Fast reason" means body '), "node_id", F.lit(". Other words.")))
    return audit.definitions(fx.nodes(spark, sf_dir, headings=False), v, "reason", limit=25).select("node_id", "term", "definition")


# Browsing


@query
def g1_sources(spark, sf_dir):
    return browse.list_sources(fx.sources(spark, sf_dir), fx.nodes(spark, sf_dir, headings=False))


@query
def g1_typed_sources(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False).withColumn("node_type", F.when(F.col("parent_path").isNull(), F.when(F.col("source") == "de", "title").otherwise("chapter")).when(F.col("node_id") % 2 == 0, "section").otherwise("rule"))
    types = [("en", "chapter", 0, "Chapters"), ("en", "section", 1, "Sections"), ("de", "title", 0, "Titles"), ("de", "rule", 1, "Rules"), ("de", "section", 2, "Sections"), ("fr", "chapter", 0, "Chapters")]
    return browse.typed_sources(fx.sources(spark, sf_dir), n, spark.createDataFrame(types, "source string, node_type string, level int, label string"))


@query
def g2_chapters(spark, sf_dir):
    return browse.list_chapters(fx.nodes(spark, sf_dir, headings=False)).select("source", "path", "n_sections", F.col("place").cast("long").alias("place"))


@query
def g3_chapter(spark, sf_dir):
    n = fx.nodes(spark, sf_dir, headings=False).withColumn("division", F.when(F.col("node_id") % 2 == 0, "Division I"))
    return browse.chapter_detail(n, "en", "1", "Code §").select("path", F.col("place").cast("long").alias("place"), "citation", "division")


@query
def g3_hierarchy(spark, sf_dir):
    """Documents as a tree in which n hangs below n / 2, broken by a cycle; every fourth has a value to inherit."""
    d = fx.table(spark, sf_dir, "documents")
    cycle = F.when(F.col("doc_id") % 100 == 61, F.col("doc_id") + 2).when(F.col("doc_id") % 100 == 63, F.col("doc_id") - 2)
    parent = F.coalesce(cycle, F.when(F.col("doc_id") > 0, F.expr("doc_id div 2")))
    n = d.select(F.col("doc_id").alias("node_id"), parent.alias("parent_id"), F.col("doc_id").cast("string").alias("label"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang"))
    out = hierarchy.hierarchy(n, "label", "lang")
    return out.select("node_id", "cyclic", "depth", F.array_join("breadcrumb", "/").alias("breadcrumb"), "inherited", "n_below")


@query
def g4_nodes(spark, sf_dir):
    edges = fx.versions(spark, sf_dir).where("version_id % 5 = 0").select(F.col("version_id").alias("from_version"), F.lit(1).cast("long").alias("to_node"))
    out = browse.node_detail(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), edges).where("node_id > 0")
    return out.select("node_id", "path", "chapter_heading", "version_id", "n_versions", "n_links")


# Evaluation


def _scores(spark, sf_dir):
    """Of each asked vector's first 5, how many are among the next 200 ids."""
    hits = retrieval.vector_search(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), limit=5)
    want = _asked_vectors(spark, sf_dir).select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 200).cast("array<string>")).alias("path"))
    return evaluation.score_rankings(hits.select("query_id", F.col("version_id").cast("string").alias("path"), "rank"), want, _vectors(spark, sf_dir).select(F.col("version_id").cast("string").alias("path")), 5)


@query
def h1_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "n_available", "n_matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "hit")


@query
def h2_summary(spark, sf_dir):
    tags = _asked_vectors(spark, sf_dir).select("query_id", F.explode(F.array(F.lit("all"), F.concat(F.lit("label"), F.col("label")))).alias("tag"))
    return evaluation.summarise(_scores(spark, sf_dir), tags).select("tag", "n", F.round("mean_precision", 6).alias("mean_precision"), F.round("mean_recall", 6).alias("mean_recall"), "n_hits")


def _turns(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    hit = lambda p: F.struct(p.cast("string").alias("path"), F.concat(F.lit("§ "), p.cast("string")).alias("citation"), F.lit("").alias("heading"))
    result = F.struct(F.col("question").alias("query"), F.when(F.col("conv_id") % 3 > 0, F.array(hit(F.col("conv_id")), hit(F.col("conv_id") + 1))).alias("hits"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("array<string>").alias("sections"))
    call = F.struct(F.when(F.col("conv_id") % 5 == 0, "lookup").otherwise("search").alias("name"), F.create_map(F.lit("query"), F.col("question")).alias("arguments"), result.alias("result"))
    d = by.withColumn("question", F.coalesce(evaluation.question_of(F.col("messages")), F.lit("")))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("see § "), F.col("conv_id"))).otherwise("nothing")
    return d.select(F.col("conv_id").alias("turn_id"), "question", F.array(call).cast(evaluation.TRACE).alias("trace"), answer.alias("answer"), F.when(F.col("conv_id") % 4 == 0, "out_of_scope").otherwise("question").alias("kind"), F.when(F.col("conv_id") % 4 > 0, F.array(F.col("conv_id").cast("string"))).alias("expected_paths"))


@query
def h3_traces(spark, sf_dir):
    return evaluation.derive_trace(_turns(spark, sf_dir)).select("turn_id", F.array_join("search_queries", "|").alias("queries"), F.col("num_searches").cast("long").alias("num_searches"), "top_result_used")


@query
def h6_retrieved_paths(spark, sf_dir):
    return _turns(spark, sf_dir).select("turn_id", F.array_join(evaluation.retrieved_paths(F.col("trace")), ",").alias("paths"))


def _scored_turns(spark, sf_dir):
    loaded = fx.history_nodes(spark, sf_dir).where("node_id % 2 = 1").select("path")
    return evaluation.score_turns(_turns(spark, sf_dir), loaded.unionByName(loaded.select(F.lit("none").alias("path"))))


@query
def h7_turn_scores(spark, sf_dir):
    return _scored_turns(spark, sf_dir).select("turn_id", "retrieval_hit", "cite_hit", "abstained")


@query
def h7_by_kind(spark, sf_dir):
    return evaluation.score_kinds(_scored_turns(spark, sf_dir))


@query
def h8_daily_quota(spark, sf_dir):
    out = evaluation.daily_quota(fx.calls(spark, sf_dir), F.lit(2).cast("long"))
    return out.select("call_id", F.col("used").cast("long").alias("used"), "allowed", "remaining")


@query
def h8_streamed_quota(spark, sf_dir):
    """The same from a stream with state, replayed from the table as one batch and the end of it."""
    calls = fx.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(calls.schema).parquet(f"{sf_dir}/events.parque[t]")
    made = stream.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    top = scratch.folder(spark, "quota-stream")
    stateful.append_to(stateful.daily_quota(made, F.lit(2), "0 seconds"), f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("call_id", "used", "allowed", "remaining")


@query
def h8_usage(spark, sf_dir):
    return evaluation.usage(fx.calls(spark, sf_dir), evaluation.quota_of(fx.tier(F.col("key")))).select("key", "day", "used", "n_refused", "remaining")


@query
def h9_features(spark, sf_dir):
    asked = fx.calls(spark, sf_dir).select("call_id", fx.tier(F.col("key")).alias("tier"), F.element_at(F.array(F.lit("search"), F.lit("export"), F.lit("bulk")), (F.col("call_id") % 3 + 1).cast("int")).alias("feature"))
    table = spark.createDataFrame([("free", ["search"]), ("solo", ["search", "export"]), ("firm", ["search", "export", "bulk"])], "tier string, features array<string>")
    return evaluation.allowed_features(asked, table).select("call_id", "allowed")


@query
def h10_chat_caps(spark, sf_dir):
    return evaluation.chat_caps(fx.calls(spark, sf_dir), daily=2, monthly=3_000).groupBy("month", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def h12_footers(spark, sf_dir):
    return evaluation.sources_footer(_turns(spark, sf_dir)).select("turn_id", F.array_join("footer", ",").alias("footer"))


@query
def h16_event_folds(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("tool_start", "delta", "delta", "done", "error", "tool_start")]), (F.col("event_id") % 6 + 1).cast("int"))
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("text"))
    return evaluation.fold_events(e).select("run_id", "answer", F.col("n_steps").cast("long").alias("n_steps"), F.col("n_failed").cast("long").alias("n_failed"), "state")
