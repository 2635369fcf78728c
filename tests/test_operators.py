"""Corpus operators on small literal tables."""

import datetime as dt
import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit, browse, evaluation, fulltext, ingest, links, retrieval, temporal

D = dt.date
VERSION = "version_id long, node_id long, body string, effective_from date, effective_to date, review_status string, content_hash string"
NODE = "node_id long, source string, path string, parent_path string, heading string, is_repealed boolean"


def versions(spark, rows):
    return spark.createDataFrame([(i, n, b, f, t, s, b) for i, n, b, f, t, s in rows], VERSION)


@pytest.fixture(scope="module")
def law(spark):
    """Chapters 232, 497, 498, 499, 501, 501A and sections of 714; 714.99 is repealed, 714.2 pending."""
    tops = [(100 + i, "code", c, None, f"Chapter {c}", False) for i, c in enumerate(("30", "232", "497", "498", "499", "501", "501A", "714"))]
    heads = {"714.1": "Theft defined", "714.2": "Degrees of theft", "714.8": "Fraudulent practices", "714.16": "Consumer fraud", "714.99": "Gone"}
    nodes = tops + [(i, "code", p, "714", h, p == "714.99") for i, (p, h) in enumerate(heads.items(), 1)] + [(50, "rules", "32", None, "Conduct", False), (51, "rules", "32:1.7", "32", "Conflict of interest", False)]
    bodies = {1: "Theft is a deceptive practice. It is a crime.", 3: "A fraudulent practice violates section 714.16 and chapters 497, 498, or 499.", 4: "'merchant' means a person engaged in the business of selling goods or services. Consumers are protected.", 5: "Old.", 51: "A lawyer shall not represent a client if there is a conflict."}
    v = [(n * 10, n, b, D(2025, 1, 1), None, "approved") for n, b in bodies.items()] + [(20, 2, "Degrees.", D(2025, 1, 1), None, "pending")]
    return spark.createDataFrame(nodes, NODE), versions(spark, v)


def test_as_of(spark):
    v = versions(spark, [(1, 1, "a", D(2024, 1, 1), D(2024, 2, 1), "approved"), (2, 1, "b", D(2024, 2, 1), None, "approved"), (3, 1, "c", D(2024, 2, 1), None, "pending"), (4, 2, "d", D(2024, 5, 1), None, "rejected")])
    days = [D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 31), D(2024, 2, 1), D(2030, 1, 1)]
    probes = spark.createDataFrame([(n, d) for n in (1, 2) for d in days], "node_id long, day date")
    got = {(r.node_id, r.day): r.version_id for r in temporal.versions_at(v, probes).collect()}
    assert got == {(1, days[1]): 1, (1, days[2]): 1, (1, days[3]): 2, (1, days[4]): 2}
    assert {(r.node_id, r.day): r.version_id for r in temporal.versions_at(v, probes, True).collect()}[2, days[4]] == 4
    assert [r.version_id for r in temporal.current_versions(v).collect()] == [2]
    assert [(r.version_id, r.place) for r in temporal.history(v, 1).orderBy("place").collect()] == [(2, 1), (1, 2)]


def test_amendments(spark):
    v = versions(spark, [(1, 1, "a", D(2024, 1, 1), D(2024, 3, 1), "pending"), (2, 1, "b", D(2024, 3, 1), None, "approved"), (3, 2, "c", D(2024, 4, 1), D(2024, 5, 1), "approved"), (4, 3, "d", D(2024, 2, 1), None, "approved")])
    nodes = spark.createDataFrame([(1, "1", False), (2, "2", True), (3, "3", False)], "node_id long, path string, is_repealed boolean")
    got = temporal.recent_amendments(nodes, v, F.lit("2024-02-01").cast("date")).collect()
    assert {r.version_id: r.kind for r in got} == {2: "amended", 3: "repealed", 4: "new"}
    assert [r.version_id for r in temporal.recent_amendments(nodes, v, F.lit("2024-02-01").cast("date"), 1).collect()] == [3]


def test_review(spark):
    v = versions(spark, [(1, 1, "a", D(2024, 1, 1), None, "pending"), (2, 2, "b", D(2024, 1, 1), None, "approved"), (3, 3, "c", D(2024, 1, 1), None, "pending")])
    got = {r.version_id: (r.review_status, r.review_outcome) for r in temporal.review(v, spark.createDataFrame([(1,), (2,)], "version_id long"), "rejected").collect()}
    assert got == {1: ("rejected", "changed"), 2: ("approved", "skipped"), 3: ("pending", None)}


def test_ingest_twice_amend_and_repeal(spark):
    """Two sources with equal paths, four snapshots: b is repealed and comes back, a goes to AMENDED a and back to a."""
    chapters = spark.createDataFrame([("x", "1", "General", False, "m"), ("y", "1", "Other", True, "m")], "source string, chapter string, title string, reserved boolean, metadata string")

    def snap(**bodies):
        rows = [(s, f"1.{k[1:]}", "1", f"Head {k}", b, b, [f"note {b}"]) for s in "xy" for k, b in bodies.items() if s == "x" or k == "s1"]
        return spark.createDataFrame([(*r[:4], r[4] if r[0] == "x" else "y text", r[5] if r[0] == "x" else "y text", r[6]) for r in rows], "source string, path string, chapter string, heading string, body string, content_hash string, history_brackets array<string>")

    nodes, v = spark.createDataFrame([], NODE), versions(spark, [])
    steps = [("2025-01-01", dict(s1="a", s2="b"), (3, 0, 0, 0)), ("2025-02-01", dict(s1="a", s2="b"), (0, 0, 0, 3)), ("2025-03-01", dict(s1="AMENDED a"), (0, 1, 1, 1)), ("2025-04-01", dict(s1="a", s2="b"), (1, 1, 0, 1))]
    for step, (day, bodies, want) in enumerate(steps):
        p, date = snap(**bodies), F.lit(day).cast("date")
        changes = ingest.diff(p, chapters, nodes, v)
        s = ingest.summary(changes).first()
        assert (s.n_added, s.n_amended, s.n_repealed, s.n_unchanged) == want, step
        run = ingest.run_row(changes, ingest.validate(p, changes), date, date).first()
        assert (run.status, run.n_errors) == (("failed", 1) if step == 2 else ("applied", 0))  # one of three repealed
        after = ingest.apply_nodes(nodes, p, chapters, changes)
        nodes = spark.createDataFrame(after.collect(), after.schema)
        new = ingest.apply_versions(v, nodes, p, changes, date)
        v = spark.createDataFrame(new.collect(), new.schema)
    where = {r.node_id: (r.source, r.path) for r in nodes.collect()}
    assert len(where) == nodes.count() == 5 and set(where.values()) == {("x", "1"), ("x", "1.1"), ("x", "1.2"), ("y", "1"), ("y", "1.1")}
    rows = v.collect()
    got = {(*where[r.node_id], r.body, r.effective_from, r.effective_to, r.review_status, r.enacted_by) for r in rows}
    pending = lambda *x: (*x[:5], "pending", x[5])
    assert len(rows) == len(got) == len({r.version_id for r in rows}) == 6
    assert got == {
        pending("x", "1.1", "a", D(2025, 1, 1), D(2025, 3, 1), "note a"),
        pending("x", "1.1", "AMENDED a", D(2025, 3, 1), D(2025, 4, 1), "note AMENDED a"),
        pending("x", "1.1", "a", D(2025, 4, 1), None, "note a"),
        pending("x", "1.2", "b", D(2025, 1, 1), D(2025, 3, 1), "note b"),
        pending("x", "1.2", "b", D(2025, 4, 1), None, "note b"),
        pending("y", "1.1", "y text", D(2025, 1, 1), None, "note a"),
    }
    started = {r.version_id: r.effective_from for r in rows}
    assert [started[i] for i in sorted(started)] == sorted(started.values())  # later snapshots have greater ids
    assert {(r.source, r.path): (r.is_repealed, r.metadata) for r in nodes.collect() if r.parent_path is None} == {("x", "1"): (False, "m"), ("y", "1"): (True, "m")}
    assert not any(r.is_repealed for r in nodes.collect() if r.parent_path)
    (outcome,) = {r.review_outcome for r in temporal.review(v, v.where("effective_to is null").select("version_id"), "approved").where("effective_to is null").collect()}
    assert outcome == "changed"


def test_issues(spark):
    changes = lambda *kinds: spark.createDataFrame([("x", f"1.{i}", k, "x", p) for i, (k, p) in enumerate(kinds)], "source string, path string, kind string, content_hash string, prior_hash string")
    parsed = spark.createDataFrame([("x", "1.1", " "), ("x", "1.2", "h"), ("x", "1.2", "h"), ("y", "1.1", "h")], "source string, path string, heading string")
    codes = lambda df: sorted((r.severity, r.code) for r in df.collect())
    assert codes(ingest.validate(parsed, changes(("unchanged", "x")))) == [("error", "duplicate_path"), ("error", "missing_heading")]
    fine = spark.createDataFrame([("x", "1.1", "h")], "source string, path string, heading string")
    assert codes(ingest.validate(fine, changes(("added", None), *[("repealed", "x")] * 5))) == [("error", "unannounced_repeal_wave")]
    assert codes(ingest.validate(fine, changes(*[("added", None)] * 100, ("repealed", "x")))) == []
    assert codes(ingest.validate(fine, changes(*[("added", None)] * 9, ("repealed", "x")))) == []
    assert codes(ingest.validate(fine, changes(("unchanged", "y"), ("amended", "x")))) == [("error", "hash_drift_amended"), ("error", "hash_drift_unchanged")]
    refs = spark.createDataFrame([("x", "1.1", "1.1"), ("x", "1.1", "9.9")], "source string, path string, reference string")
    chapters = spark.createDataFrame([("1", False, 0), ("2", True, 0), ("3", False, 4)], "chapter string, reserved boolean, n_rules long")
    assert codes(ingest.validate(fine, changes(("unchanged", "x")), refs, chapters)) == [("warning", "unparsed_content_chapter"), ("warning", "unresolved_cross_reference")]


def test_lookup(spark, law):
    nodes, v = law
    asked = {"714.16": "section", "§ 714.8(1)": "section", "714.404": "missing", "chapter 714": "chapter", "714.2": "no_version", "nothing": "parse_error"}
    q = spark.createDataFrame([(i, "code", t) for i, t in enumerate(asked)], "query_id long, source string, query string")
    got = {r.query: r for r in links.lookup(q, nodes, v).collect()}
    assert {t: r.outcome for t, r in got.items()} == asked
    assert got["714.404"].candidates == ["714.1", "714.16", "714.2", "714.8", "714.99"]
    assert got["chapter 714"].n_sections == 4 and got["714.16"].n_sections == 0
    assert [tuple(r) for r in links.chapter_sections(links.lookup(q, nodes, v), nodes).collect()] == [("code", "714", p) for p in ("714.1", "714.2", "714.8", "714.16")]
    known = spark.createDataFrame([("code",)], "source string")
    both = q.unionByName(q.selectExpr("query_id + 100 as query_id", "'elsewhere' as source", "query"))
    outcomes = {r.query_id: r.outcome for r in links.lookup(both, nodes, v, sources=known).collect()}
    assert [outcomes[i] for i in range(len(asked))] == list(asked.values())
    assert {outcomes[100 + i] for i, t in enumerate(asked) if t != "nothing"} == {"unknown_source"}
    sources = spark.createDataFrame([("code",), ("rules",)], "source string")
    any_source = links.lookup_any_source(spark.createDataFrame([(1, "32:1.7"), (2, "714.1"), (3, "9.9")], "query_id long, query string"), sources, nodes, v)
    assert {r.query_id: (r.source, r.outcome) for r in any_source.collect()} == {1: ("rules", "section"), 2: ("code", "section"), 3: ("code", "missing")}


LINKED = {
    "violates section 714.8": {"714.8"},
    "not more than 30 dollars under chapter 232": {"232"},
    "chapter 497, 498, or 499; see chapter 501 or 501A": {"497", "498", "499", "501", "501A"},
    "sections 714.1, 714.8 and 714.16": {"714.1", "714.8", "714.16"},
    "chapter 497 through 499": {"497"},
    "section 714.99 and section 714.404 and section 714.2": set(),
}


def test_links(spark, law):
    nodes, v = law
    texts = spark.createDataFrame([(1000 + i, "code", t) for i, t in enumerate(LINKED)], "node_id long, source string, body string")
    got = links.citation_links(texts, nodes, v).collect()
    for i, want in enumerate(LINKED.values()):
        assert {r.target_path for r in got if r.node_id == 1000 + i} == want
    edges = links.cross_references(nodes, v)
    assert {(r.from_version, r.to_node) for r in edges.collect()} == {(30, 4), (30, 102), (30, 103), (30, 104)}
    assert {(r.direction, r.node_id) for r in links.references_of(4, edges, v).collect()} == {("incoming", 3)}
    assert links.citation_links(texts.where("node_id = 1000").withColumn("node_id", F.lit(3).cast("long")), nodes, v).count() == 0


def test_citation_report(spark, law):
    nodes, v = law
    texts = spark.createDataFrame([(1, "code", "See 714.16, section 714.2, § 714.99, 714.404 and chapter 232 (not 7).")], "text_id long, source string, body string")
    got = audit.validate_citations(texts, nodes, v)
    assert [(r.raw.strip(), r.status) for r in got.orderBy("pos").collect()] == [("714.16", "valid"), ("section 714.2", "repealed"), ("§ 714.99", "repealed"), ("714.404", "not_found"), ("chapter 232 (not 7)", "valid")]
    assert all(texts.first().body[r.start : r.end] == r.raw for r in got.collect())
    r = audit.citation_report(got).first()
    assert (r.n_citations, r.n_valid, r.n_repealed, r.n_not_found) == (5, 2, 2, 1)


def test_quotes(spark, law):
    nodes, v = law
    bodies = ['§ 714.1 says “theft is a  DECEPTIVE practice.”', 'In 714.1: "Theft is a deceptive practise."', 'In 714.1: "nothing like it at all"', '"no citation here"', '"whatever it is" says 714.404', 'short "abc" 714.1']
    texts = spark.createDataFrame([(i, "code", b) for i, b in enumerate(bodies)], "text_id long, source string, body string")
    got = {r.text_id: r for r in audit.verify_quotes(texts, nodes, v).collect()}
    assert {i: r.status for i, r in got.items()} == {0: "exact", 1: "fuzzy", 2: "not_found", 3: "no_citation", 4: "section_unresolved"}
    want = difflib.SequenceMatcher(None, "theft is a deceptive practice.", "theft is a deceptive practise.", autojunk=False).ratio()
    assert got[1].score == pytest.approx(want) and got[1].passage == "Theft is a deceptive practice."
    given = audit.verify_quotes(texts.where("text_id = 3"), nodes, v, citation=F.lit("714.1")).first()
    assert given.status == "not_found" and given.path == "714.1"
    cites, quotes, fresh = audit.audit(texts, nodes, v, F.lit("2025-01-01").cast("date"))
    report = {r.text_id: r for r in audit.audit_report(cites, quotes, fresh).collect()}
    assert report[1].n_amended == 1 and "fuzzy" in report[1].quote_rows and report[0].quote_rows == "_No items._"


def test_audit_tables(spark, law):
    nodes, v = law
    bodies = ["See 714.1 and 714.404: “theft is a DECEPTIVE\npractice|”", "nothing", None]
    texts = spark.createDataFrame([(i, "code", b) for i, b in enumerate(bodies)], "text_id long, source string, body string")
    parts = audit.audit(texts, nodes, v, F.lit("2025-01-01").cast("date"))
    got = {r.text_id: r for r in audit.audit_tables(texts, nodes, *parts, "2025-01-01", url=F.concat(F.lit("u/"), "path")).collect()}
    assert set(got) == {0, 1, 2}
    rows = got[0].citations.split("\n")
    assert len(rows) == 4 and rows[1] == "|---|---|---|---|---|---|---|"
    assert rows[2].startswith("| valid | 714.1 | 714 | 714.1 | ") and rows[2].endswith(" | u/714.1 |  |") and rows[3].startswith("| not_found | 714.404 | 714 | 714.404 |  |  | 714.")
    assert len(rows[3].split(", ")) == audit.MOST_CANDIDATES
    (quote,) = got[0].quotes.split("\n")[2:]
    assert quote.split(" | ")[2:4] == ["theft is a DECEPTIVE practice\\|", "714.1"]
    assert "| Citations — total | 2 |" in got[0].summary and "| Sections amended since | 1 |" in got[0].summary and "| 714.1 |" in got[0].amended_since
    for i in (1, 2):
        assert got[i].citations == got[i].quotes == "_No items._" and "2025-01-01" in got[i].amended_since and "| Quotes — total | 0 |" in got[i].summary
    assert "skipped" in audit.audit_tables(texts, nodes, *parts, None).where("text_id = 1").first().amended_since


def test_definitions(spark, law):
    nodes, v = law
    got = audit.definitions(nodes, v, "merchant").collect()
    assert [(r.path, r.term, r.definition) for r in got] == [("714.16", "'merchant'", "a person engaged in the business of selling goods or services.")]
    assert audit.definitions(nodes, v, "merchant", chapter="32").count() == 0 == audit.definitions(nodes, v, " ").count()


def test_postings_keep_positions(spark):
    d = spark.createDataFrame([(1, "Consumer fraud", "It is the act of deceptive practices")], "version_id long, heading string, body string")
    got = {r.lexeme: [(x.pos, x.weight) for x in r.at] for r in fulltext.postings(d, "version_id").collect()}
    assert got == {"consum": [(1, "A")], "fraud": [(2, "A")], "act": [(6, "B")], "decept": [(8, "B")], "practic": [(9, "B")]}


def test_postings_match_plain_words(spark, sf_dir):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None, None), (-2, "", ""), (-3, "A b", "b a")]
    d = spark.createDataFrame(rows, "version_id long, heading string, body string").withColumn("copy", F.lit("x"))
    for english in (False, True):
        want = {}
        for i, h, b in rows:
            head = re.findall(r"[^\W_]+", (h or "").lower())
            for k, w in enumerate(head + re.findall(r"[^\W_]+", (b or "").lower()), 1):
                if not english or w not in fulltext.STOP_WORDS:
                    want.setdefault((i, fulltext.stem(w) if english else w), []).append((k, "A" if k <= len(head) else "B"))
        post = fulltext.postings(d, "version_id", "copy", english=english)
        assert {(r.version_id, r.lexeme): [tuple(x) for x in r.at] for r in post.collect()} == want
        assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()


def test_stored_index(spark, law, tmp_path):
    nodes, v = law
    post = fulltext.postings(retrieval.searchable(nodes, v), "version_id")
    fulltext.write_postings(post, str(tmp_path / "index"))
    stored = fulltext.read_postings(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "deceptive practices"), (2, "theft or lawyers")], "query_id long, query string")
    rows = lambda p, **k: sorted(map(tuple, fulltext.search(p, q, **k).collect()))
    assert rows(stored) == rows(post) != []
    assert [r[:3] for r in rows(stored)] == rows(stored, limit=None)
    assert re.search(r"PushedFilters: \[[^]]*lexeme", fulltext.search(stored, q)._jdf.queryExecution().executedPlan().toString())


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "Lawyer fees"), (2, "none")], "query_id long, query string")
    table = spark.createDataFrame([("lawyer", "counsel"), ("lawyer", "attorney"), ("Fees", "costs")], "term string, synonym string")
    assert [r.query for r in retrieval.expanded(q, synonyms=table).orderBy("query_id").collect()] == ["Lawyer fees attorney costs counsel", "none"]


def test_fulltext(spark, law):
    nodes, v = law
    post = fulltext.postings(retrieval.searchable(nodes, v), "version_id")
    ask = lambda *qs: spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    got = fulltext.search(post, ask("deceptive practices", "fraud -merchant", '"deceptive practice"', '"practice deceptive"', "theft or lawyers", '" or -', "the of"))
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, set()).add(r.version_id)
    assert by == {0: {10}, 2: {10}, 4: {10, 510}}
    assert fulltext.search(post, ask("fraudulent")).count() == 1
    # A heading weighs more than a body, and near terms more than far ones.
    d = fulltext.cover_density
    assert d([(1, "A", "x")], {"x"}) > d([(1, "B", "x")], {"x"})
    assert d([(1, "B", "x"), (2, "B", "y")], {"x", "y"}) > d([(1, "B", "x"), (9, "B", "y")], {"x", "y"}) > 0
    assert d([(1, "B", "x")], {"x", "y"}) == 0


def test_trigram_and_source_scope(spark, law):
    nodes, v = law
    q = spark.createDataFrame([(1, "consumer"), (2, "conflict")], "query_id long, query string")
    got = retrieval.trigram_search(retrieval.searchable(nodes, v), q).collect()
    assert [r.version_id for r in got if r.query_id == 1 and r["rank"] == 1] == [40]
    assert {r.version_id for r in got if r.query_id == 2} >= {510}
    assert 510 not in {r.version_id for r in retrieval.trigram_search(retrieval.searchable(nodes, v, "code"), q).collect()}
    assert retrieval.searchable(nodes, v, "nowhere").count() == 0


def test_trigrams_of_many_queries(spark, monkeypatch):
    """Many queries meet the texts in blocks, not as rows of pairs, with the results of the join, ties and long texts included."""
    rng = random.Random(5)
    words = ["the", "then", "there", "Öl", "öle", "straße", "x", "𝒜b", "consumer", "consumed"]
    say = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else say(6) + ("q" * (i % 300 if i % 11 == 0 else 0))) for i in range(400)], "version_id long, heading string")
    texts = [say(4) for _ in range(90)] + ["".join(chr(300 + i) for i in range(400)) + " the", "", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "version_id", "score", "rank").collect())
    monkeypatch.setattr(retrieval, "QUERY_SETS", 32)
    monkeypatch.setattr(retrieval, "TEXT_SETS", 64)
    for threshold in (0.1, 0.0):
        found = retrieval.trigram_search(docs, queries, threshold=threshold, limit=7)
        assert "Explode" not in found._jdf.queryExecution().analyzed().toString()
        got = rows(found)
        with monkeypatch.context() as m:
            m.setattr(retrieval, "FEW", 1_000)
            want = rows(retrieval.trigram_search(docs, queries, threshold=threshold, limit=7))
        assert got == want and len(want) > 300


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, 1.0, k) for k, i in enumerate(ids, 1)], "query_id long, version_id long, score double, rank int")


def test_fusion(spark):
    got = retrieval.fuse({"a": ranked(spark, [1, 2, 3]), "b": ranked(spark, [2, 4])}).orderBy("rank").collect()
    assert [r.version_id for r in got] == [2, 1, 4, 3]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and set(got[0].components) == {"a", "b"}
    tie = retrieval.fuse({"a": ranked(spark, [7]), "b": ranked(spark, [3])}).orderBy("rank").collect()
    assert [r.version_id for r in tie] == [7, 3]


def test_vectors(spark, monkeypatch):
    rng = np.random.RandomState(0)
    m = rng.randn(40, 8)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(98, None), (99, [0.0] * 8)], "version_id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    twins = d.unionByName(d.selectExpr("version_id + 1000 as version_id", "embedding")).repartition(3)
    q = d.withColumnRenamed("version_id", "query_id")
    for block, rows in ((2_048, 4_096), (7, 5)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "VECTOR_ROWS", rows)
        got = retrieval.vector_search(twins, q, limit=5).orderBy("query_id", "rank").collect()
        near = [[int(i) for i in np.argsort(-(unit @ unit[k]))[:3]] for k in range(40)]
        assert [r.version_id for r in got] == [i for a, b, c in near for i in (a, a + 1000, b, b + 1000, c)]
    assert retrieval.vector_search(d, q.limit(0)).count() == 0 == retrieval.vector_search(d.limit(0), q).count()


def test_hybrid_hooks_and_pins(spark, law):
    nodes, v = law
    docs = retrieval.searchable(nodes, v)
    q = spark.createDataFrame([(1, "consumer fraud"), (2, "x")], "query_id long, query string")
    hits = retrieval.hybrid_search(docs, q)
    assert hits.where("query_id = 1 and rank = 1").first().path == "714.16"

    def broken(_):
        raise RuntimeError("no model")

    assert [r.query for r in retrieval.expanded(q, broken).orderBy("query_id").collect()] == ["consumer fraud", "x"]
    first = hits.where("query_id = 1").select("query_id", "version_id", "score", "rank")
    assert {r.version_id for r in retrieval.reranked(first, q, docs, None, 1).collect()} == {40}
    turned = retrieval.reranked(first, q, docs, lambda _, c: [i for i, _ in c][::-1], 1).first()
    assert turned.version_id == first.orderBy(F.desc("rank")).first().version_id
    assert retrieval.reranked(first, q, docs, lambda *_: broken(0), 1).first().version_id == 40
    pins = spark.createDataFrame([(1, 510)], "query_id long, version_id long")
    rows = retrieval.browse_search(docs, q, pins, limit=2).orderBy("place").collect()
    assert [(r.query_id, r.version_id, r.exact) for r in rows] == [(1, 510, True), (1, 40, False)]
    assert retrieval.tool_search(docs, nodes, q).where("rank = 1").first().chapter_heading == "Chapter 714"


def test_embedding_job(spark):
    v = spark.createDataFrame([(i, "h", f"b{i}", f"x{i}", f"x{i}" if i == 0 else "old") for i in range(5)], "version_id long, heading string, body string, content_hash string, embedding_source_hash string").coalesce(1)
    got = {r.version_id: r for r in retrieval.embed(v, batch=2).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(r.embedding) == 1024 and r.error is None and r.embedding_source_hash == f"x{i}" for i, r in got.items())
    short = retrieval.embed(v, lambda texts: [[1.0]] * (1 if len(texts) == 2 else len(texts)), batch=2).collect()
    assert all(r.embedding is None and "vectors" in r.error for r in short)
    assert np.linalg.norm(retrieval.fake_embedding("a")) == pytest.approx(1) and retrieval.fake_embedding("a") != retrieval.fake_embedding("b")


def test_browse(spark, law):
    nodes, v = law
    sources = spark.createDataFrame([("code",), ("rules",), ("empty",)], "source string")
    assert {r.source: (r.n_chapters, r.n_sections) for r in browse.list_sources(sources, nodes).collect()} == {"code": (8, 4), "rules": (1, 1), "empty": (0, 0)}
    assert [r.path for r in browse.list_chapters(nodes, "code").orderBy("place").collect()] == ["30", "232", "497", "498", "499", "501", "714", "501A"]
    sections = browse.chapter_detail(nodes, "code", "714", "C §").orderBy("place").collect()
    assert [r.path for r in sections] == ["714.1", "714.2", "714.8", "714.16"] and sections[0].citation == "C § 714.1" and sections[0].division == ""
    typed = nodes.withColumn("node_type", F.when(F.col("parent_path").isNull(), "chapter").otherwise("section"))
    types = spark.createDataFrame([("code", "chapter", 0, "Chapters"), ("code", "section", 1, "Sections"), ("rules", "part", 0, "Parts"), ("rules", "rule", 1, "Rules")], "source string, node_type string, level int, label string")
    assert {r.source: tuple(r)[1:] for r in browse.typed_sources(sources, typed, types).collect()} == {"code": ("chapter", 8, 4, "Sections"), "rules": ("part", 0, 0, "Rules"), "empty": (None, 0, 0, "Entries")}
    d = {r.path: r for r in browse.node_detail(nodes, v, links.cross_references(nodes, v)).collect()}
    assert (d["714.8"].n_links, d["714.8"].chapter_heading, d["714.2"].version_id) == (4, "Chapter 714", None)


def test_scores(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id long, path string, rank int")
    want = spark.createDataFrame([(1, "a"), (1, "z"), (1, "gone"), (2, "x"), (3, "gone")], "query_id long, path string")
    loaded = spark.createDataFrame([(p,) for p in "abcxz"], "path string")
    got = {r.query_id: (r.precision, r.recall, r.hit) for r in evaluation.score_rankings(ranks, want, loaded).collect()}
    assert got == {1: (0.5, 0.5, True), 2: (0.0, 0.0, False)}


CALL = {"name": "search", "arguments": {"query": "q"}, "result": {"query": None, "hits": [{"path": "32:1.10", "citation": "R. 32:1.10", "heading": ""}], "section": None, "chapter": None, "sections": None}}
BARE = {**CALL, "result": {**CALL["result"], "hits": []}}
OTHER = {**BARE, "name": "lookup", "result": {**BARE["result"], "section": "9.1"}}


@pytest.mark.parametrize(("trace", "answer", "used"), [([CALL], "by 32:1.10", True), ([CALL], "nothing", False), ([BARE], "32:1.10", None), ([OTHER], "9.1", None), ([BARE, CALL], "R. 32:1.10", True), ([], "x", None), ([CALL], None, False)])
def test_top_result_used(spark, trace, answer, used):
    turn = spark.createDataFrame([(1, trace, answer)], f"turn_id long, trace {evaluation.TRACE}, answer string")
    r = evaluation.derive_trace(turn).first()
    assert r.top_result_used is used and r.num_searches == sum(c["name"] == "search" for c in trace) and r.num_tool_calls == len(trace)


def test_paths_and_footers(spark):
    hits = [{"path": p, "citation": "", "heading": ""} for p in ("b", "a", "b", None, "")]
    trace = [{**CALL, "result": {**CALL["result"], "hits": hits}}, OTHER, {**OTHER, "result": {**OTHER["result"], "section": None, "chapter": "9", "sections": ["9.1", "9.2"]}}]
    t = spark.createDataFrame([(1, trace, "see a and 9.2")], f"turn_id long, trace {evaluation.TRACE}, answer string")
    assert t.select(evaluation.retrieved_paths(F.col("trace"))).first()[0] == ["b", "a", "9.1", "9", "9.2"]
    assert evaluation.sources_footer(t).first().footer == ["a", "9", "9.2"]
    assert evaluation.sources_footer(t.withColumn("answer", F.lit("x")), most=2).first().footer == ["b", "a"]


def test_quota(spark):
    calls = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1 + i // 3, i)) for i in range(5)], "call_id long, key long, at timestamp_ntz")
    got = [(r.used, r.allowed, r.remaining) for r in evaluation.daily_quota(calls, F.lit(2).cast("long")).orderBy("call_id").collect()]
    assert got == [(1, True, 1), (2, True, 0), (3, False, 0), (1, True, 1), (2, True, 0)]
    assert evaluation.daily_quota(calls, F.lit(None).cast("long")).where("allowed and remaining is null").count() == 5
    caps = [r.code for r in evaluation.chat_caps(calls, daily=2, monthly=4).orderBy("call_id").collect()]
    assert caps == [200, 200, 429, 200, 503]
    # Many calls of one second, and seconds apart: the month's total counts all, in order of time and id.
    calls = spark.createDataFrame([(i, i, dt.datetime(2024, 1 + i % 2, 1, 0, 0, i // 7)) for i in range(40)], "call_id long, key long, at timestamp_ntz")
    assert [r.of_month for r in evaluation.chat_caps(calls).orderBy("at", "call_id").collect()] == [*range(1, 21), *range(1, 21)]
    tiers = spark.createDataFrame([("free",), ("solo",), ("firm",), ("custom",), ("odd",)], "t string").select(evaluation.quota_of(F.col("t"))).collect()
    assert [r[0] for r in tiers] == [200, 5000, 50000, None, 200]


def test_features(spark):
    table = spark.createDataFrame([("free", ["search"]), ("firm", ["search", "bulk"])], "tier string, features array<string>")
    asked = spark.createDataFrame([("free", "search"), ("free", "bulk"), ("firm", "bulk"), ("none", "search"), (None, "search"), ("firm", None)], "tier string, feature string")
    assert {(r.tier, r.feature): r.allowed for r in evaluation.allowed_features(asked, table).collect()} == {("free", "search"): True, ("free", "bulk"): False, ("firm", "bulk"): True, ("none", "search"): False, (None, "search"): False, ("firm", None): False}


def test_citation_payloads(spark, law):
    nodes, v = law
    texts = spark.createDataFrame([(1, "code", "See 714.16 and section 714.404."), (2, "code", "x" * 50 + " 714.1"), (3, "code", "none"), (4, "code", None)], "text_id long, source string, body string")
    got = {r.text_id: r for r in audit.citation_payloads(texts, nodes, v, most_chars=40).collect()}
    assert [(c.path, c.status, c.heading) for c in got[1].citations] == [("714.16", "valid", "Consumer fraud"), ("714.404", "not_found", None)]
    assert got[1].citations[0].excerpt.startswith("'merchant' means") and got[1].error is None and got[1].n_citations == 2
    assert got[2].error and got[2].citations == [] and (got[3].n_citations, got[3].error) == (0, None) == (got[4].n_citations, got[4].error)


def test_event_folds(spark):
    runs = {
        "ok": [("tool_start", "a"), ("delta", "x"), ("delta", "y"), ("done", None), ("delta", "late")],
        "bad": [("tool_start", "a"), ("tool_start", "b"), ("error", "no")],
        "open": [("tool_start", "a"), ("delta", "x")],
        "none": [("done", None)],
    }
    e = spark.createDataFrame([(k, i, *x) for k, v in runs.items() for i, x in enumerate(v)], "run_id string, seq long, type string, text string")
    got = {r.run_id: (r.answer, r.n_steps, r.n_completed, r.n_failed, r.state) for r in evaluation.fold_events(e).collect()}
    assert got == {"ok": ("xy", 1, 1, 0, "success"), "bad": ("The request failed: no", 2, 1, 1, "failed"), "open": ("x", 1, 1, 0, "running"), "none": ("(no answer returned)", 0, 0, 0, "success")}
    m = spark.createDataFrame([("user", [("text", "a"), ("image", "b"), ("text", "c")]), ("tool", [("text", "d")])], "role string, parts array<struct<type: string, text: string>>")
    assert [r.text for r in evaluation.flat_messages(m).collect()] == ["a\nc"]


def test_scope_is_below_the_ranking(spark, sf_dir):
    from palimpsest.plans import fixtures as fx

    docs = retrieval.searchable(fx.nodes(spark, sf_dir), fx.versions(spark, sf_dir), "en")
    plan = retrieval.trigram_search(docs, spark.createDataFrame([(1, "the")], "query_id long, query string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("= en")
    assert "Python" not in plan
    assert re.search("WindowGroupLimit", temporal.current_versions(fx.versions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString())
