"""Stored indexes: vectors in cells, postings in segments."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ann, fulltext, retrieval, textindex

SCHEMA = "version_id long, embedding array<double>"


def vectors(spark, n, seed, clusters=12, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = [(i, (centres[i % clusters] * (1 + i % 3) + rng.normal(size=dim) * 0.5).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("clusters", [12, 400])
def test_cells_find_what_the_exact_search_finds(spark, tmp_path, monkeypatch, clusters):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    monkeypatch.setattr(ann, "PART_QUERIES", 3)
    docs = vectors(spark, 1200, clusters, clusters)
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24)], SCHEMA)
    docs = docs.unionByName(odd)
    model = ann.fit(docs)
    ann.write_index(docs, model, str(tmp_path / "index"))
    rows, again = ann.read_index(spark, str(tmp_path / "index"))
    assert rows.count() == 1200 and np.array_equal(again.books, model.books) and again.probes == model.probes
    queries = docs.where("version_id % 20 = 0 or version_id > 9000").withColumnRenamed("version_id", "query_id")
    found = ann.search(docs, queries, rows, again, limit=10)
    exact = retrieval.vector_search(docs, queries, limit=10)
    assert exact.select("query_id").distinct().count() == 60
    n = ann.recall(found, exact).agg(F.sum("n_found").alias("f"), F.sum("n_exact").alias("n")).first()
    assert n.n == 600 and n.f >= 0.9 * n.n
    # What is found has its exact score; all cells and all rows give the exact answer.
    scores = {(r.query_id, r.version_id): r.score for r in retrieval.vector_search(docs, queries, limit=1200).collect()}
    assert all(abs(scores[r.query_id, r.version_id] - r.score) < 1e-12 for r in found.collect())
    monkeypatch.setattr(ann, "RESCORED", 200)
    everything = ann.search(docs, queries, rows, again, limit=10, probes=10**6)
    assert {tuple(r)[:2] for r in everything.collect()} == {(r.query_id, r.version_id) for r in exact.collect()}


def test_rows_can_be_added(spark, tmp_path):
    docs = vectors(spark, 600, 3)
    model = ann.fit(docs.where("version_id < 400"))
    ann.write_index(docs.where("version_id < 400"), model, str(tmp_path / "index"))
    ann.write_index(docs.where("version_id >= 400"), model, str(tmp_path / "index"), mode="append")
    rows, model = ann.read_index(spark, str(tmp_path / "index"))
    assert rows.select("version_id").distinct().count() == rows.count() == 600


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], SCHEMA)
    assert ann.fit(none) is None and ann.fit(none.limit(0)) is None
    assert retrieval.vector_search(none, none.withColumnRenamed("version_id", "query_id")).count() == 0


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 40)
    docs = vectors(spark, 300, 5).repartition(5)
    docs = docs.unionByName(docs.where("version_id < 20").withColumn("version_id", F.col("version_id") + 1000))
    rows = {r.version_id: np.array(r.embedding) for r in docs.collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    got = {}
    for r in retrieval.vector_search(docs, docs.where("version_id % 9 = 0").withColumnRenamed("version_id", "query_id"), limit=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.version_id))
    for q, hits in got.items():
        want = sorted(unit, key=lambda k: (-round(float((unit[k] * unit[q]).sum()), 12), k))[:6]
        assert [v for _, v in sorted(hits)] == want


TEXTS = "version_id long, heading string, body string"
WORDS = ["tenant", "landlord", "theft", "weapons", "deceptive", "practices", "juvenile", "the", "of", "notice"]


def a_text(rng, n):
    return " ".join(rng.choice(WORDS[: rng.choice([3, 10])]) for _ in range(n))


def some_texts(rng, ids):
    return [(i, rng.choice([None, "", a_text(rng, 2)]), rng.choice([None, "", a_text(rng, 5), a_text(rng, 40), a_text(rng, 200)])) for i in ids]


ASKED = ["tenant", "tenant landlord", "theft or weapons deceptive", '"deceptive practices"', 'notice -theft', 'juvenile -"tenant landlord"', "tenant tenant", "of the", "absent", "", "weapons theft notice practices", '"theft the weapons" or juvenile']


def plain_search(rows, queries, limit, english):
    """Every document against every query, by the definition alone."""
    out = []
    for q, query in queries:
        scored = []
        for i, heading, body in rows:
            words = [(k + 1, w, where) for where, t in (("A", heading), ("B", body)) for w in (t or "").split() for k in (0,)]
            words = [(k + 1, w, where) for k, (_, w, where) in enumerate(words)]
            lexemes = [(p, fulltext.stem(w) if english else w, where) for p, w, where in words if not (english and w in fulltext.STOP_WORDS)]
            best = None
            for clauses in fulltext.read_query(query, english):
                holds = lambda terms: any(all((p + d) in {x for x, w, _ in lexemes if w == lexeme} for lexeme, d in terms) for p in range(-9, len(words) + 9))  # noqa: E731, B023
                if all(holds(terms) == wanted for wanted, terms in clauses):
                    names = {lexeme for wanted, terms in clauses if wanted for lexeme, _ in terms}
                    score = fulltext.cover_density([(p, where, w) for p, w, where in lexemes if w in names], names)
                    best = score if best is None else max(best, score)
            if best is not None:
                scored.append((-round(best, 9), i))
        out += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def same_hits(got, want):
    assert sorted((r.query_id, r.version_id, round(r.score, 9), r["rank"]) for r in got.collect()) == want


@pytest.mark.parametrize("english", [True, False])
def test_stored_search_is_the_full_search(spark, tmp_path, monkeypatch, english):
    monkeypatch.setattr(textindex, "PART_DOCS", 40)
    monkeypatch.setattr(textindex, "QUERIES", 5)
    rows = some_texts(random.Random(1), range(-20, 130))
    docs = spark.createDataFrame(rows, TEXTS)
    queries = list(enumerate(ASKED))
    index = textindex.Index(spark, str(tmp_path / "index"), english)
    assert index.search(spark.createDataFrame(queries, "query_id long, query string")).count() == 0
    index.build(docs)
    got = index.search(spark.createDataFrame(queries, "query_id long, query string"), limit=7)
    want = plain_search(rows, queries, 7, english)
    same_hits(got, want)
    same_hits(fulltext.search(fulltext.postings(docs, "version_id", english=english), spark.createDataFrame(queries, "query_id long, query string"), limit=7, english=english), want)


def test_upkeep_in_any_order_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PART_DOCS", 40)
    monkeypatch.setattr(textindex, "MERGED", 2)
    rng = random.Random(2)
    table = {r[0]: r for r in some_texts(rng, range(60))}
    tokenised = []
    tokens = textindex.Index._tokens
    monkeypatch.setattr(textindex.Index, "_tokens", lambda self, docs: (tokenised.append(docs.count()), tokens(self, docs))[1])
    index = textindex.Index(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(list(table.values()), TEXTS))
    for _ in range(4):
        before = spark.createDataFrame(list(table.values()), TEXTS)
        for i in rng.sample(sorted(table), 5):
            table[i] = (i, table[i][1], a_text(rng, 30))  # amended
        for i in rng.sample(sorted(table), 3):
            table[i] = (i, a_text(rng, 3), table[i][2])  # a new heading
        for i in rng.sample(sorted(table), 4):
            del table[i]
        table |= {r[0]: r for r in some_texts(rng, [rng.randrange(1000) for _ in range(4)])}
        changed, removed = textindex.changed_documents(before, spark.createDataFrame(list(table.values()), TEXTS))
        index.update(changed, removed)
    assert sorted(r.version_id for r in index.documents().collect()) == sorted(table)
    fresh = textindex.Index(spark, str(tmp_path / "fresh"))
    fresh.build(spark.createDataFrame(list(table.values()), TEXTS))
    rows = lambda x: sorted(map(str, x.postings(x.state()).select("version_id", "lexeme", "places").collect()))
    assert rows(index) == rows(fresh)
    same_hits(index.search(spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string"), limit=9), plain_search(list(table.values()), list(enumerate(ASKED)), 9, True))
    assert tokenised[0] == 60 and max(tokenised[1:-1]) <= 16 and len(index.state()) < 5


def test_an_update_without_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    index = textindex.Index(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame([(1, "", "tenant"), (2, "", "landlord")], TEXTS))

    def killed(self, segments):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(textindex.Index, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            index.update(spark.createDataFrame([(1, "", "theft")], TEXTS), spark.createDataFrame([(2,)], "version_id long"))
    asked = spark.createDataFrame([(0, "tenant or landlord"), (1, "theft")], "query_id long, query string")
    assert sorted((r.query_id, r.version_id) for r in index.search(asked).collect()) == [(0, 1), (0, 2)]


def test_few_blocks_are_read(spark, tmp_path, monkeypatch):
    """Of two words that every document has, only documents that may be among the best have their positions read."""
    rng = random.Random(3)
    rows = [(i, "", "tenant theft " * 30 if i % 200 == 0 else "tenant " + "filler " * rng.randrange(5) + "theft") for i in range(4000)]
    index = textindex.Index(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(rows, TEXTS))
    chosen = []
    scored = textindex.Index._scored
    monkeypatch.setattr(textindex.Index, "_scored", lambda self, rows, c, terms: (chosen.append(c.select("lexeme", "block").distinct().count()), scored(self, rows, c, terms))[1])
    got = index.search(spark.createDataFrame([(0, "tenant theft")], "query_id long, query string"), limit=10)
    assert [r.version_id % 200 for r in got.collect()] == [0] * 10
    assert sum(chosen) < 4000 // textindex.BLOCK_DOCS


def test_texts_are_tokenised_once_and_blocks_read_alone(spark, tmp_path):
    """Writing a segment takes no sample of its postings, and reading it back joins nothing; groups may lie over batches."""
    docs = spark.createDataFrame([(i, "the head" if i % 3 else "", f"the word w{i % 5} the end") for i in range(-40, 260)], "version_id long, heading string, body string")
    held = textindex.Index(spark, str(tmp_path / "index"), english=False)
    post = held._tokens(docs)
    plan = textindex._rows(post, 2)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        held.build(docs)
        back = held.postings(held.state())
        assert "Join" not in back._jdf.queryExecution().executedPlan().toString()
        rows = lambda d: sorted((r.version_id, r.lexeme, list(r.places)) for r in d.collect())
        assert rows(back) == rows(post)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_phrase_that_only_the_least_likely_documents_hold(spark, tmp_path):
    """The first documents by bound hold the words, but not the phrase; the others are looked at all the same."""
    rows = [(i, "", "tenant of theft tenant") if i < 40 else (i, "", "theft " * 5 + "filler " + "tenant " * 5) for i in range(300)]
    index = textindex.Index(spark, str(tmp_path / "index"), english=False)
    index.build(spark.createDataFrame(rows, TEXTS))
    asked = [(0, '"theft tenant"'), (1, "theft tenant"), (2, '"theft tenant"')]
    got = index.search(spark.createDataFrame(asked, "query_id long, query string"), limit=5)
    same_hits(got, plain_search(rows, asked, 5, False))


def test_density_of_all_documents_at_once():
    """The same as one by one, whatever lies before, between and behind the covers."""
    rng = random.Random(4)
    for _ in range(300):
        names = [f"w{k}" for k in range(rng.randrange(1, 4))]
        texts = [[rng.choice([*names, "x"]) for _ in range(rng.randrange(1, 25))] for _ in range(5)]
        head = rng.randrange(4)
        at = lambda t, x: [2 * p + (p <= head) for p, w in enumerate(t, 1) if w == x]  # noqa: E731, B023
        held = [i for i, t in enumerate(texts) if all(x in t for x in names)]

        def read(x):
            own = [i for i in held]  # noqa: B023, C416
            lists = [at(texts[i], x) for i in own]  # noqa: B023
            return np.array(own, np.int64), np.append(0, np.cumsum([len(v) for v in lists])).astype(np.int64), np.array([p for v in lists for p in v], np.int32)

        ids, scores = textindex._densities(np.array(held, np.int64), [(True, [(x, 0)]) for x in names], read)
        want = [round(fulltext.cover_density([(p // 2, "A" if p & 1 else "B", x) for x in names for p in at(texts[i], x)], set(names)), 9) for i in held]
        assert ids.tolist() == held and scores.tolist() == want


def test_long_batches_are_read_in_pieces(spark):
    """A batch of more words than are looked at at a time gives the postings of its rows, and no piece has more."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 1500]))) for _ in range(900)]
    docs = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], TEXTS).coalesce(1)
    got = {(r.version_id, r.lexeme): [p.pos for p in r.at] for r in fulltext.postings(docs, "version_id").collect()}
    want = {}
    for i, t in enumerate(texts):
        for p, w in enumerate(t.split(), 1):
            if w not in fulltext.STOP_WORDS:
                want.setdefault((i, fulltext.stem(w)), []).append(p)
    assert sum(len(t.split()) for t in texts) > fulltext.WORDS and got == want
    lists = pa.array([t.split() for t in texts])
    pieces = list(fulltext._pieces(lists))
    assert [a for a, _ in pieces[1:]] == [z for _, z in pieces[:-1]] and (pieces[0][0], pieces[-1][1]) == (0, 900)
    assert all(len(lists[a:z].flatten()) <= fulltext.WORDS for a, z in pieces) and len(pieces) > 1


def test_queries_meet_cells_a_few_at_a_time():
    """A batch of many queries that ask many cells gives its rows in small batches."""
    rng = np.random.default_rng(6)
    x, centroids = rng.normal(size=(400, 8)), rng.normal(size=(64, 8))
    b = pa.RecordBatch.from_arrays([pa.array(range(401)), pa.array([*x.tolist(), None])], ["query_id", "embedding"])
    made = list(ann._asking(b, centroids, 50))
    assert len(made) > 1 and max(m.num_rows for m in made) <= ann.ASKED_ROWS
    rows = pa.Table.from_batches(made)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert rows["query_id"].to_pylist() == np.repeat(np.arange(400), 50).tolist()
    assert rows["cell"].to_pylist() == np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :50].ravel().tolist()
    assert np.array_equal(np.array(rows["q"].to_pylist()), np.repeat(unit, 50, axis=0))


def test_tables_of_scores_stay_small(monkeypatch):
    """A block of queries is scored a part at a time, with the result of the whole."""
    rng = np.random.default_rng(7)
    sizes, better = [], retrieval._better
    monkeypatch.setattr(retrieval, "_better", lambda best, x, ids, q, limit: (sizes.append(len(q)), better(best, x, ids, q, limit))[1])
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(900, 16)), rng.normal(size=(700, 16))))
    best = None
    for k in range(0, 900, 300):
        best = retrieval._best_so_far(best, x[k : k + 300], np.arange(k, k + 300), q, 5)
    assert max(sizes) <= retrieval.AT_ONCE
    got = np.concatenate([np.stack([no + k * retrieval.AT_ONCE, ids]) for k, (no, ids, _) in enumerate(best)], axis=1)
    want = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert got[0].tolist() == np.repeat(np.arange(700), 5).tolist() and got[1].tolist() == want.ravel().tolist()


def test_loads_follow_cores_and_not_questions():
    """A block of the index moves once for each load: more questions make no more of them, until a load is full."""
    assert [textindex._loads(n, 3, 8) for n in (1, 300, 10_000, 20_000, 40_000)] == [1, 2, 6, 6, 6]
    assert textindex._loads(80_000, 3, 8) == 10 and textindex._loads(10_000, 40, 8) == 2 and textindex._loads(0, 1, 8) == 1


def test_the_best_of_a_query_come_from_few_parts(spark):
    """Texts are dealt to as many parts as keep the cores busy, each of which sends the best of every query."""
    docs = spark.range(200).selectExpr("id version_id", "concat('heading ', id) heading")
    queries = spark.range(retrieval.FEW + 1).selectExpr("id query_id", "concat('heading ', id) query")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        found = retrieval._trigram_blocks(docs, queries, 0.1, 3, "heading")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism})" in plan
