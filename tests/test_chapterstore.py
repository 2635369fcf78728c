"""A corpus changed in place holds what one made anew would."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import chapterstore, ingest

DAY = "2026-01-01"


def corpus(spark):
    nodes = [(c * 1000, "code", str(c), None, f"Chapter {c}", False) for c in range(1, 6)] + [(c * 1000 + k, "code", f"{c}.{k}", str(c), f"Section {k}", k == 4) for c in range(1, 6) for k in range(1, 9)]
    nodes += [(9001, "rules", "1", None, "Rules", False), (9002, "rules", "1.1", "1", "First", False)]
    n = spark.createDataFrame(nodes, "node_id long, source string, path string, parent_path string, heading string, is_repealed boolean")
    v = n.where("parent_path is not null").select(F.col("node_id").alias("version_id"), "node_id", F.concat(F.lit("body "), "path").alias("body"), F.lit("2025-01-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("approved").alias("review_status"))
    return n, v.withColumn("content_hash", text.content_hash(F.col("body")))


def snapshot(spark, rows):
    """(source, path, heading, body)"""
    d = spark.createDataFrame(rows, "source string, path string, heading string, body string")
    return d.withColumn("chapter", text.chapter_of(F.col("path"))).withColumn("content_hash", text.content_hash(F.col("body")))


def chapters(spark, *names):
    return spark.createDataFrame([("code", c, f"Chapter {c}") for c in names], "source string, chapter string, title string")


def rows(df, *drop):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns) if c not in drop) for r in df.collect())))


@pytest.fixture
def held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chapterstore, "BUCKET_ROWS", 3)
    store = chapterstore.ChapterStore(spark, str(tmp_path / "corpus"))
    store.create(*corpus(spark))
    return store


def whole(bodies, c):
    return [("code", f"{c}.{k}", f"Section {k}", bodies.get(f"{c}.{k}", f"body {c}.{k}")) for k in range(1, 9) if f"{c}.{k}" not in bodies or bodies[f"{c}.{k}"] is not None]


def test_one_amended_section_rewrites_its_bucket(spark, held):
    before = {(r.source, r.chapter, r.bucket): r.generation for r in held.units().collect()}
    assert len([k for k in before if k[:2] == ("code", "2")]) > 1
    changes = held.apply(snapshot(spark, whole({"2.5": "new"}, 2)), chapters(spark, "2"), F.lit(DAY).cast("date"))
    assert {r.kind: r["count"] for r in changes.groupBy("kind").count().collect()} == {"unchanged": 7, "amended": 1}
    after = {(r.source, r.chapter, r.bucket): r.generation for r in held.units().collect()}
    assert [k[:2] for k in after if before.get(k) != after[k]] == [("code", "2")]
    assert "dynamicpruning" in held.versions(held.units().where("chapter = '2'"))._jdf.queryExecution().executedPlan().toString().lower()
    got = held.versions().where("node_id = 2005").orderBy("version_id").collect()
    assert [(r.body, str(r.effective_to), r.review_status) for r in got] == [("body 2.5", DAY, "approved"), ("new", "None", "pending")] and got[1].version_id == 9003


def test_nothing_changed_writes_nothing(spark, held):
    before = rows(held.units())
    held.apply(snapshot(spark, whole({}, 1)), chapters(spark, "1"), F.lit(DAY).cast("date"))
    assert rows(held.units()) == before


def test_snapshots_one_after_another_equal_the_whole_table(spark, held):
    nodes, versions = corpus(spark)
    rng = random.Random(4)
    for step in range(3):
        bodies = {f"{c}.{k}": rng.choice([None, f"text {step}", f"body {c}.{k}"]) for c in (1, 2, 4) for k in range(1, 9) if rng.random() < 0.3}
        some = [r for c in (1, 2, 4) for r in whole(bodies, c)] + [("code", f"2.{20 + step}", "Added", "added"), ("code", f"{7 + step}.1", "New", "of a new chapter")]
        p, c, day = snapshot(spark, some), chapters(spark, "1", "2", "4", str(7 + step)), F.lit(f"2026-0{step + 1}-01").cast("date")
        nodes, versions = ingest.apply_snapshot(nodes, versions, p, c, day)
        held.apply(p, c, day)
    path = lambda v, n: v.join(n.select("node_id", "source", "path"), "node_id")
    assert rows(held.nodes(), "node_id") == rows(nodes, "node_id")
    assert rows(path(held.versions(), held.nodes()), "node_id", "version_id") == rows(path(versions, nodes), "node_id", "version_id")
    ids = [r.node_id for r in held.nodes().collect()]
    assert len(ids) == len(set(ids))


def test_killed_before_the_switch(spark, held, monkeypatch):
    before = rows(held.nodes()), rows(held.versions())

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(chapterstore.ChapterStore, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            held.apply(snapshot(spark, whole({"3.1": "lost"}, 3)), chapters(spark, "3"), F.lit(DAY).cast("date"))
    assert (rows(held.nodes()), rows(held.versions())) == before


def test_texts_are_not_stored_on_their_way(spark, held, monkeypatch):
    """Old texts go from their buckets to the new ones: no table of all versions is stored between, and closed ones end on the day."""
    names = []
    kept = chapterstore.stored
    monkeypatch.setattr(chapterstore, "stored", lambda df, name, *more: names.append((name, "body" in df.columns)) or kept(df, name, *more))
    held.apply(snapshot(spark, whole({"2.1": "new text", "2.2": None}, 2)), chapters(spark, "2"), F.lit(DAY).cast("date"))
    assert not any(body for _, body in names)
    got = {(r.node_id, str(r.effective_to), r.review_status) for r in held.versions().where("node_id in (2001, 2002, 2003)").collect()}
    assert got == {(2001, DAY, "approved"), (2001, "None", "pending"), (2002, DAY, "approved"), (2003, "None", "approved")}
