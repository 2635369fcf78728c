"""Sources: probe files, rich text, rule books, pages, blobs, streams."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import evaluation
from palimpsest.sources import blobs, pages, probes, rtf, rules_text
from palimpsest.streaming import jobs


def section(number, heading="H", **more):
    return {"number": number, "heading": heading, "body_text": "Text.\n\neferred to in §1.2", **more}


def probe(tmp_path, payload):
    path = tmp_path / "probe.json"
    path.write_text(json.dumps(payload))
    return str(path)


def test_code_probe(spark, tmp_path):
    payload = {"code_year": 2026, "source_base_url": "x", "samples": [{"chapter": "1", "chapter_title": " General ", "sections": [section("1.1", " State ", referred_to_in=["1.2", " ", "9.9"], history_brackets=[" C51 "]), section("2.1"), section("1-3"), section("1.2A")]}, {"chapter": "12C", "sections": [section("12C.1")]}]}
    chapters, sections, skipped = probes.parse_code(probes.read_probe(spark, probe(tmp_path, payload)))
    assert [(r.chapter, r.title, r.year) for r in chapters.orderBy("chapter_no").collect()] == [("1", "General", 2026), ("12C", "", 2026)]
    rows = sections.orderBy("chapter_no", "section_no").collect()
    assert [(r.path, r.heading, r.body, r.ordinal) for r in rows] == [("1.1", "State", "Text.", "1"), ("1.2A", "H", "Text.", "2A"), ("12C.1", "H", "Text.", "1")]
    assert rows[0].referred_to_in == ["1.2", "9.9"] and rows[0].history_brackets == ["C51"] and rows[1].referred_to_in == []
    assert {(r.number, r.reason) for r in skipped.collect()} == {("2.1", "number belongs to another chapter"), ("1-3", "number has no right shape")}


@pytest.mark.parametrize("bad", [{"code_year": "soon"}, {"code_year": None}, {"samples": [{"chapter": "x1", "sections": []}]}, {"samples": [{"chapter": "1", "sections": [section("1.1", " ")]}]}, {"samples": [{"chapter": " ", "sections": []}]}])
def test_wrong_probes_stop(spark, tmp_path, bad):
    payload = {"code_year": "2026", "samples": [{"chapter": "1", "sections": [section("1.1")]}], **bad}
    chapters, sections, _ = probes.parse_code(probes.read_probe(spark, probe(tmp_path, payload)))
    with pytest.raises(Exception):
        chapters.collect()
        sections.collect()


def test_rules_probe(spark, tmp_path):
    long = "Application form " * 20 + "Form 1 " + "x" * 300
    rule = lambda n, **more: {"number": n, "heading": "H", "division": "D", "body_text": "Prose ", "comment_text": "", **more}
    payload = {"edition_date": "2026-04-01", "samples": [{"chapter": "32", "chapter_title": "T", "reserved": False, "rules": [rule("32:1.7.", comment_text="[1] Why"), rule("32:1.8", reserved=True), rule("1.1"), rule("32:9", heading=long)]}, {"chapter": "64", "reserved": True, "rules": []}]}
    chapters, rules, skipped = probes.parse_rules(probes.read_probe(spark, probe(tmp_path, payload), rules=True))
    rows = {r.path: r for r in rules.collect()}
    assert rows["32:1.7"].body == "Prose\n\nComment\n\n[1] Why" and set(rows) == {"32:1.7", "32:9"}
    assert rows["32:9"].heading == ("Application form " * 20).strip() and rows["32:9"].body.startswith("Form 1 xxx")
    assert {r.reason for r in skipped.collect()} == {"reserved", "number belongs to another chapter"}
    assert {(r.chapter, r.reserved, r.n_rules) for r in chapters.collect()} == {("32", False, 2), ("64", True, 0)}


def test_probe_sink(spark, tmp_path):
    chapters, sections, _ = probes.parse_code(probes.read_probe(spark, probe(tmp_path, {"code_year": "2026", "samples": [{"chapter": "1", "chapter_title": "T", "sections": [section("1.2"), section("1.1")]}]})))
    (row,) = probes.to_probe(sections, chapters, 2026).collect()
    back = json.loads(row.value)
    assert back["code_year"] == "2026" and [s["number"] for s in back["samples"][0]["sections"]] == ["1.2", "1.1"]


RICH = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 CHAPTER 714\par THEFT AND FRAUD\par 714.1 Theft \'a7 defined.\par A person commits theft.\par [C51, \'a71]\par 2013 Acts, ch 30, \'a72\par Referred to in \'a7714.2, 714.3\par\par\par End.\par 714.2 Degrees.\par Text \{x\}\emdash y.}"


def test_rich_text(spark, tmp_path):
    (tmp_path / "714.rtf").write_bytes(RICH)
    chapters = rtf.chapter_heads(rtf.read_chapters(spark, str(tmp_path / "714.rtf")))
    assert (chapters.first().chapter, chapters.first().title) == ("714", "THEFT AND FRAUD")
    rows = rtf.with_notes(rtf.sections_of(chapters)).orderBy("section_no").collect()
    assert [(r.number, r.heading) for r in rows] == [("714.1", "Theft § defined"), ("714.2", "Degrees")]
    assert rows[0].history_brackets == ["C51, §1"] and rows[0].acts_citations[0].startswith("2013 Acts, ch 30") and rows[0].referred_to_in == ["714.2", "714.3"]
    assert rows[0].body.startswith("A person commits theft.") and rows[0].body.endswith("End.") and "\n\n\n" not in rows[0].body
    assert rows[1].body == "Text {x}—y."


BOOK = """CHAPTER 32
RULES OF CONDUCT
DIVISION I
GENERAL
Rule 32:1.0 Terms and
how they are used
Rule 32:1.1 Competence
Rules 32:1.2 to 32:1.4 Reserved
DIVISION II
Rule 32:2.1 Advisor
April 2026 RULES OF CONDUCT Ch 32, p.1

DIVISION I
GENERAL
Rule 32:1.0 TERMS AND HOW
THEY ARE USED
A term is a word.
It has a meaning.
[Court Order April 20, 2005;
September 1, 2010]
Rule 32:1.1. Competence. A lawyer shall be competent.
More prose here.
Comment
[1] First reason
goes on.
[2] Second reason.
DIVISION II
Rule 32:2.1 ADVISOR
A lawyer advises.
See also rule 32:1.1 for more.
Rule 32:3.1 Alone
Its first line.
Its second line."""


def test_rule_book(spark):
    lines = spark.createDataFrame([("32", i, t) for i, t in enumerate(BOOK.split("\n"))], "chapter string, line_no int, line string")
    rules, notes = rules_text.parse(lines)
    got = {r.rule: r for r in rules.collect()}
    assert set(got) == {"32:1.0", "32:1.1", "32:2.1", "32:3.1"}
    assert got["32:1.0"].heading == "Terms and how they are used" and got["32:1.0"].division == "GENERAL"
    assert got["32:1.0"].prose == "A term is a word. It has a meaning." and got["32:1.0"].history == ["[Court Order April 20, 2005; September 1, 2010]"]
    assert got["32:1.1"].prose == "A lawyer shall be competent. More prose here." and got["32:1.1"].comment == "[1] First reason goes on.\n\n[2] Second reason."
    assert got["32:2.1"].division == "DIVISION II" and got["32:2.1"].prose == "A lawyer advises. See also rule 32:1.1 for more."
    assert got["32:3.1"].heading == "Alone"
    assert [(r.rule, r.note) for r in notes.collect()] == [("32:3.1", "in body only")]


def test_lines_of_a_rule_book_move_once(spark):
    """Contents and bodies come from one pass over the lines, which are dealt out by chapter once."""
    rows = [(c, i, t.replace("32:", f"{c}:")) for c in ("32", "33") for i, t in enumerate(BOOK.split("\n"))]
    lines = rules_text.content_lines(spark.createDataFrame(rows, "chapter string, line_no int, line string"))
    found = rules_text.entries(lines, "contents", "body")
    for made in (rules_text.contents(found), rules_text.bodies(found)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.chapter, r.rule): (r.heading, r.division) for r in rules_text.contents(found).collect()}
    assert got[("33", "33:1.0")] == ("Terms and how they are used", "GENERAL") and got[("32", "32:2.1")][1] == "DIVISION II"


def test_capitals_are_counted_by_letters(spark):
    given = ["A-B C", "A B", "ABc", "", "1 2 3", "ÄÖÜ", "A B C d", "dž XYZ"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", text.all_capitals(F.col("t")).alias("c"))
    assert [r.c for r in d.orderBy("i").collect()] == [True, False, False, False, False, True, False, False]


@pytest.mark.parametrize(
    ("rows", "prose", "comment", "history"),
    [
        (["a", "", "b ", " c"], "a\n\nb c", "", []),
        (["a", "[Report x]", "b", "[Amended 1 [2]", "3]", "c"], "a\n\nb\n\nc", "", ["[Report x]", "[Amended 1 [2] 3]"]),
        (["Comment", "x", "[1] y", "z", "Comment", "[2] w"], "", "x\n\n[1] y z Comment\n\n[2] w", []),
        (["a", "[Effective 1", "Comment", "more"], "a", "", []),
        (["[Adopted 1", "Comment]", "b", "Comment", "c", "[Report d]", "e"], "b", "c\n\ne", ["[Adopted 1 Comment]", "[Report d]"]),
        ([], "", "", []),
    ],
)
def test_rule_bodies(rows, prose, comment, history):
    assert rules_text.split_body(rows) == (prose, comment, history)


def test_rules_sink(spark):
    lines = spark.createDataFrame([("32", i, t) for i, t in enumerate(BOOK.split("\n"))], "chapter string, line_no int, line string")
    (row,) = probes.to_rules_probe(*rules_text.parse(lines), "2026-04-01").collect()
    (sample,) = json.loads(row.value)["samples"]
    assert [r["number"] for r in sample["rules"]] == ["32:1.0", "32:1.1", "32:2.1", "32:3.1"] and sample["rule_count"] == 4
    assert sample["parse_notes"] == ["32:3.1 in body only"] and sample["rules"][1]["comment_text"].startswith("[1] First")


def test_links_first_appearance(spark, monkeypatch):
    p = spark.createDataFrame([(2, '<a href="/docs/code/2026/9I.rtf"><a href="/docs/code/2026/1.rtf">'), (1, '<A HREF="/docs/code/2026/1.RTF">')], "page_id long, html string")
    first = pages.in_order(pages.first_appearances(pages.links(p, pages.CHAPTER_LINK)))
    assert [(r.slug, r.page_id) for r in first.orderBy("place").collect()] == [("1", 1), ("9I", 2)]
    monkeypatch.setattr(pages, "RUN", 3)
    rows = [(str(i), None if i % 13 == 0 else i * 7 % 50 - 9, i) for i in range(60)]
    got = pages.in_order(spark.createDataFrame(rows, "slug string, page_id long, pos long"))
    assert [r.slug for r in got.orderBy("place").collect()] == [s for s, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    assert sorted(r.place for r in got.collect()) == [*range(1, 61)]


def test_blobs_and_dump(spark, tmp_path):
    for name, raw in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / f"{name}.bin").write_bytes(raw)
    found = blobs.read_blobs(spark, str(tmp_path / "*.bin"))
    new = blobs.new_blobs(found, found.where("1 = 0"))
    assert new.count() == 2 and blobs.new_blobs(found, new).count() == 0
    tables = {"x": spark.range(3), "y": spark.range(0)}
    blobs.dump(tables, str(tmp_path / "dump"))
    assert {(r.table, r.n_source, r.equal) for r in blobs.reconcile(spark, tables, str(tmp_path / "dump")).collect()} == {("x", 3, True), ("y", 0, True)}


def test_event_lines(spark, tmp_path):
    (tmp_path / "e.ndjson").write_text('{"run_id":"r","seq":1,"type":"delta","text":"hi"}\n{"run_id":"r","seq":2,"type":"error","message":"no"}\n')
    r = evaluation.fold_events(blobs.read_events(spark, str(tmp_path / "e.ndjson"))).first()
    assert (r.answer, r.state) == ("The request failed: no", "failed")


def test_streamed_quota(spark, tmp_path):
    calls = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 23:00:00"), (1, "2024-01-02 01:00:00"), (2, "2024-01-01 05:00:00")], "key long, at string").withColumn("at", F.col("at").cast("timestamp"))
    calls.write.parquet(str(tmp_path / "in"))
    stream = jobs.quota_counts(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("quota_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, str(r.day), r.used) for r in spark.table("quota_test").collect()} == {(1, "2024-01-01", 2), (1, "2024-01-02", 1), (2, "2024-01-01", 1)}
    got = []
    jobs.write_each(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), lambda df, n: got.append((n, df.count())), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(n for _, n in got) == 4


def test_sections_are_heads_and_what_stands_between(spark):
    """The same as slicing from one match to the next."""
    rng = random.Random(6)
    python = re.compile(r"^(\d+[A-Z]*\.\d+[A-Z]*)\s{1,3}([^\n]+?)\.\s*$", re.MULTILINE)
    texts = ["".join(rng.choice(["714.1 Theft.\n", "714.1A  A head. \n\n", "12.3\n Late head.", "1.2 no head", "\n", "text. ", "\U0001f600", "  ", "9H.2\xa0 Wide.\n", "\r\n", ".", "\x85"]) for _ in range(rng.choice([0, 3, 20]))) for _ in range(80)]
    rows = [(str(i), t) for i, t in enumerate(texts)] + [("none", None)]
    got = {}
    for r in rtf.sections_of(spark.createDataFrame(rows, "path string, text string")).orderBy("section_no").collect():
        got.setdefault(r.path, []).append((r.number, r.heading, r.raw_body))
    for path, t in rows:
        heads = list(python.finditer(t or ""))
        ends = [m.start() for m in heads[1:]] + [len(t or "")]
        assert got.get(path, []) == [(m[1], m[2].strip(), t[m.end() : z].strip()) for m, z in zip(heads, ends)]
