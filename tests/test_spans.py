"""Spans by built-in expressions, and quotations by section, against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import citations as grammar
from palimpsest.functions import text
from palimpsest.operators import audit, joins, links


def some_text(rng, n):
    return "".join(rng.choice(["§ ", "section ", "chapters ", "ch. ", "I.C. ", "Iowa Code § ", "714.16", "714", "9H.2(1)(a)", "501A", ", ", " or ", " and ", "; ", "& ", "\U0001f600", "é", "\n", " ", "x", ".", "(", "20th "]) for _ in range(n))


def python_series(body):
    out = []
    for series, member in links._SERIES:
        for m in re.finditer(series, body, re.IGNORECASE):
            out += [(m.start(1) + x.start(), m.start(1) + x.end(), x[0]) for x in re.finditer(member, m[1], re.IGNORECASE)]
    return sorted(out)


def test_spans_are_those_of_the_pattern(spark):
    rng = random.Random(1)
    rows = [(i, some_text(rng, rng.choice([0, 1, 5, 40, 400]))) for i in range(150)] + [(900, None), (901, "chapters 497, 498, or 499; and sections 714.1, 714.2 and 714.16"), (902, "\U0001f600 § 1.2")]
    df = spark.createDataFrame(rows, "text_id long, body string")
    got = {}
    for r in links.scan(df, "text_id", "body", series=True).collect():
        got.setdefault((r.text_id, r["pass"]), []).append((r.pos, r.start, r.end, r.raw))
    for i, b in rows:
        free = links.free_spans(b or "")
        assert sorted(got.get((i, 0), [])) == [(k, *s) for k, s in enumerate(free)]
        assert sorted(got.get((i, 1), [])) == [(k, *s) for k, s in enumerate(python_series(b or ""))]
    plan = links.scan(df, "text_id", "body", series=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_null_keys_are_dealt_evenly(spark):
    left = spark.range(100).select("id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 60, 5).select(F.col("id").alias("k"), F.lit("v").alias("v")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'lost' AS v"))
    got = joins.left_known(left, right, "k").orderBy("id").collect()
    assert [(r.id, r.k, r.v) for r in got] == [(i, i if i % 5 == 0 else None, "v" if i % 5 == 0 and i < 60 else None) for i in range(100)]


def edited(rng, s, share):
    chars = list(s)
    for _ in range(int(len(s) * share)):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], [rng.choice("abc ")], [chars[k], rng.choice("xyz")]])
    return "".join(chars)


def test_passages_by_common_runs_are_the_likeliest():
    rng = random.Random(2)
    words = ["tenant", "landlord", "theft", "a", "of", "the", "notice", "weapons"]
    for _ in range(60):
        passages = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 30]))) for _ in range(rng.choice([0, 1, 5, 30]))]
        held = audit.Passages(passages)
        for _ in range(5):
            want = edited(rng, rng.choice(passages or ["nothing"]), rng.choice([0, 0.05, 0.1, 0.2, 0.5])) or "x"
            assert held.likeliest(want) == audit.likeliest(want, passages)


def test_the_likeliest_passage_by_any_way(monkeypatch):
    """With and without kept runs the best is that of comparing all, the first of equal ones; few passages are compared."""
    rng = random.Random(8)
    words = ["aa", "aaa", "the", "of", "tenant", "landlord", "x"]
    compared = []
    ratio = audit.difflib.SequenceMatcher.ratio
    plain = lambda want, passages: max(((ratio(audit.difflib.SequenceMatcher(None, p, want, autojunk=False)), -i) for i, p in enumerate(passages)), default=(0.0, 1))
    for _ in range(60):
        passages = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 30]))) for _ in range(rng.choice([0, 1, 5, 30]))]
        want = edited(rng, rng.choice(passages or ["nothing"]), rng.choice([0, 0.05, 0.2, 0.5])) or "x"
        score, place = plain(want, passages)
        wanted = (score, -place) if score else (0.0, -1)
        for least in (0, 99):
            monkeypatch.setattr(audit, "INDEXED_FROM", least)
            assert audit.Passages(passages).likeliest(want) == wanted
    monkeypatch.setattr(audit.difflib.SequenceMatcher, "ratio", lambda self: compared.append(1) or ratio(self))
    texts = [f"passage number {i} of a long section on rents and tenants" for i in range(200)]
    assert audit.likeliest("passage number 117 of a long section on rents or tenants", texts)[1] == 117 and len(compared) < 40


@pytest.mark.parametrize("group", [2_000, 2])
def test_quotations_meet_by_section(spark, monkeypatch, group):
    monkeypatch.setattr(audit, "GROUP_QUOTES", group)
    rng = random.Random(3)
    words = ["Tenant", "landlord", "theft", "É", "\U0001f600", "of", "İ", "notice", "weapons"]
    bodies = {i: ".  ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 20))) for _ in range(rng.choice([1, 8]))) + "." for i in range(1, 6)}
    quotes = []
    for k in range(80):
        n = rng.choice([1, 1, 1, 2, 3, 4, 5, 77])
        b = bodies.get(n, "Nothing of the kind")
        at = rng.randrange(len(b))
        quote = edited(rng, b[at : at + rng.choice([8, 60])], rng.choice([0, 0, 0.05, 0.4])).strip()
        quotes.append((k, n, quote or "empty", k))
    q = spark.createDataFrame(quotes, "quote_no int, node_id long, quote string, start int")
    s = spark.createDataFrame(list(bodies.items()), "node_id long, body string")
    got = {r.quote_no: (r.status, r.score, r.passage) for r in audit.compared(q, s).collect()}
    assert len(got) == len(quotes)
    fold = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    around = {r.quote_no: r.e for r in q.join(s, "node_id").select("quote_no", text.excerpt_around(F.col("body"), F.col("quote")).alias("e")).collect()}
    for k, n, quote, _ in quotes:
        if n not in bodies:
            assert got[k] == ("section_unresolved", 0.0, "")
        elif fold(quote) in fold(bodies[n]):
            assert got[k] == ("exact", 1.0, around[k])
        else:
            passages = [p.strip() for p in re.split(r"(?<=[.\n])\s+", bodies[n]) if p.strip()]
            score, at = audit.likeliest(fold(quote), [fold(p) for p in passages])
            shown = passages[at] if at >= 0 else ""
            assert got[k] == ("fuzzy" if score >= 0.85 else "not_found", score, shown[:300] + ("…" if len(shown) > 300 else ""))


def test_quotations_of_many_sections_share_a_group(spark):
    """A group for each section would be a call for each; some 64 quotations make one."""
    q = spark.range(200).selectExpr("cast(id as int) quote_no", "id node_id", "concat('quoted words ', id) quote", "cast(id as int) start")
    s = spark.range(200).selectExpr("id node_id", "concat('Here are quoted words ', id, '. And more.') body")
    out = audit.compared(q, s)
    assert out.where("status = 'exact'").count() == 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "_group" in plan


def test_an_audit_reads_texts_and_compares_once(spark):
    texts = spark.createDataFrame([(1, "Code", 'By section 1.2, "the rent is due", and section 9.9, "it never is at all".')], "text_id long, source string, body string")
    nodes = spark.createDataFrame([(1, "Code", "1.2", "1", "H", False)], "node_id long, source string, path string, parent_path string, heading string, is_repealed boolean")
    v = spark.createDataFrame([(1, 1, "Now the rent is due. Pay.", "approved")], "version_id long, node_id long, body string, review_status string").selectExpr("*", "date'2024-01-01' effective_from", "cast(null as date) effective_to")
    report = audit.audit_report(*audit.audit(texts, nodes, v, F.lit("2023-01-01").cast("date")))
    plan = report._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInPandas" not in plan and "Generate posexplode" not in plan
    (row,) = report.collect()
    assert (row.n_citations, row.n_valid, row.n_quotes, row.n_exact, row.n_amended) == (2, 1, 2, 1, 1) and row.citation_rows.count("|") >= 2


def test_forms_of_sections_and_chapters(spark):
    df = spark.createDataFrame([("Iowa Code § 714.16(2)(a)",), ("chapter 9H",), ("nothing",)], "t string")
    c = grammar.parse(F.col("t"))
    got = df.select(*[grammar.render(c, s).alias(s) for s in ("long", "short", "bare")]).collect()
    assert list(map(tuple, got)) == [("Iowa Code § 714.16(2)(a)", "I.C. § 714.16(2)(a)", "714.16(2)(a)"), ("Iowa Code ch. 9H", "I.C. ch. 9H", "9H"), (None, None, None)]
