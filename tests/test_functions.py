"""Scalar functions against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import citations, similarity, text
from palimpsest.functions.stemming import stem

ODD = ["", " ", "a", "a\r\nb \n", "Body.\n\neferred to in §1.2", "x; ; ; eferred to in §2.14, §3\nSee also y", " é  nbsp ", "one\ttwo  three\n\nfour", "word " * 200, "x" * 900, "Ends with space " + "y" * 790 + " tail", "|a|\nb", "A1.2:3", "ÉCOLE NORMALE", "ABC d", "AB", "714H.10"]


def rows(spark, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_spaces(spark):
    t = F.col("t")
    got = rows(spark, text.strip(t), text.rstrip(t), text.collapse_space(t))
    assert got == [(s.strip(), s.rstrip(), re.sub(r"\s+", " ", s).strip()) for s in ODD]


def test_bodies_and_hashes(spark):
    note = re.compile(r"(?:\n\s*|\s*(?:;\s*)+)eferred to in [^\n]*")
    plain = [s.replace("\r\n", "\n").rstrip() for s in ODD]
    got = rows(spark, text.normalized_body(F.col("t")), text.normalized_body(F.col("t"), False), text.content_hash(F.col("t")))
    assert got == [(note.sub("", p).rstrip(), p, hashlib.sha256(s.encode()).hexdigest()) for s, p in zip(ODD, plain)]


def test_snippets(spark):
    def snippet(s):
        s = s.strip().replace("\n", " ")
        return s if len(s) <= 280 else s[:279].rstrip() + "…"

    def excerpt(s):
        s = s.rstrip()
        if len(s) <= 800:
            return s
        cut = s[:800]
        at = cut.rfind(" ")
        return (cut[:at] if at > 720 else cut).rstrip() + "…"

    assert rows(spark, text.snippet(F.col("t")), text.body_excerpt(F.col("t"))) == [(snippet(s), excerpt(s)) for s in ODD]


def test_search_snippets(spark):
    def want(body, query):
        body = " ".join(body.split())
        if len(body) <= 240:
            return body
        at = next((p for w in query.lower().split() if len(w) >= 3 and (p := body.lower().find(w)) >= 0), -1)
        if at < 0:
            return body[:239].rsplit(" ", 1)[0].rstrip() + "…"
        a = max(0, at - 80)
        b = min(len(body), a + 240)
        s = body[a:b]
        s = "…" + s.split(" ", 1)[-1] if a else s
        s = s.rsplit(" ", 1)[0] + "…" if b < len(body) else s
        return s.strip()

    rng = random.Random(3)
    bodies = [" ".join(rng.choice(["alpha", "be", "Gamma", "delta-five", "x"]) for _ in range(rng.randint(1, 200))) + (" needle here" if rng.random() < 0.5 else "") for _ in range(60)] + ["y" * 300]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string")
    for q in ("no needle", "zz GAMMA", "missing", ""):
        got = [r[1] for r in df.select("i", text.search_snippet(F.col("t"), F.lit(q))).orderBy("i").collect()]
        assert got == [want(b, q) for b in bodies]


def test_excerpt_around(spark):
    body = "a" * 150 + "The Quote" + "b" * 150
    df = spark.createDataFrame([(body, "the quote"), ("The Quote", "QUOTE"), ("x", "none")], "b string, q string")
    got = [r[0] for r in df.select(text.excerpt_around(F.col("b"), F.col("q"))).collect()]
    assert got == ["…" + "a" * 100 + "The Quote" + "b" * 100 + "…", "The Quote", "none"]


def test_paths_and_orders(spark):
    paths = ["714H.10", "714H.2", "714.1", "714H.1", "714H.20", "714.2"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.orderBy(text.natural_key(F.col("p"))).collect()] == ["714.1", "714.2", "714H.1", "714H.2", "714H.10", "714H.20"]
    df = spark.createDataFrame([("10",), ("2",), ("12C",), ("A",)], "p string")
    assert [r.p for r in df.orderBy(text.number_first_key(F.col("p"))).collect()] == ["2", "10", "12C", "A"]
    df = spark.createDataFrame([("32:1.10",), ("32:1.2",), ("32:1.2a",), ("9.1",)], "p string")
    assert [r.p for r in df.orderBy(text.ordinal_key(F.col("p"))).collect()] == ["9.1", "32:1.2", "32:1.2a", "32:1.10"]
    r = spark.createDataFrame([("32:1.10",)], "p string").select(text.chapter_of(F.col("p"), True).alias("c"), text.ordinal_of(F.col("p"), True).alias("o"), text.chapter_of(F.col("p")).alias("d"), text.trimmed_number(F.lit(" 1.5.: ")).alias("n")).first()
    assert tuple(r) == ("32", "1.10", "32:1", "1.5.: ".strip(" .:"))


def test_small_ones(spark):
    one = spark.range(1)
    url = text.filled_url(F.lit("u/{year}/{path}"), F.lit(2026), F.lit("1.2"))
    got = one.select(url, text.filled_url(F.lit("u/{edition}/{path}"), F.lit(1), F.lit("x")), text.first_filled(F.lit(None), F.lit(""), F.lit("z")), text.combined_text(F.lit("a"), F.lit(" ")), text.combined_text(F.lit("a"), F.lit("b")), text.markdown_row(F.lit("a|b"), F.lit("c\nd")), text.embedding_text(F.lit("h"), F.lit("b ")), F.length(text.entity_tag(F.struct(F.lit(1).alias("x"))))).first()
    assert tuple(got) == ("u/2026/1.2", "", "z", "a", "a\n\nComment\n\nb", "| a\\|b | c d |", "h\n\nb", 16)
    assert [r[0] for r in rows(spark, text.all_capitals(F.col("t")))] == [sum(c.isalpha() for c in s) >= 3 and all(c.isupper() for c in s if c.isalpha()) for s in ODD]


FORMS = {
    "Iowa Code § 714.16": ("714", "714.16", []),
    "Iowa Code section 714.16(2)(a)": ("714", "714.16", ["2", "a"]),
    "I.C. § 714.16": ("714", "714.16", []),
    "I.C. 714": ("714", None, []),
    "section 1.4": ("1", "1.4", []),
    "§ 714.16(2)(a)(1)": ("714", "714.16", ["2", "a", "1"]),
    "714.16": ("714", "714.16", []),
    "714": ("714", None, []),
    "chapter 12C": ("12C", None, []),
    "ch. 232": ("232", None, []),
    "rule 32:1.7": ("32", "32:1.7", []),
    "Iowa R. Civ. P. 1.303": ("1", "1.303", []),
    "Iowa Ct. R. 1.303 and more": ("1", "1.303", []),
    "714.16.": ("714", "714.16.", []),
    "no number": None,
    "": None,
}


def test_grammar(spark):
    df = spark.createDataFrame([(k,) for k in FORMS], "t string")
    got = df.select("t", citations.parse(F.col("t")).alias("c")).collect()
    assert {r.t: (r.c.chapter, r.c.section, r.c.subdivisions) if r.c else None for r in got} == FORMS
    c = citations.parse(F.lit("§ 1.2(a)"))
    assert tuple(spark.range(1).select(citations.render(c), citations.render(c, "short"), citations.render(c, "bare")).first()) == ("Iowa Code § 1.2(a)", "I.C. § 1.2(a)", "1.2(a)")
    c = citations.parse(F.lit("chapter 714"))
    assert tuple(spark.range(1).select(citations.render(c), citations.render(c, "short"), citations.render(c, "bare")).first()) == ("Iowa Code ch. 714", "I.C. ch. 714", "714")


def test_find_all(spark):
    t = "See section 1.1, chapter 232 and 20th of 5 (a). I.C. § 714.16(2)"
    want = [m[0] for m in re.finditer(citations.FREE_TEXT, t, re.IGNORECASE)]
    assert spark.range(1).select(citations.find_all(F.lit(t))).first()[0] == want


def test_trigrams(spark):
    s = spark.range(1).select(similarity.trigram_similarity(F.lit("word"), F.lit("two words")), similarity.trigram_similarity(F.lit(""), F.lit("")), similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).first()
    assert s[0] == pytest.approx(0.36363637, abs=1e-6) and s[1] == 0 and s[2] == pytest.approx(0.5**0.5)


STEMS = {"consumers": "consum", "deceptive": "decept", "practices": "practic", "running": "run", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "generously": "generous", "national": "nation", "relational": "relat", "happy": "happi", "sky": "sky", "skies": "sky", "conditional": "condit", "agreed": "agre", "controlling": "control", "juveniles": "juvenil", "tenancy": "tenanc", "gas": "gas", "this": "this", "by": "by", "say": "say", "enjoyed": "enjoy", "vileli": "vile"}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]
