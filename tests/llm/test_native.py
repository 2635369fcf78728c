"""Line dedup, quality rules and fingerprints against plain restatements."""

import functools

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import fingerprints, line_dedup, quality_rules, queries

from . import brute

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h1", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("words", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "a\x0b b\x0cÉ A\r"), (None, "one line\nthe end"), (7, "word " * 5000), (8, "x" * 200_000), (9, "Ab C\n ab c\t\nAB C"), (9, "Ab C\n ab c\t\nAB C")] + [(100 + i, f"  Shared Line\t\nown {i}\nshared line") for i in range(10)] + [(200 + i, f"nine times\nélan {i}") for i in range(9)]


def test_lines(spark):
    out = line_dedup.drop_repeated_lines(docs(spark, ODD)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute.lines(ODD), key=key)


def test_lines_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "HEAVY_LINES", 1)
    rows = ODD + [(300 + i, "second shared\nshared line") for i in range(12)]
    out = line_dedup.drop_repeated_lines(docs(spark, rows), carry=["pos"]).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute.lines(rows), key=key)


def test_quality(spark, sf_dir):
    rows = ODD + [(i, t) for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1, " ".join(map(str, [*range(30), *range(5, 20), *range(7, 16), *range(40)])))]
    got = quality_rules.apply_rules(docs(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(str((i, *brute.quality(t))) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_fingerprints(spark, sf_dir):
    rows = [(i, t) for i, t in ODD if i is not None][:-20] + [(i + 1000, t) for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = list(dict(rows).items())
    got = fingerprints.fingerprint_edits(docs(spark, rows)).collect()
    want = brute.edited(rows)
    assert {r.doc_id: r.edited_text for r in got} == want
    by_text = {}
    for r in got:
        assert by_text.setdefault(dict(rows)[r.doc_id] or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_fingerprints_hold_every_anchor(spark):
    words = [[f"{c}{i}" for i in range(20_000)] for c in "ab"]
    passage = [f"shared{i}" for i in range(100)]
    a, b = (" ".join(w[:9_000] + passage + w[9_000:]) for w in words)
    moved = " ".join(words[0][10_000:] + words[0][:10_000])
    changed = " ".join(words[0][:15_000] + ["another", "sentence"] + words[0][15_002:])
    rows = [(1, a), (2, b), (3, " ".join(words[0])), (4, changed), (5, moved), (6, "one")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, rows)).collect()}
    anchors = {i: [(r.fingerprint[k : k + 16], int(r.fingerprint[k + 16 : k + 24], 16)) for k in range(0, len(r.fingerprint), 24)] for i, r in got.items()}
    assert 0 < got[1].near_next < 0.02  # the passage
    assert 0.99 < got[3].near_next < 1  # the sentence
    for i in range(1, 6):
        places = [p for _, p in anchors[i]]
        assert 12_000 < len(places) < 15_000 and places == sorted(set(places)) and places[-1] < 20_100
    shared = {h: p for h, p in anchors[1]}.keys() & {h: p for h, p in anchors[2]}.keys()
    assert len(shared) > 40 and all(9_000 <= p < 9_100 for h, p in anchors[1] if h in shared)
    assert len(set(anchors[3]) ^ set(anchors[4])) < 20 and anchors[3] != anchors[4]


def plain_fingerprint(text):
    """Anchors with places, and features, by the words of the definition."""
    chain = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42)
    long = lambda x: x.to_bytes(8, "little")
    words = [chain(w.encode()) for w in brute.WORD.findall(text or "")]
    words = [0, 1, 2, *words] if words else []
    pairs = [chain(long(x), long(y)) for x, y in zip(words, words[1:])]
    signed = lambda x: x - (x >> 63 << 64)
    at = [i for i in range(len(pairs) - 2) if signed(pairs[i + 1]) >= min(signed(pairs[i]), signed(pairs[i + 2]))]
    own = [(pairs[i], pairs[i + 2]) for i in at]
    hashes = [chain(*map(long, x)) for x in own]
    steps = {chain(*map(long, x + y), (j - i).to_bytes(4, "little")) for x, y, i, j in zip(own, own[1:], at, at[1:])}
    return "".join(f"{h:016x}{i:08x}" for h, i in zip(hashes, at)), set(hashes) | steps


def test_fingerprints_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "one"), (-4, "one"), (-5, "a b c d e")]
    edits, text, ids = brute.edited(rows), dict(rows), sorted(i for i, _ in rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, rows)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, following in zip(ids, [*ids[1:], ids[0]]):
        (own, a), (edited, b), (_, c) = map(plain_fingerprint, (text[i], edits[i], text[following]))
        r = got[i]
        assert (r.edited_text, r.fingerprint, r.edited_fingerprint) == (edits[i], own, edited)
        assert (r.near_edited, r.near_next) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_matches_tell_places(spark):
    a = [f"w{i}" for i in range(60)]
    data = spark.createDataFrame([(" ".join(a), " ".join(["new"] * 7 + a[20:]))], "x string, y string")
    d = fingerprints.with_anchors(fingerprints.with_anchors(data, F.col("x"), "a"), F.col("y"), "b")
    (found,) = d.select(fingerprints.matches(F.col("a"), F.col("a_at"), F.col("b"), F.col("b_at"))).first()
    assert len(found) > 15 and {m["at"] - m["there"] for m in found} == {13}


def test_next_crosses_buckets(spark):
    rows = [(i * 7 % 1009, f"text {i * 7 % 1009}") for i in range(1009)]
    from palimpsest.llm.common import documents_of

    d = fingerprints.with_next(documents_of(docs(spark, rows)), ["text"], rows_per_bucket=20)
    assert {r.doc_id: r.next_text for r in d.collect()} == {i: f"text {(i + 1) % 1009}" for i in range(1009)}


@pytest.mark.parametrize("run", [line_dedup.drop_repeated_lines, quality_rules.apply_rules, fingerprints.fingerprint_edits])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op1_line_dedup", "op5_quality_rules", "op10_fingerprints"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
