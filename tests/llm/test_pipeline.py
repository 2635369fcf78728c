"""Each stage of the pipeline on its own input against a plain restatement."""

import pytest

import corpus_pipeline
from palimpsest.llm import packing, pii
from palimpsest.llm.common import read_table, stored

from . import brute


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows before and after each stage, by id."""
    docs, out = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stored(stage(spark, docs, sf_dir), "step")
        out.append((docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "PII", "best-fit packing"]


def test_columns(steps):
    for _, after, columns in steps[:-1]:
        assert columns == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in after)


def test_quality_drops_junk_and_keeps_the_rest(spark, sf_dir, steps):
    before, after, _ = steps[0]
    kept = {r.doc_id for r in after}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    labels = {r.doc_id: r.quality for r in read_table(spark, sf_dir, "labels").collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) > 0.95 * len(labels)


def test_lines(steps):
    before, after, _ = steps[1]
    want = {i: (n, d, s) for i, n, d, s in brute.lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: brute.sha(r.text) for r in after} == {i: s for i, (_, _, s) in want.items()}
    assert {(r.doc_id, r.lang, r.source) for r in after} == {(r.doc_id, r.lang, r.source) for r in before}


def test_one_of_each_group_stays(steps):
    before, after, _ = steps[2]
    want = {c for _, _, c in brute.linked_groups([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_personal_data_is_masked(steps):
    before, after, _ = steps[3]
    text = {r.doc_id: r.text for r in after}
    assert len(text) == len(before)
    for r in before:
        spans = pii.plain_spans(r.text)
        assert bool(spans) <= (text[r.doc_id] != r.text)
        if not spans:
            assert text[r.doc_id] == r.text
        assert not any(r.text[a:b] in text[r.doc_id] for _, a, b in spans)


def test_packing(steps):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    before, after, _ = steps[4]
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got, used, lengths = {}, {}, {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths[r.length] = lengths.get(r.length, 0) + 1
    assert got == want
    for places in used.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(used) <= packing.lower_bound(lengths, 2048) * 1.02 + 1


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        read_table(spark, sf_dir, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
