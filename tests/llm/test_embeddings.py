"""Embedding near-duplicates against brute force."""

import math
import random

import numpy as np
import pytest

from palimpsest.llm import embedding_dedup

from . import brute

SCHEMA = "vec_id long, embedding array<double>, n string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def family(rng, dim, n, cos):
    base = rng.normal(size=dim)
    base /= np.linalg.norm(base)
    out = []
    for _ in range(n):
        g = rng.normal(size=dim)
        g -= (g @ base) * base
        g /= np.linalg.norm(g)
        out.append(((cos * base + math.sqrt(1 - cos * cos) * g) * rng.uniform(0.1, 9)).tolist())
    return out


def check(spark, rows):
    got = embedding_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.near_vectors(rows)))


@pytest.mark.parametrize("most", [65_536, 5])
def test_families_copies_and_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", most)
    rng = np.random.default_rng(most)
    vectors = [v for n, cos in [(1, 1), (2, 0.99), (5, 0.985), (30, 0.98), (4, 0.9)] * 6 for v in family(rng, 64, n, cos)]
    vectors += vectors[:1] * 40 + vectors[3:5] * 2 + [[-x for x in vectors[0]]]
    vectors += [None, [], [0.0] * 64, [None] + [1.0] * 63, [math.nan] * 64, [math.inf] + [1.0] * 63, [1e-200] * 64, [1e200] * 64, [1.0] * 63, [1.0] * 64, [-0.0] * 64, [0.0] * 63 + [3.0], [0.0] * 63 + [4.0], [2.0], [5.0], [-2.0]]
    rows = [(1000 - k, v) for k, v in enumerate(vectors)]
    rows += [(5000, vectors[1]), (5000, vectors[1]), (5000, vectors[9]), (None, vectors[2]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None)]
    check(spark, rows)


def test_other_dimensions(spark):
    for dim in (3, 100, 130):
        rng = np.random.default_rng(dim)
        check(spark, list(enumerate(v for _ in range(10) for v in family(rng, dim, 4, 0.99))))


def test_floats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, None)], "vec_id int, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embedding_dedup.near_duplicates(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(rows, least=0.9)


def test_pairs_at_the_threshold_are_found():
    """Share of pairs of cosine 0.95 that share a bucket and pass the sketch."""
    rng = np.random.default_rng(4)
    pairs = np.array([family(rng, 64, 1, 1)[0] for _ in range(4000)])
    unit = pairs / np.linalg.norm(pairs, axis=1, keepdims=True)
    g = rng.normal(size=unit.shape)
    g -= (g * unit).sum(1, keepdims=True) * unit
    other = 0.95 * unit + math.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    a, b = embedding_dedup.buckets(unit), embedding_dedup.buckets(other)
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(a, b)]) >= 0.9995
    bits = np.bitwise_count(embedding_dedup.sketches(unit).view(np.uint64) ^ embedding_dedup.sketches(other).view(np.uint64)).sum(1)
    assert (bits <= embedding_dedup.SKETCH_BITS).all()


def test_groups_run_over_batches():
    import pyarrow as pa

    rng = random.Random(1)
    keys = sorted(rng.choice([1, 2, 2, 2, 3, 5, 8]) for _ in range(300))
    batches, at = [], 0
    while at < len(keys):
        n = rng.choice([1, 2, 40])
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n]), pa.array(range(at, at + len(keys[at : at + n])))], ["k", "v"]))
        at += n
    got = [(k, g.column(1).to_pylist()) for (k,), g in embedding_dedup._groups(iter(batches), 1)]
    assert [(k, len(v)) for k, v in got] == [(k, keys.count(k)) for k in sorted(set(keys))] and [x for _, v in got for x in v] == list(range(300))
