"""The n-gram Jaccard join and its parts against brute force."""

import random

import numpy as np
import pytest

from palimpsest.llm import components, jaccard_join, trie_join

from . import brute
from .test_native import ODD, SCHEMA, docs


def near_copies(seed, n):
    """Texts in families around the threshold: stars around a base, chains, containments, a shared passage."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(10**6)
    passage = [word() for _ in range(50)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 120, 400]))]
        if rng.random() < 0.4:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(rng.choice([1, 2, 6, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: int(len(t) * rng.uniform(0.7, 1)) + 1]
            if rng.random() < 0.2:
                base = t
            out.append(" ".join(t).upper() if rng.random() < 0.2 else "\n".join(t))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_components_match_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = ODD + [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = near_copies(block, 60)
    rows += [(5_000 - i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, "only without id but some words"), (None, "only without id but some words")]
    got = jaccard_join.similar_groups(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.linked_groups(rows)))


def test_other_thresholds_and_sizes(spark):
    rows = list(enumerate(near_copies(5, 40)))
    for size, percent in ((2, 60), (3, 95), (1, 80)):
        got = jaccard_join.similar_groups(docs(spark, rows), size=size, percent=percent).collect()
        assert sorted(map(tuple, got)) == sorted(brute.linked_groups(rows, size, percent))


def test_shuffled_paths_and_small_flushes(spark, monkeypatch):
    for name, value in (("BROADCAST_IDS", 0), ("FLUSH", 500), ("GROUP", 400), ("HEAVY", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = list(enumerate(near_copies(9, 60)))
    got = jaccard_join.similar_groups(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.linked_groups(rows))


def test_one_row_of_each_group_stays(spark):
    texts = near_copies(2, 30)
    rows = [(i % 150, t) for i, t in enumerate(texts)] + [(400, texts[0]), (400, texts[0])]
    kept = jaccard_join.one_of_each(docs(spark, rows))
    assert kept.columns == SCHEMA.fieldNames()
    whole = brute.linked_groups(rows)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in whole}


def test_rows_of_equal_ids_are_told_apart(spark, monkeypatch):
    """Equal ids, null ids, rows without words, columns of clashing names; by broadcast and by shuffle."""
    a, b = "one two three four five six", "ten nine eight seven six five"
    rows = [(5, a, 1), (5, b, 2), (3, b.upper(), 3), (5, a.upper(), 4), (None, a, 5), (None, "only without an id", 6), (None, "only without an id", 7), (8, "", 8), (8, None, 9), (9, a, 10)]
    data = spark.createDataFrame(rows, "doc_id long, text string, _head int").selectExpr("*", "_head as _OWN0", "_head as key", "_head as grp")
    for limit in (jaccard_join.BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", limit)
        kept = jaccard_join.one_of_each(data)
        assert kept.columns == data.columns
        got = sorted(r["key"] for r in kept.collect())
        assert len(got) == 5 and got[1] == 3 and got[0] in (1, 4) and got[2] in (6, 7) and got[3:] == [8, 9]


def test_values_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_COPIES", 3)
    monkeypatch.setattr(jaccard_join, "HOT_KEYS", 4)
    texts = near_copies(3, 20)
    rows = list(enumerate(texts + [texts[0]] * 40 + [texts[9]] * 5))
    got = jaccard_join.similar_groups(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.linked_groups(rows))


def test_one_large_group(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(1500):
        t = list(base)
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i + 1, " ".join(t)))
    got = jaccard_join.similar_groups(docs(spark, [*rows, (0, " ".join(base))])).collect()
    assert {r.component_id for r in got} == {0}


def test_tree_links_match_brute_force():
    rng = random.Random(1)
    for trial in range(120):
        bases = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(3)]
        sets = []
        for _ in range(25):
            b = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                if b and rng.random() < 0.6:
                    b.pop(rng.randrange(len(b)))
                if rng.random() < 0.6:
                    b.append(rng.randint(0, 260))
            sets.append(np.array(sorted(set(b)), np.uint64))
        percent = rng.choice([50, 80, 100])
        want, got = trie_join.Groups(25), trie_join.Groups(25)
        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    want.join(i, j)
        for i, j in trie_join.links(sets, [len(s) for s in sets], percent):
            got.join(i, j)
        assert [want.root(i) for i in range(25)] == [got.root(i) for i in range(25)], trial


def test_parity_bits_lose_no_link():
    rng = np.random.RandomState(2)
    sets, own = [], []
    for size in (3, 30, 31, 33, 70, 300, 5000):
        base = rng.randint(0, 1 << 48, size).astype(np.uint64)
        for change in (0, 1, 2, size // 12, size // 6, size // 3):
            t = base.copy()
            t[:change] = rng.randint(0, 1 << 48, change)
            sets.append(np.unique(t))
            own.append(change % 3)
    near = len(sets)
    for size in (30, 300, 5000):  # alike in size alone
        sets.append(np.unique(rng.randint(0, 1 << 48, size).astype(np.uint64)))
        own.append(0)
    n = np.array([len(s) for s in sets]) + own
    group = np.arange(len(sets)) // 2
    got = jaccard_join.may_link(n, np.array(own), [jaccard_join.parity(s) for s in sets], group, 80)
    must = [any(group[i] != group[j] and 180 * len(np.intersect1d(a, b)) >= 80 * (n[i] + n[j]) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert all(g or not m for g, m in zip(got, must))
    assert not got[near:].any()


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    above = {}

    def root(i):
        while above.setdefault(i, i) != i:
            i = above[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in list(above)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert jaccard_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert jaccard_join.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_short_keys_are_drawn_again(spark, monkeypatch):
    """All classes begin with the same short key; a salt parts them."""
    short = jaccard_join._k8
    monkeypatch.setattr(jaccard_join, "shared_counts", lambda docs, *_: docs.sparkSession.createDataFrame([(1, 10**6)], "k8 long, shared long"))
    calls = []

    def k8(key, salt=0):
        calls.append(salt)
        return short(key, salt) if salt else short(key) * 0 + 1

    monkeypatch.setattr(jaccard_join, "_k8", k8)
    rows = list(enumerate(near_copies(11, 25)))
    got = jaccard_join.similar_groups(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.linked_groups(rows)) and max(calls) == 1
