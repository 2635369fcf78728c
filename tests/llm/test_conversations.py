"""Structure repair and prefix trie against brute force, also where conversations are cut into runs and pieces."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ordered, prefix_trie, structure_repair

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string"

#: Nulls everywhere, repeated rows, ties, blank and very long texts, roles of other names, ids below zero, surrogate pairs.
ODD = [
    (None, None, None, None), (None, 1, "user", "Alone."), (None, 1, "user", "Alone."), (0, None, "system", "S."), (0, None, None, "x"), (0, 1, "user", None), (0, 1, "user", "b."), (0, 1, "user", "a."),
    (0, 2, "assistant", "Yes!"), (0, 2, "assistant", "Yes!"), (0, 9, "user", "no end"), (0, 10, "", ""), (0, 11, "tool", " \t\n"), (0, 12, "umpire", "Out?"), (0, 13, "System", "\U0001f600."),
    (7, 1, "user", "long " * 20_000 + "."), (7, 2, "assistant", " "), (7, 5, "user", "U+0085 \x85"), (-101, 1, "user", "low."), (-100, 3, "user", "low."), (-100, 4, "assistant", "low."), (205, 1, "assistant", "x"),
    (9_000_000_000_000_000_000, -9_000_000_000_000_000_000, "user", "far."), (9_000_000_000_000_000_000, 9_000_000_000_000_000_000, "user", "wide."),
]


def talks(seed, n, longest=14):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(320), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, longest])):
            text = rng.choice(["Hi.", "Why?", "So it is", "", " ", "Go on!", "Done. "]) + (str(rng.randrange(3)) + "." if rng.random() < 0.5 else "")
            out.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    return out + rng.sample(out, len(out) // 20)


@pytest.fixture
def cut_up(spark):
    """Conversations lie in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def check_repair(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("digest", F.lit(1))
    same(structure_repair.repair(structure_repair.damaged(df)).collect(), brute.repairs(rows))


def check_trie(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("depth", F.lit(1)).withColumn("owner", F.lit(1))
    same(prefix_trie.trie(df).collect(), brute.trie(rows))


def wrapped(rows):
    """Differences as wide as a bigint wrap."""
    return [(c, (g + 2**63) % 2**64 - 2**63, *rest) for c, g, *rest in rows]


def test_odd_conversations(spark, cut_up):
    df = spark.createDataFrame(ODD, SCHEMA)
    same(structure_repair.repair(structure_repair.damaged(df)).collect(), wrapped(brute.repairs(ODD)))
    check_trie(spark, ODD)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, cut_up, seed):
    check_repair(spark, talks(seed, 120))
    check_trie(spark, talks(seed, 120))


def test_long_conversations_in_pieces(spark, cut_up, monkeypatch):
    monkeypatch.setattr(structure_repair, "PIECE_ROWS", 3)
    monkeypatch.setattr(ordered, "PIECE_CHARS", 20)
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    rows = talks(3, 60, longest=80)
    check_repair(spark, rows)
    check_trie(spark, rows + [(500 + k, t, role, text) for k in (1, 2, 3) for c, t, role, text in rows if c == rows[0][0]])


def test_a_row_repeated_many_times(spark, cut_up):
    rows = [(5, 1, "user", "Same.")] * 400 + [(5, 2, "assistant", "Yes.")] * 3 + [(6, 1, "user", "Same.")]
    got = structure_repair.repair(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1).cast("long"))).where("conv_id = 5").collect()[0]
    assert (got.duplicate, got.cost, got.illegal) == (401, 401 * 4, 401) and set(got.audit) == {"K", "D"}
    check_trie(spark, rows)


def test_comb_of_nested_chains(spark):
    """Each conversation leaves the one before it a turn later."""
    rows = [(100 * k, t, "user", f"t{t}." if t < k else f"own {k}.") for k in range(1, 40) for t in range(k + 1)]
    check_trie(spark, rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert structure_repair.repair(structure_repair.damaged(none)).count() == 0
    assert prefix_trie.trie(none).count() == 0


def test_hashes_in_order(spark, cut_up, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE_CHARS", 10)
    rows = [(k % 3 if k % 7 else None, k, f"v{k}") for k in range(200)]
    got = ordered.hash_in_order(spark.createDataFrame(rows, "g int, k int, v string"), ["g"], ["k"], "v", ", ").collect()
    want = {}
    for g, _, v in rows:
        want.setdefault(g, []).append(v)
    assert dict(map(tuple, got)) == {g: hashlib.sha256(", ".join(v).encode()).hexdigest() for g, v in want.items()}
