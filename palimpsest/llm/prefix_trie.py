"""Trie of conversation prefixes.

A node is a distinct sequence of first turns; its members are the
conversations that begin with it, and its owner is the least of them.  What
a conversation owns is the end of its own path: an owner of a prefix owns
every longer prefix of itself.  So one number, the first depth that it owns,
describes a conversation's part of the trie, a chain.  That depth is found by
binary search for all conversations at once, each round a join of their
probes with the least members of all prefixes.  Chains hang on chains, and
each chain's sums go to the nodes above its head, which are the prefixes that
it doesn't own; so no round per level of nesting is needed.

Prefixes are known by a polynomial of their turns' digests modulo a prime of
127 bits.  It can be put together from parts: a conversation that lies in
several partitions is read as runs whose polynomials are joined, and a
borrowed beginning replaces another without a second pass over the turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stored
from .ordered import RANGE_CHARS, hash_in_order, in_runs

#: Fixed values of the polynomial, and the digest of no turns.
PRIME = 2**127 - 1
BASE = int("9e3779b97f4a7c15f39cc0605cedc835", 16) % PRIME
NOTHING = bytes(16)
#: Most turns that a conversation borrows, and how many ids lend from one conversation.
MOST_BORROWED, FAMILY = 5, 100
#: Depths of a chain that are summed in one group.
SPAN = 4096


@lru_cache(1 << 16)
def _power(n: int) -> int:
    return pow(BASE, n, PRIME)


def _number(b: bytes | None) -> int:
    return int.from_bytes(b, "big") if b else 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank and polynomial of each turn within its run."""
    last, n, f = None, 0, 0
    for b in batches:
        ranks, values = [], []
        for c, d in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if c != last:
                last, n, f = c, 0, 0
            n += 1
            f = (f * BASE + int(d[:32], 16) + 1) % PRIME
            ranks.append(n)
            values.append(f.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranks, pa.int64()), pa.array(values, pa.binary()), b.column(3)], ["conv_id", "part", "rank", "f", "chars"])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a conversation: turns and polynomial of the runs before it, and all its turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("carried", pa.binary()), ("total", pa.int64())])
    for b in batches:
        out = []
        for c, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, f, total = 0, 0, sum(r["n"] for r in runs)
            for r in runs:
                out.append({"conv_id": c, "part": r["part"], "before": n, "carried": f.to_bytes(16, "big"), "total": total})
                n, f = n + r["n"], (f * _power(r["n"]) + _number(r["f"])) % PRIME
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth, p, chars from conv_id, rank in the run, f, chars, before, carried, own, lent (from polynomials of what is replaced by what), borrowed, kept.

    Rank r of a conversation whose first ``own`` turns are replaced by
    ``lent`` others stands at depth r - own + lent.
    """
    for b in batches:
        rank, f, before, carried, own, lent, gone, come = (b.column(i).to_pylist() for i in (1, 2, 4, 5, 6, 7, 8, 9))
        depths, values = [], []
        for r, x, s, c, o, k, g, t in zip(rank, f, before, carried, own, lent, gone, come):
            n = s + r
            value = (_number(c) * _power(r) + _number(x) + (_number(t) - _number(g)) * _power(n - o)) % PRIME
            depths.append(n - o + k)
            values.append(value.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, pa.int64()), pa.array(values, pa.binary()), b.column(3)], ["conv_id", "depth", "p", "chars"])


def _bucketed(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """``df`` as a stored table with buckets by ``cols``: joins on them move only the other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *cols).write.format("parquet").bucketBy(n, *cols).sortBy(*cols).option("path", scratch_dir(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All prefixes of the rebuilt conversations (conv_id, depth from 0, p, chars of the last turn), and conv_id with its length."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    # Equal rows are interchangeable, so a random number may part them.
    rows = rows.withColumn("cut", F.substring("text", 1, RANGE_CHARS)).withColumn("salt", F.rand(7))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    runs = in_runs(rows, [*order, F.col("cut"), F.col("salt")], [*order, F.col("text"), F.col("salt")])
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    turns = stored(runs.select("conv_id", "part", digest.alias("digest"), F.length("text").cast("long").alias("chars")).mapInArrow(_scan, "conv_id bigint, part int, rank bigint, f binary, chars bigint"), "turns")
    runs = turns.groupBy("conv_id", "part").agg(F.max("rank").alias("n"), F.max_by("f", "rank").alias("f"))
    runs = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "f"))).alias("runs"))
    runs = stored(runs.mapInArrow(_carry, "conv_id bigint, part int, before bigint, carried binary, total bigint"), "runs")

    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("binary")
    heads = turns.where(F.col("rank") <= MOST_BORROWED).join(runs, ["conv_id", "part"]).where(F.col("before") + F.col("rank") <= MOST_BORROWED)
    heads = heads.select("conv_id", "rank", "f", "chars", "before", "carried", zero.alias("own"), zero.alias("lent"), none.alias("gone"), none.alias("come"))
    heads = stored(heads.mapInArrow(_whole, "conv_id bigint, depth bigint, p binary, chars bigint"), "heads")

    convs = runs.where("before = 0").groupBy("conv_id").agg(F.max("total").alias("total"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)).withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}"))
    lenders = convs.select(F.col("conv_id").alias("family"), F.col("total").alias("lender_total"))
    convs = convs.join(lenders, "family", "left").withColumn("lent", F.least("h", F.coalesce("lender_total", zero))).withColumn("own", F.least("h", "total"))
    come = heads.select(F.col("conv_id").alias("family"), F.col("depth").alias("lent"), F.col("p").alias("come"))
    gone = heads.select("conv_id", F.col("depth").alias("own"), F.col("p").alias("gone"))
    convs = stored(convs.join(come, ["family", "lent"], "left").join(gone, ["conv_id", "own"], "left").withColumn("len", F.expr("lent + total - own")), "rebuilt")

    own = turns.join(runs.drop("total").join(convs.select("conv_id", "own", "lent", "gone", "come"), "conv_id"), ["conv_id", "part"]).where(F.col("before") + F.col("rank") > F.col("own"))
    own = own.select("conv_id", "rank", "f", "chars", "before", "carried", "own", "lent", "gone", "come").mapInArrow(_whole, "conv_id bigint, depth bigint, p binary, chars bigint")
    lent = convs.where("lent > 0").select("conv_id", "family", "lent").join(heads.withColumnRenamed("conv_id", "family"), "family").where("depth <= lent").select("conv_id", "depth", "p", "chars")
    root = convs.select("conv_id", zero.alias("depth"), F.lit(NOTHING).alias("p"), zero.alias("chars"))
    return _bucketed(own.unionByName(lent).unionByName(root), ["conv_id", "depth"], "prefixes"), convs.select("conv_id", "len")


def first_owned(paths: DataFrame, nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Binary search for the first depth that each conversation owns: conv_id, len, first (len + 1: none), and the owner, depth and p of the node above (null above the root).

    ``lo`` is a depth known not to be owned, ``hi`` one that is (or len + 1);
    a round asks for the depth between them.  Conversations that are done
    leave the rounds, of which there are at most log2 of the greatest length.
    """
    none = F.lit(None)
    state = lengths.select("conv_id", "len", F.lit(-1).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"), none.cast("long").alias("up"), none.cast("binary").alias("up_p"))
    state = stored(state, "search")
    done = [state.where("hi - lo <= 1")]
    while not (todo := state.where("hi - lo > 1")).isEmpty():
        asked = todo.withColumn("depth", F.expr("lo + (hi - lo) div 2")).join(paths.select("conv_id", "depth", "p"), ["conv_id", "depth"])
        asked = asked.join(nodes.select("depth", "p", "owner"), ["depth", "p"])
        mine = F.col("owner") == F.col("conv_id")
        state = stored(
            asked.select(
                "conv_id", "len", F.when(mine, F.col("lo")).otherwise(F.col("depth")).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
                F.when(mine, F.col("up")).otherwise(F.col("owner")).alias("up"), F.when(mine, F.col("up_p")).otherwise(F.col("p")).alias("up_p")), "search")
        done.append(state.where("hi - lo <= 1"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stored(out.select("conv_id", "len", F.col("hi").alias("first"), F.col("lo").alias("up_depth"), "up", "up_p"), "chains")


def trie(conversations: DataFrame) -> DataFrame:
    """The trie's nodes, one row each: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id are left out; null roles and texts are empty; turns
    of equal number stand in order of role, then text; repeated rows are turns
    of their own; other columns are ignored.  Without conversations there is
    no node, not even the root.  A conversation that borrows nothing and has
    no more turns than it would replace ends in the root.
    """
    paths, lengths = prefixes(conversations)
    nodes = _bucketed(paths.groupBy("depth", "p").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), ["depth", "p"], "prefix_nodes")
    chains = first_owned(paths, nodes, lengths)

    hung = stored(chains.where("first <= len AND first > 0").groupBy(F.col("up_depth").alias("depth"), F.col("up_p").alias("p")).agg(F.count("*").alias("n_hung")), "hung")
    ends = stored(chains.select("conv_id", "first", F.col("len").alias("depth")).join(paths.select("conv_id", "depth", "p"), ["conv_id", "depth"]), "ends")
    leaves = ends.where("first <= depth").join(hung, ["depth", "p"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))

    # Sums along the chain, from its end: in spans of depths first, then over whole spans.
    shared = nodes.where("n_convs > 1").select("owner", "depth", "p", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.expr(f"depth div {SPAN}").alias("span"))
    spans = shared.groupBy("owner", "span").agg(F.sum("saved").alias("s"))
    after = F.sum("s").over(Window.partitionBy("owner").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1))
    spans = stored(spans.select("owner", "span", "s", F.coalesce(after, F.lit(0)).alias("after")), "spans")
    along = shared.join(spans.select("owner", "span", "after"), ["owner", "span"])
    down = F.sum("saved").over(Window.partitionBy("owner", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    along = along.select("depth", "p", (down + F.col("after")).alias("along"))

    # What a chain holds goes to all nodes above its head.
    held = chains.where("first > 0 AND first <= len").select("conv_id", "first").join(spans.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("s").alias("s")), "conv_id", "left").join(leaves, "conv_id", "left")
    above = paths.select("conv_id", "depth", "p").join(held, "conv_id").where("depth < first").groupBy("depth", "p").agg(F.sum(F.coalesce("s", F.lit(0))).alias("hung_saved"), F.sum(F.coalesce("leaf", F.lit(0))).alias("hung_leaves"))
    ended = hash_in_order(ends.select("depth", "p", "conv_id", F.col("conv_id").cast("string").alias("member")), ["depth", "p"], ["conv_id"], "member", ",")

    out = nodes.join(along, ["depth", "p"], "left").join(above, ["depth", "p"], "left").join(hung, ["depth", "p"], "left").join(ended, ["depth", "p"], "left")
    heads = chains.select(F.col("conv_id").alias("owner"), "first", "len", "up").join(leaves.withColumnRenamed("conv_id", "owner"), "owner", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.join(heads, "owner").select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("owner")).cast("long").alias("parent_conv_id"),
        "n_convs", (count("n_hung") + (F.col("depth") < F.col("len")).cast("long")).alias("n_children"), (count("leaf") + count("hung_leaves")).alias("n_leaves"),
        (count("along") + count("hung_saved")).alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
