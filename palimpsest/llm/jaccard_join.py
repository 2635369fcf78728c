"""N-gram Jaccard join by prefix trees, over all documents.

1. Each document's set of word shingles gets a 16-byte key; equal sets are one
   class from here on, however many copies there are.
2. A class can only link if enough of its shingles occur in another class.  In
   hash order, the first ``n - need + k`` shingles of two linked classes have
   ``k`` in common, so only those are counted, in packed runs.  Classes that
   fail this test, nearly all of a common corpus, end here.
3. For the rest, shingles that one class alone holds are reduced to their
   number.  Classes with the same remaining shingles and size are one *reduced*
   class: near copies of a text that differ in words of their own fall together.
4. Reduced classes meet in blocks by two min-hash values, and each block is
   joined by :mod:`trie_join`.  A large bucket is dealt to several blocks, anew
   for each of the two values, so that its members still hang together.
5. What the blocks missed is found exactly: two linked classes share a shingle
   among their ``n - need + 1`` rarest.  Of the groups by such a shingle, those
   whose members already are in one component are done; of the others, members
   whose parity bits leave room for a link are joined by a tree too, groups over
   the block size as pairs of blocks.

A link is decided by whole sets and the exact fraction.  Links are kept as
what holds components together, never as all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trie_join
from .common import documents_of, stored
from .components import components
from .shingles import mixed, set_key, shingle_sets
from .tokens import slices

#: Members of a block; a pair of blocks has twice as many.
BLOCK = 512
#: Shingles packed between two flushes, and shingles of one group of a shuffle.
FLUSH, GROUP = 1 << 20, 1 << 21
#: Shingles whose counts each task is told; rarer ones are counted by shuffling.
HEAVY = 100_000
#: Up to this many ids, a list of documents is broadcast.
BROADCAST_IDS = 1_000_000
#: Values that more than one in ``HOT_KEYS`` rows has, and more than ``HOT_COPIES``, are joined by broadcast.
HOT_KEYS, HOT_COPIES = 10_000, 1_000

_PACKED = "part long, keys binary, counts binary, low binary, high binary, extra binary"


def need(n, percent: int):
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def spare(n, percent: int):
    """Shingles that two linked sets must share in the part of them that is counted."""
    return np.maximum(1, n * (100 - percent) // 200)


def key8(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") or 1


def digests(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and the ``key`` of the set (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "key"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary")


class Packer:
    """Collects (key, shingles) and sends them on as rows for each part of the hash space.

    A row holds the keys of a part, how many shingles each has there, and the
    low 48 bits of those shingles.
    """

    def __init__(self, parts: int, collapse: bool):
        self.parts, self.collapse = parts, collapse
        self.clear()

    def clear(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.total = 0

    def add(self, key: int, tokens: np.ndarray) -> None:
        if key not in self.sets:
            self.sets[key] = tokens
            self.total += len(tokens)

    def rows(self) -> Iterator[tuple]:
        """(part, keys, counts, low, high, extra) of all that was added since the last call."""
        if not self.total:
            self.clear()
            return
        keys = np.repeat(np.array(list(self.sets), np.uint64), [len(t) for t in self.sets.values()])
        tokens = np.concatenate(list(self.sets.values()))
        if self.collapse:
            # A shingle of several classes here goes out once, under key 0; their credit is known now.
            order = np.argsort(tokens, kind="stable")
            keys, tokens = keys[order], tokens[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            runs = np.diff(np.append(first, len(tokens)))
            many = np.repeat(runs > 1, runs)
            if many.any():
                who, credit = np.unique(keys[many], return_counts=True)
                spread = int(who[0] % np.uint64(self.parts))
                yield spread, who.tobytes(), credit.astype("<u4").tobytes(), None, None, None
            lead = np.zeros(len(tokens), bool)
            lead[first] = True
            keys = np.where(many, np.uint64(0), keys)
            keys, tokens = keys[~many | lead], tokens[~many | lead]
        part = (mixed(tokens) >> np.uint64(32)) % np.uint64(self.parts)
        order = np.lexsort((keys, part))
        keys, tokens, part = keys[order], tokens[order], part[order]
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(bounds, bounds[1:]):
            own = keys[a:b]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.append(head, b - a))
            yield int(part[a]), own[head].tobytes(), counts.astype("<u4").tobytes(), (tokens[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((tokens[a:b] >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes(), None
        self.clear()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


_PACKED_SCHEMA = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in ("keys", "counts", "low", "high", "extra"))])


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and shingles (48 bits) of all packed rows, key by key."""
    keys, tokens = [], []
    for k, c, lo, hi in zip(*(table.column(n).to_pylist() for n in ("keys", "counts", "low", "high"))):
        if lo is not None:
            keys.append(np.repeat(np.frombuffer(k, np.uint64), np.frombuffer(c, "<u4")))
            tokens.append(np.frombuffer(lo, "<u4").astype(np.uint64) | np.frombuffer(hi, "<u2").astype(np.uint64) << np.uint64(32))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *keys]), np.concatenate([none, *tokens])


def shared_counts(docs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """``k8``, ``shared``: for each class by its short key, how many of its counted shingles another class has.

    Copies of a set may add to it more than once; it is never too low.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, collapse=True)
        for batch in batches:
            for part in slices(batch):
                for tokens in shingle_sets(part.column(0), size):
                    n = len(tokens)
                    if n:
                        packer.add(key8(set_key(tokens)), tokens[: n - need(n, percent) + int(spare(n, percent))])
                if packer.total >= flush_at(parts):
                    yield _batch(list(packer.rows()), _PACKED_SCHEMA)
        yield _batch(list(packer.rows()), _PACKED_SCHEMA)

    def count(table: pa.Table) -> pa.Table:
        who, credit = [], []
        for k, c, lo in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), table.column("low").to_pylist()):
            if lo is None:
                who.append(np.frombuffer(k, np.uint64))
                credit.append(np.frombuffer(c, "<u4").astype(np.int64))
        keys, tokens = _unpack(table)
        if len(keys):
            order = np.lexsort((keys, tokens))
            keys, tokens = keys[order], tokens[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            runs = np.diff(np.append(first, len(tokens)))
            # Keys ascend within a run: several classes if the first differs from the last, or is 0.
            last = first + runs - 1
            several = np.repeat((keys[first] != keys[last]) | (keys[first] == 0), runs)
            once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])])
            k, n = np.unique(keys[several & once & (keys != 0)], return_counts=True)
            who.append(k)
            credit.append(n)
        who, credit = np.concatenate([np.zeros(0, np.uint64), *who]), np.concatenate([np.zeros(0, np.int64), *credit])
        whose, at = np.unique(who, return_inverse=True)
        return pa.table({"k8": whose.view(np.int64), "shared": np.bincount(at, credit, len(whose)).astype(np.int64)})

    packed = docs.select("text").mapInArrow(send, _PACKED)
    return packed.groupBy("part").applyInArrow(count, "k8 long, shared long").groupBy("k8").agg(F.sum("shared").alias("shared"))


def survivors(docs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored ``key``, ``n``, ``tokens``, ``k8`` of the classes that may link, each at least once; no two have the same ``k8``."""
    classes = known.where("key is not null").groupBy("key").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"))
    total = known.agg(F.sum("n_shingles").alias("t")).first()["t"] or 0
    shared = shared_counts(docs, size, percent, parts_of(total * (100 - percent) * 3 // 200))
    least = F.greatest(F.lit(1), F.floor((F.ceil(F.col("n") * percent / 100)) * (100 - percent) / 200))
    some = classes.withColumn("k8", _k8(F.col("key"))).join(shared, "k8").where(F.col("shared") >= least).select("key", "rep")
    some = stored(some, "candidates")
    # A class goes by eight bytes of its key from here on; they are drawn again if two classes have the same.
    salt = 0
    while not some.groupBy(_k8(F.col("key"), salt)).count().where("count > 1").isEmpty():
        salt += 1
    small = some.count() <= BROADCAST_IDS
    ids = F.broadcast(some.select("rep")) if small else some.select("rep")
    few = docs.join(ids, docs.doc_id.eqNullSafe(ids.rep), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                full = [(set_key(s), s) for s in shingle_sets(part.column(0), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.binary()), pa.array([len(s) for _, s in full], pa.int64()), pa.array([s.tobytes() for _, s in full], pa.binary())], names=["key", "n", "tokens"])

    found = few.select("text").mapInArrow(sets, "key binary, n long, tokens binary")
    keys = F.broadcast(some.select("key")) if small else some.select("key")
    return stored(found.join(keys, "key", "left_semi").withColumn("k8", _k8(F.col("key"), salt)), "survivors")


def _k8(key: Column, salt: int = 0) -> Column:
    """As :func:`key8`, as a signed number; with a salt, another number for the same key."""
    short = F.xxhash64(key, F.lit(salt)) if salt else F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")
    return F.when(short == 0, F.lit(1)).otherwise(short)


def parts_of(shingles: int) -> int:
    """Groups of a shuffle of ``shingles``; they grow in number, never in size."""
    return int(max(8, shingles // GROUP))


def flush_at(parts: int) -> int:
    """Shingles that a task packs at a time: more for very many parts, so that packed rows stay worth their keys."""
    return min(max(FLUSH, 8 * parts), max(FLUSH, 1 << 23))


def heavy_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HEAVY`` shingles (48 bits, ascending) that many classes hold, with a count of each.

    Tasks count the whole of what they read and send on what occurs more than
    once; the counts order shingles and decide nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["t", "c"])

        held, total = [], 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint64) & np.uint64(0xFFFFFFFFFFFF))
                total += len(held[-1])
                if total >= FLUSH:
                    yield out(held)
                    held, total = [], 0
        if held:
            yield out(held)

    top = sets.select("tokens").mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "t").limit(HEAVY)
    rows = top.toPandas().sort_values("t")
    return rows["t"].to_numpy(np.uint64), rows["c"].to_numpy(np.int64)


def with_shared(sets: DataFrame, percent: int) -> DataFrame:
    """Stored reduced form of each class: its shingles that another class has, the rarest first.

    ``key``, ``n``, ``own`` (shingles that no other class has), ``rare`` (48-bit
    shingles), ``rkey`` (of the reduced class).  Classes with too few are gone.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum("n").alias("t")).first()["t"] or 0
    parts = parts_of(total)
    heavy = spark.sparkContext.broadcast(heavy_shingles(sets))

    def lookup(t: np.ndarray) -> np.ndarray:
        """Counts of those that are heavy, 0 for others."""
        known, count = heavy.value
        if not len(known):
            return np.zeros(len(t), np.int64)
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        return np.where(known[at] == t, count[at], 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, collapse=False)
        done: set[int] = set()
        for b in batches:
            rows = []
            for key, n, raw, short in zip(*(b.column(i).to_pylist() for i in range(4))):
                k = short % 2**64
                if k in packer.sets or k in done:
                    continue
                tokens = np.frombuffer(raw, np.uint64) & np.uint64(0xFFFFFFFFFFFF)
                count = lookup(tokens)
                # Heavy ones need no shuffle: they travel with the class itself.
                rows.append((k % parts, np.array([k], np.uint64).tobytes(), np.array([n], "<u4").tobytes(), tokens[count > 0].tobytes(), count[count > 0].tobytes(), key))
                packer.add(k, tokens[count == 0])
                if len(done) < 1 << 18:
                    done.add(k)
            yield _batch(rows, _PACKED_SCHEMA)
            if packer.total >= flush_at(parts):
                yield _batch(list(packer.rows()), _PACKED_SCHEMA)
        yield _batch(list(packer.rows()), _PACKED_SCHEMA)

    def count(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        whole = table.filter(pc.is_valid(table.column("extra")))
        for k, c, t, n, key in zip(*(whole.column(x).to_pylist() for x in ("keys", "counts", "low", "high", "extra"))):
            out.append((int(np.frombuffer(k, np.int64)[0]), key, int(np.frombuffer(c, "<u4")[0]), t, n))
        keys, tokens = _unpack(table.filter(pc.is_null(table.column("extra"))))
        if len(keys):
            order = np.lexsort((keys, tokens))
            keys, tokens = keys[order], tokens[order]
            once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])])
            keys, tokens = keys[once], tokens[once]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            runs = np.diff(np.append(first, len(tokens)))
            df = np.repeat(runs, runs)
            keys, tokens, df = keys[df > 1], tokens[df > 1], df[df > 1]
            order = np.argsort(keys, kind="stable")
            keys, tokens, df = keys[order], tokens[order], df[order]
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            for a, b in zip(bounds, bounds[1:]):
                out.append((int(keys[a : a + 1].view(np.int64)[0]), None, None, tokens[a:b].tobytes(), df[a:b].astype(np.int64).tobytes()))
        names = ["k8", "key", "n", "t", "c"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out), types)] if out else [pa.array([], x) for x in types], names=names)

    pieces = sets.select("key", "n", "tokens", "k8").mapInArrow(send, _PACKED).groupBy("part").applyInArrow(count, "k8 long, key binary, n long, t binary, c binary")
    whole = pieces.groupBy("k8").agg(F.max("key").alias("key"), F.max("n").alias("n"), F.collect_list(F.struct("t", "c")).alias("pieces"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, n, pieces in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = np.concatenate([np.frombuffer(p["t"], np.uint64) for p in pieces])
                c = np.concatenate([np.frombuffer(p["c"], np.int64) for p in pieces])
                t, at = np.unique(t, return_index=True)
                c = c[at]
                if len(t) >= need(n, percent):
                    rare = t[np.lexsort((t, c))]
                    rows.append((key, n, n - len(t), rare.tobytes(), parity(t), hashlib.blake2b(n.to_bytes(8, "little") + t.tobytes(), digest_size=16).digest()))
            yield _batch(rows, _REDUCED)

    return stored(whole.select("key", "n", "pieces").mapInArrow(reduce, "key binary, n long, own long, rare binary, bits binary, rkey binary"), "reduced")


_REDUCED = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("own", pa.int64()), ("rare", pa.binary()), ("bits", pa.binary()), ("rkey", pa.binary())])


def block_links(rows: DataFrame, percent: int, with_groups: bool) -> DataFrame:
    """``a``, ``b``: links that hold each block together, by tree join.

    ``rows``: ``block``, ``rkey``, ``n``, ``rare``, ``grp`` (what counts as linked already, if ``with_groups``).
    """

    def join(table: pa.Table) -> pa.Table:
        rkeys, groups = table.column("rkey").to_pylist(), table.column("grp").to_pylist()
        sets = [np.frombuffer(x, np.uint64)[::-1] for x in table.column("rare").to_pylist()]
        pairs = trie_join.links(sets, table.column("n").to_pylist(), percent, groups if with_groups else None) if len(rkeys) > 1 else []
        end = groups if with_groups else rkeys
        return pa.table([pa.array([end[i] for i, _ in pairs], pa.binary()), pa.array([end[j] for _, j in pairs], pa.binary())], names=["a", "b"])

    return rows.select("block", "rkey", "n", "rare", "grp").groupBy("block").applyInArrow(join, "a binary, b binary")


def _min_hashes(rare: pa.Array) -> list[list[int]]:
    out = []
    for raw in rare.to_pylist():
        t = np.frombuffer(raw, np.uint64)
        out.append([int((mixed(t + np.uint64(s)) >> np.uint64(1)).min()) for s in (0x51ED27, 0xA3B195)])
    return out


def first_links(reduced: DataFrame, percent: int) -> DataFrame:
    """Links within blocks by two min-hash values of the shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_min_hashes(b.column(1)), pa.list_(pa.int64()))], names=["rkey", "mh"])

    values = reduced.select("rkey", "rare").mapInArrow(run, "rkey binary, mh array<long>").select("rkey", F.posexplode("mh").alias("j", "mh"))
    values = stored(values, "min-hashes")
    sizes = values.groupBy("j", "mh").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = values.join(sizes, ["j", "mh"]).select("rkey", F.struct("j", "mh", F.pmod(F.xxhash64("rkey", "j"), F.ceil(F.col("size") / BLOCK)).alias("salt")).alias("block"))
    return block_links(dealt.join(reduced.select("rkey", "n", "rare"), "rkey").withColumn("grp", F.lit(None).cast("binary")), percent, False)


def rest_links(reduced: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links between different groups, exact: by every rare shingle that two linked classes must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rkeys, shingles, mids = [], [], []
            for rkey, n, own, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                t = np.frombuffer(raw, np.int64)
                # The own ones come first in order of rarity and match nothing.
                most = max(0, n - need(n, percent) + 1 - own)
                mid = max(0, n - trie_join.needed(n, n, percent) + 1 - own)
                rkeys.append(rkey)
                shingles.append(t[:most])
                mids.append(np.arange(len(t[:most])) < mid)
            yield pa.RecordBatch.from_arrays([pa.array(rkeys, pa.binary()), pa.array(shingles, pa.list_(pa.int64())), pa.array(mids, pa.list_(pa.bool_()))], names=["rkey", "w", "mid"])

    at = reduced.select("rkey", "n", "own", "rare").mapInArrow(run, "rkey binary, w array<long>, mid array<boolean>")
    rows = at.join(groups, "rkey").select("rkey", "grp", F.explode(F.arrays_zip("w", "mid")).alias("x")).select("rkey", "grp", F.col("x.w").alias("w"), F.col("x.mid").alias("mid"))
    rows = stored(rows, "rare-shingles")
    h = F.xxhash64("rkey")
    # Groups with the same members need one look; the shorter of a linked pair has the shingle in its middle part.
    mixed_groups = rows.groupBy("w").agg(F.count(F.lit(1)).alias("size"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("mid").alias("mid")).where("lo != hi and mid")
    chosen = stored(mixed_groups.groupBy("size", "sum", "xor").agg(F.min("w").alias("w")).select("w", "size"), "mixed-groups")
    own = F.pmod(F.xxhash64("rkey", "w"), F.col("parts"))
    dealt = rows.select("w", "rkey", "grp").join(chosen.select("w", F.ceil(F.col("size") / BLOCK).alias("parts")), "w").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("rkey", "grp", F.struct("w", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).alias("block"))
    kept = sift(dealt.join(reduced.select("rkey", "n", "own", "bits"), "rkey"), percent)
    return block_links(kept.join(reduced.select("rkey", "n", "rare"), "rkey"), percent, True)


def sift(rows: DataFrame, percent: int) -> DataFrame:
    """The members of each block that may link with one of another group there, by their parity bits alone."""

    def run(table: pa.Table) -> pa.Table:
        n, own = table.column("n").to_numpy(), table.column("own").to_numpy()
        bits, groups = table.column("bits").to_pylist(), table.column("grp").to_pylist()
        names = {g: i for i, g in enumerate(set(groups))}
        return table.select(["block", "rkey", "grp"]).filter(pa.array(may_link(n, own, bits, np.array([names[g] for g in groups]), percent)))

    return rows.select("block", "rkey", "grp", "n", "own", "bits").groupBy("block").applyInArrow(run, rows.select("block", "rkey", "grp").schema)


def parity(tokens: np.ndarray) -> bytes:
    """For each slot of a hash, whether an odd number of the shingles fall there; about two slots for each shingle.

    Two sets differ in at least as many shingles as their bits differ in slots.
    """
    slots = 1 << int(np.clip(np.ceil(np.log2(2 * max(1, len(tokens)))), 6, 15))
    held = np.bincount((mixed(tokens) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: np.ndarray, own: np.ndarray, bits: list[bytes], group: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a row of another group that they may link with: sizes and parity bits allow the overlap."""
    shared = n - own
    widths = np.array([len(b) for b in bits])
    out = np.zeros(len(n), bool)
    folded = [np.frombuffer(b, np.uint64) for b in bits]
    for width in sorted(set(widths.tolist()), reverse=True):
        # Pairs whose narrower row has this width; wider rows are folded onto it, which keeps parity.
        at = np.flatnonzero(widths >= width)
        for i in at:
            while folded[i].nbytes > width:
                half = len(folded[i]) // 2
                folded[i] = folded[i][:half] ^ folded[i][half:]
        table = np.stack([folded[i] for i in at])
        for k, i in enumerate(at):
            if widths[i] != width:
                continue
            differ = np.bitwise_count(table ^ table[k]).sum(axis=1, dtype=np.int64)
            most = np.minimum((shared[at] + shared[i] - differ) // 2, np.minimum(shared[at], shared[i]))
            hit = (most * (100 + percent) >= percent * (n[at] + n[i])) & (group[at] != group[i])
            if hit.any():
                out[i] = True
                out[at[hit]] = True
    return out


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """For every row ``doc_id``, ``n_shingles``, ``component_id``, the ``key`` of its set and ``grp`` of its component (both null: no words)."""
    base = documents_of(docs, id_col, text_col)
    known = stored(digests(base, size), "digests")
    members = with_shared(survivors(base, known, size, percent), percent)
    single = members.groupBy("rkey").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("members"), F.min(F.expr(f"100 * (n - own) >= {percent} * (n + own)")).alias("alike"))
    reduced = stored(members.join(single.select("rkey", "key"), ["rkey", "key"], "left_semi").select("rkey", "n", "own", "rare", "bits"), "reduced-classes")
    first = components(first_links(reduced, percent)).withColumnRenamed("node", "rkey")
    groups = stored(reduced.select("rkey").join(first, "rkey", "left").select("rkey", F.coalesce("root", "rkey").alias("grp")), "groups")
    more = components(rest_links(reduced, groups, percent)).withColumnRenamed("node", "grp")
    final = groups.join(more, "grp", "left").select("rkey", F.coalesce("root", "grp").alias("root"))
    # A reduced class without a link leaves its members alone, unless they link with each other.
    linked = final.join(single.where("members > 1 and alike").select("rkey", F.lit(True).alias("alike")), "rkey", "left")
    sizes = final.groupBy("root").agg(F.count(F.lit(1)).alias("n_reduced"))
    linked = linked.join(sizes, "root").where("n_reduced > 1 or alike").select("rkey", "root")
    classes = known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    tied = stored(members.select("key", "rkey").join(linked, "rkey").join(classes.select("key", "rep"), "key").select("key", "root", "rep"), "tied")
    least = stored(tied.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("copies")), "least-ids")
    ids = join_named(tied.select("key", "root"), least, "root")
    named = classes.join(ids, "key", "left").select("key", F.coalesce("root", "key").alias("grp"), F.coalesce("least", "rep").alias("component_id"), "copies")
    worded = join_named(known.where("key is not null"), stored(named, "named-classes"), "key")
    columns = ["doc_id", "n_shingles", "key", "grp", "component_id"]
    alone = known.where("key is null").select("doc_id", "n_shingles", "key", F.col("key").alias("grp"), F.col("doc_id").alias("component_id"))
    return worded.select(*columns).unionByName(alone)


def join_named(rows: DataFrame, named: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``named``, which has one row for each value of ``on`` and says in ``copies`` how many rows have it.

    Values of very many rows are joined where the rows lie.  Fewer than
    ``HOT_KEYS`` values can have more than one in ``HOT_KEYS`` of all rows, so
    that their broadcast is bounded whatever the size; no other value has more
    rows than that in its task.
    """
    most = max(HOT_COPIES, rows.count() // HOT_KEYS)
    hot = F.broadcast(named.where(F.col("copies") > most).drop("copies"))
    rest = named.where(F.col("copies") <= most).drop("copies")
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(rest, on))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least id reachable by links) of every row.

    Two rows link when the Jaccard likeness of their sets of ``size``-word
    shingles is ``percent`` hundredths or more.  Texts with fewer words have
    their whole sequence as one shingle.

    Null or empty text, or text without words, links with nothing and is a
    component of its own.  Repeated rows and equal ids with different texts are
    rows of their own.  Null ids link like others but name no component, unless
    it has no other id.  An empty table gives an empty result.
    """
    return grouped(docs, id_col, text_col, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their group: one row of each component stays, with all columns.

    Of rows with equal ids in one component, one stays (any); rows of null id
    stay, one for each component, if it has no other id.  Rows without words are
    components of their own and stay, repeated ones too.  Columns of any name
    are kept; an empty table gives an empty result.

    Only ids move: the rows that go are told to the tasks that read ``docs``.
    Texts are shuffled when more than ``BROADCAST_IDS`` go.
    """
    found = stored(grouped(docs, id_col, text_col, size, percent), "groups-of-rows")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c"))
    several = F.col("doc_id").isNull() | (F.col("n") > 1)
    leaving = stored(ids.where(several | (F.col("doc_id") != F.col("c"))).select("doc_id", several.alias("several")), "leaving-ids")
    a, b, c = free_names(docs, 3)
    own_id = docs[id_col].cast("long")

    def told(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(a))
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

    plain = docs.join(told(leaving), own_id.eqNullSafe(F.col(a)), "left_anti")
    mixed_ids = leaving.where("several")
    if mixed_ids.isEmpty():
        return plain

    def keys(texts: pd.Series) -> pd.Series:
        sets = shingle_sets(pa.array(texts, pa.string()), size)
        return pd.Series([set_key(s) if len(s) else None for s in sets], dtype=object)

    # Ids alone don't tell these rows apart: their sets do.
    rows = docs.join(told(mixed_ids), own_id.eqNullSafe(F.col(a)), "left_semi")
    rows = rows.withColumn(b, F.pandas_udf(keys, "binary")(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    heads = found.join(mixed_ids, found.doc_id.eqNullSafe(mixed_ids.doc_id), "left_semi").where("key is not null and doc_id <=> component_id")
    heads = heads.select(F.struct("doc_id", "key").alias(a), "grp").distinct().select(a, F.col("grp").alias(c))
    worded = rows.join(heads, F.struct(own_id.alias("doc_id"), F.col(b).alias("key")).eqNullSafe(F.col(a)))
    worded = worded.withColumn(a, F.col(a)["doc_id"]).dropDuplicates([a, c])
    return plain.unionByName(worded.drop(a, b, c)).unionByName(rows.where(F.col(b).isNull()).drop(b))


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have, in any case."""
    taken = {x.lower() for x in df.columns}
    return [x for x in (f"_own{i}" for i in range(len(taken) + n)) if x not in taken][:n]


__all__: Sequence[str] = ("one_of_each", "similar_groups")
