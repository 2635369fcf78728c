"""Near duplicates among embeddings, by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a Hadamard
transform and takes the axis that it then lies nearest to; two hashes make a
bucket, and each of ``TABLES`` tables puts a vector into the ``PROBES``
buckets whose axes are nearest in sum.  At cosine 0.95 two vectors of 64
components share a bucket of one table with probability 0.91, so all five
tables miss such a pair about 6 times in a million, and pairs of cosine 0.98
far less often; every pair that is linked has been compared in full.

Vectors move late.  First buckets are searched by sketches of 128 signs, which
tell the vectors that have a partner at all; sketches of linked pairs differ
in more than ``SKETCH_BITS`` bits about 3 times in 10^9.  Then only those
vectors go to those buckets, and cosines are taken by blocks of a matrix
product.  A pair is counted in one bucket, its home: in the first table where
the two meet, the bucket of both first choices if these are one, else the
least common one.  Equal vectors are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

TABLES, PROBES, SKETCH_BITS = 5, 4, 36
#: Axes of each hash that are considered, and the most that a bucket may hold before it is compared as pairs of parts.
_AXES, BUCKET_ROWS = 3, 65_536
#: Vectors compared at a time, and classes that a task remembers to leave out their repeats.
_BLOCK, REMEMBERED = 1024, 100_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _turned(x: np.ndarray, number: int) -> np.ndarray:
    signs = np.random.default_rng([number, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = _hadamard(x * s)
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    """Unit vectors, lengthened by zeros to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    # The greatest component is divided out first, so that no square over- or underflows.
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def buckets(x: np.ndarray) -> np.ndarray:
    """TABLES * PROBES keys of each row, table by table, first choices first.  A key holds dimension, table and two axes."""
    dim, x = x.shape[1], _padded(x)
    n, out = x.shape[1], []
    for t in range(TABLES):
        axes, loss = [], []
        for j in (2 * t, 2 * t + 1):
            z = _turned(x, j)
            both = np.concatenate((z, -z), 1)
            k = min(_AXES, 2 * n)
            top = np.argsort(-both, 1, kind="stable")[:, :k]
            far = np.take_along_axis(both, top, 1)
            axes.append(top)
            loss.append((far[:, :1] - far) ** 2)
        total = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(x), -1)
        best = np.argsort(total, 1, kind="stable")[:, :PROBES]
        k = axes[1].shape[1]
        key = np.take_along_axis(axes[0], best // k, 1).astype(np.int64) << 20 | np.take_along_axis(axes[1], best % k, 1)
        out.append(key | t << 40 | dim << 44)
    return np.concatenate(out, 1)


def sketches(x: np.ndarray) -> np.ndarray:
    """128 signs of each row, as two integers."""
    x, bits = _padded(x), []
    k = 2 * TABLES
    while sum(b.shape[1] for b in bits) < 128:
        bits.append(_turned(x, k) >= 0)
        k += 1
    packed = np.packbits(np.concatenate(bits, 1)[:, :128], axis=1)
    return np.ascontiguousarray(packed).view("<i8")


def _classes(x: np.ndarray) -> np.ndarray:
    """A hash of each row's components."""
    return np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in map(bytes, np.ascontiguousarray(x + 0.0))], np.int64)


def _valid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors of the rows that have a direction, by dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values if column.offset == 0 else column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    starts = np.asarray(column.offsets)[:-1] if column.offset == 0 else np.concatenate(([0], np.maximum(sizes, 0).cumsum()[:-1]))
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            yield at[good], x[good]


def _ids(x: np.ndarray) -> np.ndarray:
    """Class of each row in 24 bytes: hash and sketch."""
    return np.concatenate((_classes(x)[:, None], sketches(x)), 1)


def _binary(ids: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(ids)], pa.binary())


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [None] * b.num_rows
        for at, x in _valid(b.column(1)):
            for i, r in zip(at, _ids(x)):
                out[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "id"])


class _Once:
    """Leaves out classes that this task has had among its last ones."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        new = []
        for i, r in enumerate(np.ascontiguousarray(ids)):
            if (k := r.tobytes()) not in self.seen:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen.add(k)
                new.append(i)
        return np.array(new, int)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and bucket: the bucket, the class, and the first choices of the first four tables."""
    once = _Once()
    for b in batches:
        for _, x in _valid(b.column(0)):
            ids = _ids(x)
            new = once(ids)
            keys = buckets(x[new])
            ids = np.repeat(ids[new], keys.shape[1], 0)
            first = np.zeros(len(new), np.int64)
            for t in range(4):
                axes = keys[:, t * PROBES]
                first |= ((axes >> 20 & 0x7F) << 7 | axes & 0x7F) << (14 * t) if x.shape[1] <= 64 else 0
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys.ravel(), ids[:, 0], ids[:, 1], ids[:, 2], np.repeat(first, keys.shape[1]))], ["key", "h", "s1", "s2", "first"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray | pa.Array]]]:
    """Runs of equal first columns: the key, and the other columns of its rows."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.RecordBatch, last: bool) -> Iterator:
        keys = [np.asarray(table.column(i)) for i in range(n_keys)]
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        ends = [*np.flatnonzero(new), *([table.num_rows] if last else [])]
        start = 0
        for e in ends:
            yield tuple(k[start] for k in keys), table.slice(start, e - start)
            start = e
        held[:] = [] if last or start == table.num_rows else [table.slice(start)]

    for b in batches:
        if not b.num_rows:
            continue
        # A group that goes on is only added to; it is put together when its end has been seen.
        if held and all(b.column(i)[b.num_rows - 1] == held[0].column(i)[0] for i in range(n_keys)) and all(b.column(i)[0] == held[0].column(i)[0] for i in range(n_keys)):
            held.append(b)
            continue
        yield from cut(pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held else b, False)
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)


def _sides(h: np.ndarray, cell: int) -> np.ndarray | None:
    """In a pair of different parts, which rows are of the first; None where all are compared with all."""
    parts, i, j = cell >> 40, cell >> 20 & 0xFFFFF, cell & 0xFFFFF
    return None if i == j else h % parts == i


def _pairs(n: int, sides: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows against rows in blocks, each pair once."""
    left, right = (np.arange(n), np.arange(n)) if sides is None else (np.flatnonzero(sides), np.flatnonzero(~sides))
    for a in range(0, len(left), _BLOCK):
        for b in range(a if sides is None else 0, len(right), _BLOCK):
            yield left[a : a + _BLOCK], right[b : b + _BLOCK]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of entries in order of bucket -> bucket and class where the class has a partner by its sketch whose home may be here."""
    out_keys, out_cells, out_ids = [], [], []
    for (key, cell), g in _groups(batches, 2):
        if g.num_rows < 2:
            continue
        rows = np.stack([np.asarray(g.column(i)) for i in (2, 3, 4, 5)], 1)
        table, narrow = int(key) >> 40 & 15, int(key) >> 44 <= 64
        own = ((key >> 20 & 0x7F) << 7) | (key & 0x7F)
        near, signs = np.zeros(len(rows), bool), np.ascontiguousarray(rows[:, 1:3]).view(np.uint64)
        for a, b in _pairs(len(rows), _sides(rows[:, 0], int(cell))):
            bits = sum(np.bitwise_count(signs[a, k][:, None] ^ signs[b, k]).astype(np.int16) for k in (0, 1))
            i, j = np.nonzero(bits <= SKETCH_BITS)
            same = bits[i, j] == 0
            i, j = a[i], b[j]
            # A class may be here several times, once from each task that read it.
            ok = ~(same & (rows[i, 0] == rows[j, 0]))
            if narrow:
                both = rows[i, 3] ^ rows[j, 3]
                for t in range(min(table, 4)):
                    ok &= (both >> (14 * t) & 0x3FFF) != 0
                if table < 4:
                    ok &= ((both >> (14 * table) & 0x3FFF) != 0) | ((rows[i, 3] >> (14 * table) & 0x3FFF) == own)
            near[i[ok]] = near[j[ok]] = True
        found = rows[near, :3]
        if len(found):
            out_keys.append(np.full(len(found), key))
            out_cells.append(np.full(len(found), cell))
            out_ids.append(found)
        if sum(map(len, out_keys)) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out_cells)), _binary(np.concatenate(out_ids))], ["key", "cell", "id"])
            out_keys, out_cells, out_ids = [], [], []
    if out_keys:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out_cells)), _binary(np.concatenate(out_ids))], ["key", "cell", "id"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for b in batches:
        for at, x in _valid(b.column(0)):
            ids = _ids(x)
            new = once(ids)
            yield pa.RecordBatch.from_arrays([_binary(ids[new]), b.column(0).take(pa.array(at[new]))], ["id", "embedding"])


def _with_buckets(b: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the buckets of each row's vector, found for all rows of a batch together."""
    out: list = [None] * b.num_rows
    for at, x in _valid(b.column(4)):
        for i, k in zip(at, buckets(x)):
            out[i] = k.tobytes()
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "buckets"])


def _homes(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The one bucket in which each pair counts."""
    home = np.full(len(i), -1, np.int64)
    for t in reversed(range(TABLES)):
        a, b = keys[i, t * PROBES : (t + 1) * PROBES], keys[j, t * PROBES : (t + 1) * PROBES]
        common = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
        common = np.where(a[:, 0] == b[:, 0], a[:, 0], common)
        home = np.where(common < np.iinfo(np.int64).max, common, home)
    return home


def _join(to: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """``to`` names the least row that each hangs together with; the links p - q are added to that."""
    while True:
        a, b = to[p], to[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to[:] = to[to]


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of vectors in order of bucket -> class, links that it has here, least class that it hangs together with here."""
        for (key, cell), g in _groups(map(_with_buckets, batches), 2):
            ids = g.column(2).to_pylist()
            keep = sorted({r: i for i, r in enumerate(ids)}.values())
            if len(keep) < 2:
                continue
            g, ids = g.take(pa.array(keep)), [ids[i] for i in keep]
            x = next(_valid(g.column(4)))[1]
            keys = np.frombuffer(b"".join(g.column(5).to_pylist()), np.int64).reshape(len(x), -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            n = np.asarray(g.column(3))
            links, to = np.zeros(len(ids), np.int64), np.arange(len(ids))
            sides = _sides(np.array([int.from_bytes(r[:8], "little", signed=True) for r in ids]), int(cell))

            for a, b in _pairs(len(ids), sides):
                i, j = np.nonzero(x[a] @ x[b].T >= least)
                i, j = a[i], b[j]
                ok = i < j if sides is None else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                for s in range(0, len(i), 1 << 18):
                    p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
                    here = _homes(keys, p, q) == key
                    p, q = p[here], q[here]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    _join(to, p, q)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([ids[to[k]] for k in some], pa.binary())], ["id", "links", "to"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (others with a cosine of ``least`` or more), component_id (least id reachable by links), kept (the id is that least id).

    Rows whose vector is null, empty, zero, or holds nulls or non-finite
    numbers link with nothing and are components of their own; so do vectors of
    different dimensions with each other.  Equal vectors link; repeated rows
    are rows of their own, equal ids have the same component only if their
    vectors hang together.  A component of null ids only has a null id.
    ``least`` under 0.95 would need more tables.
    """
    if least < 0.95:
        raise ValueError("the number of tables is made for cosines of 0.95 or more")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    number = rows.schema["embedding"].dataType.simpleString()
    named = rows.mapInArrow(_named, "vec_id bigint, id binary")
    classes = stored(named.where("id IS NOT NULL").groupBy("id").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "classes")

    entries = rows.select("embedding").mapInArrow(_entries, "key bigint, h bigint, s1 bigint, s2 bigint, first bigint")
    large = stored(entries.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key", F.ceil(F.col("count") / BUCKET_ROWS).alias("parts")), "large-buckets")
    cell = F.lit(0).cast("long")
    if not large.isEmpty():
        # A row of a large bucket goes to every pair of parts that holds its own.
        entries = entries.join(large, "key", "left")
        own = F.expr("pmod(h, parts)")
        other = F.expr("sequence(0L, parts - 1)")
        cells = F.transform(other, lambda o: F.shiftleft(F.col("parts"), 40) + F.shiftleft(F.least(own, o), 20) + F.greatest(own, o))
        entries = entries.withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(cell)).otherwise(cells)))
    else:
        entries = entries.withColumn("cell", cell)
    dealt = entries.select("key", "cell", "h", "s1", "s2", "first").repartition("key", "cell").sortWithinPartitions("key", "cell")
    active = stored(dealt.mapInArrow(_searched, "key bigint, cell bigint, id binary"), "active")

    wanted = active.groupBy("id").agg(F.collect_list(F.struct("key", "cell")).alias("at")).join(classes.select("id", "n"), "id")
    sent = rows.select("embedding").mapInArrow(_vectors, f"id binary, embedding {number}").join(wanted, "id").select(F.explode("at").alias("at"), "id", "n", "embedding")
    sent = sent.select("at.key", "at.cell", "id", "n", "embedding").repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = stored(sent.mapInArrow(_compared(least), "id binary, links bigint, to binary"), "links-found")

    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(links.select("id", "to"), "id", "to")
    member = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    roots = member.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    member = member.join(roots, "root", "left").select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    out = named.where("id IS NOT NULL").join(member, "id").select("vec_id", "n_links", "component_id")
    alone = named.where("id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
