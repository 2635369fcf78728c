"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks at
places that depend on the ids near them only, so equal passages give equal
chunks wherever they stand.  A chunk is stored once under its digest; a
document is a recipe, the list of its chunks' digests, and a Merkle root over
them.  Recipes lie in ascending order of id with the number of ids before them;
a manifest has a Merkle root over the recipes of each run of documents.

Layout of a store, all Parquet:

* ``parts/kind=chunk``: ``digest`` (16 bytes), ``ids`` (little-endian unsigned
  integers of ``width`` bytes), ``n``, ``width``
* ``recipes``: ``bucket``, ``run`` (of at most ``RUN`` documents of a bucket),
  ``doc_id``, ``copy`` (0, 1, ... for repeated ids), ``start``, ``n_tokens``,
  ``digests``, ``root``, sorted by id
* ``manifest``: ``bucket``, ``run``, ``n_docs``, ``n_tokens``, ``root``

Ids cross the network once, on their way to the chunk files, after each task
has dropped the chunks it has seen already.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents_of, long_array, order_bounds, order_bucket
from .tokens import ENCODED_BYTES, library_encoder, slices

#: Documents under one root of the manifest.
RUN = 1024
#: Ids in the rolling window, mean (a power of two) and greatest ids of a chunk.
WINDOW, MEAN, MOST = 16, 256, 2048
_FACTOR = 0x9E3779B97F4A7C15


def stream_cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document, the ends of its chunks; ``bounds`` cut ``ids`` into documents.

    The rolling hash of a place is a polynomial of the ids of the window before
    it; a chunk ends where its top bits leave no rest, if the window lies in the
    document, after ``MOST`` ids, and with the document.
    """
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
    rolled ^= rolled >> np.uint64(29)
    span, power = 1, 0xD6E8FEB86659FD93
    while span < WINDOW and len(rolled) > span:  # windows of 2, 4, 8, 16
        rolled = rolled[:-span] * np.uint64(power) + rolled[span:]
        span, power = 2 * span, power * power % (1 << 64)
    ends = np.flatnonzero((rolled >> np.uint64(32)) & np.uint64(MEAN - 1) == 0) + WINDOW if span == WINDOW else np.zeros(0, np.int64)
    first, last = np.searchsorted(ends, bounds[:-1] + WINDOW, "left"), np.searchsorted(ends, bounds[1:], "left")
    out = []
    for a, b, start, stop in zip(first.tolist(), last.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        own, at = [], start
        for e in [*ends[a:b].tolist(), stop]:
            while e - at > MOST:
                at += MOST
                own.append(at)
            if e > at:
                own.append(e)
                at = e
        out.append(own)
    return out


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one id stream (the last is its length)."""
    return np.array(stream_cuts(ids, np.array([0, len(ids)]))[0])


def digest_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node rises unchanged."""
    level = [digest_of(b"\0" + x) for x in leaves] or [digest_of(b"")]
    while len(level) > 1:
        level = [digest_of(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


PARTS = pa.schema([("kind", pa.string()), ("spread", pa.int64()), ("digest", pa.binary()), ("ids", pa.binary()), ("n", pa.int32()), ("width", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary())])
_PARTS_DDL = "kind string, spread long, digest binary, ids binary, n int, width int, doc_id long, n_tokens long, digests array<binary>, root binary"
#: Digests a task remembers to leave out its own repeats.
REMEMBERED = 200_000


def _rows(count: int, kind: str, **columns) -> pa.RecordBatch:
    """Rows of :data:`PARTS`, null where no column is given."""
    made = [pa.array([kind] * count, pa.string()), *(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in list(PARTS)[1:])]
    return pa.RecordBatch.from_arrays(made, schema=PARTS)


def chunks_and_recipes(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds: chunks to be stored and recipes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        width = np.dtype(encode.dtype).itemsize
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, most=ENCODED_BYTES):
                flat, bounds = encode(part.column(1).cast(pa.string()))
                ids = np.insert(flat, bounds[1:], end_id).astype(encode.dtype)
                bounds = bounds + np.arange(len(bounds))
                raw, starts, sizes = ids.tobytes(), bounds[:-1].tolist(), np.diff(bounds)
                chunks: list[tuple[bytes, bytes, int]] = []
                recipes, roots = [], []
                for at, ends in zip(starts, stream_cuts(ids, bounds)):
                    digests = []
                    for e in ends:
                        piece = raw[at * width : e * width]
                        digest = digest_of(piece)
                        digests.append(digest)
                        if digest not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(digest)
                            chunks.append((digest, piece, e - at))
                        at = e
                    recipes.append(digests)
                    roots.append(merkle(digests))
                if chunks:
                    digest, piece, n = zip(*chunks)
                    spread = np.frombuffer(b"".join(digest), "<i8")[::2]
                    yield _rows(len(n), kind="chunk", spread=spread, digest=digest, ids=piece, n=n, width=[width] * len(n))
                spread = part.column(0).fill_null(0).to_numpy() * 31 + np.arange(len(roots))
                yield _rows(len(roots), kind="recipe", spread=spread, doc_id=part.column(0), n_tokens=sizes, digests=recipes, root=roots)

    return docs.mapInArrow(run, _PARTS_DDL)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents, each with ``end_id`` after it, and write the store.

    Null or empty text is the end id alone.  Repeated or null ids are documents
    of their own (nulls first, equal ids by root, then numbered by ``copy``).
    An empty table writes an empty store.
    """
    spark = docs.sparkSession
    parts = chunks_and_recipes(documents_of(docs, id_col, text_col), tokenizer, end_id)
    # Equal digests have equal spreads, so the window needs no further shuffle; its order by kind serves the writer too.
    nth = F.row_number().over(W.partitionBy("kind", "spread", "digest").orderBy("n"))
    unique = parts.repartition("spread").withColumn("nth", nth).where("kind = 'recipe' or nth = 1")
    unique.drop("spread", "nth").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    draft = _read_parts(spark, path).where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "root")
    bounds = order_bounds(draft.select("doc_id"))
    draft = draft.withColumn("bucket", order_bucket(F.col("doc_id"), bounds))
    # The ids before each run of documents: one row for each of a bounded number of buckets.
    totals = {r["bucket"]: r["n"] for r in draft.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = [], 0
    for b in range(len(bounds) + 1):
        before.append(total)
        total += totals.get(b, 0)
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    same = W.partitionBy("bucket", "doc_id").orderBy("root")
    recipes = draft.repartitionByRange("bucket").select(
        "bucket",
        F.floor((F.row_number().over(order) - 1) / RUN).cast("int").alias("run"),
        "doc_id",
        (F.row_number().over(same) - 1).cast("long").alias("copy"),
        (F.get(long_array(before), F.col("bucket")) + F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")).cast("long").alias("start"),
        "n_tokens",
        "digests",
        "root",
    )
    # The windows leave each task's rows in order of id, and tasks hold ranges of buckets.
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """Merkle root over the recipes of each run, in order of id."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [merkle([x["root"] for x in sorted(leaves, key=lambda x: x["start"])]) for leaves in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own, pa.binary())], names=["bucket", "run", "n_docs", "n_tokens", "root"])

    runs = recipes.groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("start", "root")).alias("leaves"))
    return runs.mapInArrow(roots, "bucket int, run int, n_docs long, n_tokens long, root binary")


def _read_parts(spark, path: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary, n int, width int, doc_id long, n_tokens long, digests array<binary>, root binary, kind string").parquet(f"{path}/parts")


def read_chunks(spark, path: str) -> DataFrame:
    """``digest``, ``ids`` (unsigned 32-bit), ``n`` and ``crc``; fails if bytes don't match their digest."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, crcs = [], []
            for digest, raw, width in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if digest_of(raw) != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                out.append(wide)
                crcs.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(3), pa.array(crcs, pa.int64())], names=["digest", "ids", "n", "crc"])

    return _read_parts(spark, path).where("kind = 'chunk'").select("digest", "ids", "width", "n").mapInArrow(check, "digest binary, ids binary, n int, crc long")


def read_recipes(spark, path: str) -> DataFrame:
    """The recipes of the store; fails if digests don't match the document's root, or a run's roots the manifest."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digests, root in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                if merkle(digests) != root:
                    raise ValueError("a recipe is damaged")
            yield b.select(range(5))

    damaged = verify_manifest(spark, path).first()
    if damaged:
        raise ValueError(f"recipes of run {damaged['run']} of bucket {damaged['bucket']} don't match the manifest")
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "copy", "start", "n_tokens", "digests", "root").mapInArrow(check, "doc_id long, copy long, start long, n_tokens long, digests array<binary>")


def _placed(spark, path: str, chunk_cols: list[str]) -> DataFrame:
    """For each document of the store, its chunks (in any order, with their place ``seq``), with what ``chunk_cols`` of them say.

    Every document has an id of its own at ``start``, so that stands for it.
    """
    refs = read_recipes(spark, path).select("start", "doc_id", "copy", "n_tokens", F.posexplode("digests").alias("seq", "digest"))
    chunks = read_chunks(spark, path).select("digest", *chunk_cols)
    first = [F.first(c).alias(c) for c in ("doc_id", "copy", "n_tokens")]
    return refs.join(chunks, "digest", "left").groupBy("start").agg(*first, F.collect_list(F.struct("seq", *chunk_cols)).alias("chunks"))


def read_back(spark, path: str) -> DataFrame:
    """``doc_id``, ``copy``, ``start``, ``n_tokens`` and ``ids`` (bytes of unsigned 32-bit integers) of every document.

    Each chunk is checked against its digest, each recipe against its root, and
    each root against the manifest.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = []
            for n_tokens, chunks in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if any(c["ids"] is None for c in chunks) or sum(len(c["ids"]) for c in chunks) != 4 * n_tokens:
                    raise ValueError("chunks of a document are missing")
                own.append(b"".join([c["ids"] for c in sorted(chunks, key=lambda c: c["seq"])]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own, pa.binary())], names=["doc_id", "copy", "start", "n_tokens", "ids"])

    return _placed(spark, path, ["ids"]).select("doc_id", "copy", "start", "n_tokens", "chunks").mapInArrow(join, "doc_id long, copy long, start long, n_tokens long, ids binary")


_tables: dict[int, array] = {}


def append_crc(crc: int, more: int, n_bytes: int) -> int:
    """crc32 of a followed by b, from crc32(a), crc32(b) and the length of b."""
    t = _tables.get(n_bytes)
    if t is None:
        if len(_tables) > 10_000:
            _tables.clear()
        # Linear over bits: where each value of each byte of the state goes after n zero bytes.
        zeros = bytes(n_bytes)
        none = zlib.crc32(zeros, 0)
        t = array("I", bytes(4096))
        for k in range(4):
            for bit in range(8):
                moved, low = zlib.crc32(zeros, 1 << 8 * k + bit) ^ none, 1 << bit
                for v in range(low):
                    t[256 * k + low + v] = t[256 * k + v] ^ moved
        _tables[n_bytes] = t
    return t[crc & 255] ^ t[256 + (crc >> 8 & 255)] ^ t[512 + (crc >> 16 & 255)] ^ t[768 + (crc >> 24)] ^ more


def read_digests(spark, path: str) -> DataFrame:
    """``doc_id``, ``copy``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, without moving its ids.

    Chunks are read, checked and summed where they lie; only their sums travel
    to the recipes, which join them in order.  All checks of :func:`read_back`
    are made.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = b.column(4)
            doc = pc.list_parent_indices(chunks).to_numpy(zero_copy_only=False)
            seq, n, crc = (c for c in chunks.flatten().flatten())
            if n.null_count:
                raise ValueError("chunks of a document are missing")
            order = pa.array(np.lexsort((seq.to_numpy(zero_copy_only=False), doc)))
            length = n.to_numpy(zero_copy_only=False)
            if (np.bincount(doc, length, b.num_rows) != b.column(3).to_numpy(zero_copy_only=False)).any():
                raise ValueError("chunks of a document have another length")
            sums = [0] * b.num_rows
            for d, k, c in zip(doc.tolist(), n.take(order).to_pylist(), crc.take(order).to_pylist()):
                sums[d] = append_crc(sums[d], c, 4 * k)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "copy", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path, ["n", "crc"]).select("doc_id", "copy", "start", "n_tokens", "chunks").mapInArrow(total, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(spark, path: str) -> DataFrame:
    """``bucket``, ``run`` of recipes that don't match the manifest (none, for a sound store)."""
    now = manifest_of(spark.read.parquet(f"{path}/recipes"))
    then = spark.read.parquet(f"{path}/manifest").select("bucket", "run", F.col("root").alias("written"))
    return now.join(then, ["bucket", "run"], "full_outer").where(~F.col("root").eqNullSafe(F.col("written"))).select("bucket", "run")
