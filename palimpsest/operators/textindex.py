"""A stored full-text index: segments of compressed postings, searched best first.

A segment holds documents dealt to parts by a hash of their id.  A part has,
for each lexeme, a head (ids, numbers of occurrences, sums of weights) and
blocks of positions, ``BLOCK_DOCS`` documents each.  A document's score by
cover density has a bound that the heads give: every minimal cover holds an
occurrence of each lexeme, no occurrence is in more covers than there are
lexemes, and no cover counts more than one.  A search scores the documents
with the greatest bounds first; the score that is then last among the best
lets all others go whose bound is less, and their blocks are never read.

An update writes one more segment, of the touched documents alone, and the ids
that are dead in older ones; segments of like size are merged from their own
postings.  What counts is the manifest with the greatest number, one row
appended at the end, so a failed update leaves the old state.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import fulltext
from palimpsest.sources.scratch import stored

#: Documents of a part and of a block of positions, queries that a group answers at most, and those that are worth a group.
PART_DOCS, BLOCK_DOCS, QUERIES, LEAST = 32_768, 64, 8_192, 256
#: Documents of a part that are scored first, for each one wanted.
FIRST = 2
#: Segments of like size that are merged, and the ratio of sizes that are alike.
MERGED = 4
#: Fewest bytes that are worth compressing, and dead documents that are told to the tasks.
PRESSED, TOLD = 96, 1_000_000

_HEAD = "lexeme string, part int, block int, n int, ids binary, tfs binary, sums binary, data binary"
_HEAD_ARROW = pa.schema([("lexeme", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("tfs", pa.binary()), ("sums", pa.binary()), ("data", pa.binary())])
_CANDIDATES = "segment long, part int, load int, query_id long, alternative int, ids binary, sums binary, lexeme string, block int"
_CANDIDATES_ARROW = pa.schema([("segment", pa.int64()), ("part", pa.int32()), ("load", pa.int32()), ("query_id", pa.int64()), ("alternative", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary()), ("lexeme", pa.string()), ("block", pa.int32())])


def _pressed(raw: bytes) -> bytes:
    """Bytes, compressed unless they are few."""
    return b"-" + raw if len(raw) < PRESSED else b"+" + zlib.compress(raw, 1)


def _whole(b: bytes) -> bytes:
    return b[1:] if b[:1] == b"-" else zlib.decompress(b[1:])


def pack(values: np.ndarray) -> bytes:
    """Numbers (not below zero, ascending or not) as bytes of the least width, compressed unless they are few."""
    most = int(values.max()) if len(values) else 0
    width = "B" if most < 1 << 8 else "H" if most < 1 << 16 else "I" if most < 1 << 32 else "Q"
    return width.encode() + _pressed(values.astype(width).tobytes())


def _pack_few(values: list[int]) -> bytes:
    """As :func:`pack`, of fewer than ``PRESSED`` numbers."""
    return b"B-" + bytes(values) if max(values, default=0) < 1 << 8 else pack(np.array(values, np.int64))


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(_whole(b[1:]), b[:1].decode()).astype(np.int64)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids by their steps; the first, which may be below zero, in front."""
    return int(ids[0]).to_bytes(8, "little", signed=True) + pack(np.diff(ids)) if len(ids) else b""


def _unpack_ids(b: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(unpack(b[8:])))) + int.from_bytes(b[:8], "little", signed=True) if b else np.zeros(0, np.int64)


def _write_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (lexeme, part, version_id, places as twice the position, plus one in a heading) in order -> heads and blocks."""
    held = None  # rows of the last group, which may go on
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        lexemes = t["lexeme"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        parts = t["part"].to_numpy()
        starts = np.flatnonzero((lexemes[1:] != lexemes[:-1]) | (parts[1:] != parts[:-1])) + 1
        if len(starts):
            yield _groups(t.slice(0, starts[-1]), np.append(0, starts))
            t = t.slice(starts[-1])
        held = t if t.num_rows else None
    if held is not None:
        yield _groups(held, np.array([0, held.num_rows]))


def _groups(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    """Heads and blocks of whole groups, which lie between ``bounds``."""
    t = t.combine_chunks()
    ids, lists = t["version_id"].to_numpy(), t["places"].combine_chunks()
    flat, tfs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(tfs))
    steps = np.diff(flat, prepend=0)
    steps[ends[:-1]] = flat[ends[:-1]]
    in_heading = np.diff(np.append(0, np.cumsum(flat & 1))[ends])
    sums = in_heading * fulltext.WEIGHTS["A"] + (tfs - in_heading) * fulltext.WEIGHTS["B"]
    at, rows = [], []
    few_ids, few_tfs, few_steps, few_ends, all_sums = ids.tolist(), tfs.tolist(), steps.tolist(), ends.tolist(), sums.tobytes()
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        # Most lexemes are rare: one block, with the ids and numbers of its head, from plain lists.
        if z - a <= BLOCK_DOCS and few_ends[z] - few_ends[a] < PRESSED:
            packed = few_ids[a].to_bytes(8, "little", signed=True) + _pack_few([y - x for x, y in zip(few_ids[a : z - 1], few_ids[a + 1 : z])])
            n_each = _pack_few(few_tfs[a:z])
            at += (a, a)
            rows.append((-1, z - a, packed, n_each, _pressed(all_sums[8 * a : 8 * z]), None))
            rows.append((0, z - a, packed, n_each, None, _pack_few(few_steps[few_ends[a] : few_ends[z]])))
            continue
        at.append(a)
        rows.append((-1, z - a, _pack_ids(ids[a:z]), pack(tfs[a:z]), _pressed(sums[a:z].tobytes()), None))
        for k in range(a, z, BLOCK_DOCS):
            e = min(k + BLOCK_DOCS, z)
            at.append(a)
            rows.append(((k - a) // BLOCK_DOCS, e - k, _pack_ids(ids[k:e]), pack(tfs[k:e]), None, pack(steps[ends[k] : ends[e]])))
    own = [t[c].combine_chunks().take(pa.array(at)) for c in ("lexeme", "part")]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_HEAD_ARROW)[2:]))], schema=_HEAD_ARROW)


def _rows(post: DataFrame, parts: int) -> DataFrame:
    """Heads and blocks of postings (``version_id``, ``lexeme``, ``places``): one shuffle, by lexeme and part, so a common lexeme is many groups; texts are tokenised once."""
    dealt = post.withColumn("part", F.expr(f"cast(pmod(xxhash64(version_id), {parts}) as int)")).select("lexeme", "part", "version_id", "places")
    return dealt.repartition("lexeme", "part").sortWithinPartitions("lexeme", "part", "version_id").mapInArrow(_write_groups, _HEAD)


class Index:
    """A stored index: ``path/segments/<number>`` with its rows and documents, ``path/dead``, ``path/manifests``."""

    def __init__(self, spark: SparkSession, path: str, english: bool = True):
        self.spark, self.path, self.english = spark, path, english

    def state(self) -> list[dict]:
        """Segments of the newest manifest: number, documents, parts; one row is read."""
        try:
            top = self.spark.read.parquet(f"{self.path}/manifests").orderBy(F.desc("version")).first()
        except Exception as e:  # noqa: BLE001 - no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            top = None
        self.version = top["version"] if top else 0
        return [s.asDict() for s in top["segments"]] if top else []

    def _commit(self, segments: list[dict]) -> None:
        rows = [(self.version + 1, [(s["segment"], s["docs"], s["parts"]) for s in segments])]
        self.spark.createDataFrame(rows, "version long, segments array<struct<segment: long, docs: long, parts: int>>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")

    def _write(self, segment: int, post: DataFrame, ids: DataFrame) -> dict:
        """One segment; ``ids`` are all its documents, those without a lexeme too."""
        at = f"{self.path}/segments/{segment}"
        ids.select("version_id").write.mode("overwrite").parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs").count()
        parts = max(1, -(-docs // PART_DOCS))
        _rows(post, parts).write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{at}/rows")
        return {"segment": segment, "docs": docs, "parts": parts}

    def _tokens(self, docs: DataFrame) -> DataFrame:
        place = F.transform("at", lambda x: 2 * x["pos"] + (x["weight"] == "A").cast("int"))
        return fulltext.postings(docs, "version_id", english=self.english).select("version_id", "lexeme", place.alias("places"))

    def build(self, docs: DataFrame) -> None:
        """The index of ``docs`` (``version_id``, ``heading``, ``body``) alone, whatever was there."""
        self.state()
        self._commit([self._write(self.version + 1, self._tokens(docs), docs)])

    def dead(self, segments: list[dict]) -> DataFrame | None:
        """``segment``, ``version_id`` of the documents of live segments that don't count any more."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/dead")
        except Exception as e:  # noqa: BLE001 - nothing has died yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        # Rows of an update that never came to its manifest have a number that no manifest allows.
        return rows.where(F.col("version") <= self.version).join(F.broadcast(self.spark.createDataFrame([(s["segment"],) for s in segments], "segment long")), "segment", "left_semi").select("segment", "version_id").distinct()

    def documents(self) -> DataFrame:
        """``segment``, ``version_id`` of all that count."""
        segments = self.state()
        out = self.spark.createDataFrame([], "segment long, version_id long")
        for s in segments:
            out = out.unionByName(self.spark.read.parquet(f"{self.path}/segments/{s['segment']}/docs").select(F.lit(s["segment"]).cast("long").alias("segment"), "version_id"))
        gone = self.dead(segments) if segments else None
        return out if gone is None else out.join(gone, ["segment", "version_id"], "left_anti")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """``changed`` (``version_id``, ``heading``, ``body``) are added or take the place of what has their id; ``removed`` (``version_id``) go.

        Only ``changed`` are tokenised.  Then segments of like size are merged.
        """
        segments = self.state()
        number = self.version + 1
        ids = changed.select("version_id")
        touched = ids if removed is None else ids.unionByName(removed.select("version_id"))
        gone = self.documents().join(touched.distinct(), "version_id", "left_semi").select("segment", "version_id").withColumn("version", F.lit(number).cast("long"))
        gone.write.mode("append").parquet(f"{self.path}/dead")
        self._commit([*segments, self._write(number, self._tokens(changed), changed)])
        self.merge()

    def postings(self, segments: list[dict]) -> DataFrame:
        """``version_id``, ``lexeme``, ``places`` of what counts in these segments, read back from their blocks."""
        out, gone = None, self.dead(segments)
        few = gone is not None and gone.limit(TOLD + 1).count() <= TOLD
        for s in segments:
            rows = self.spark.read.schema(_HEAD).parquet(f"{self.path}/segments/{s['segment']}/rows")
            one = rows.where("block >= 0").select("lexeme", "ids", "tfs", "data").mapInArrow(_read_blocks, "version_id long, lexeme string, places array<int>")
            if gone is not None:
                own = gone.where(F.col("segment") == s["segment"]).select("version_id")
                one = one.join(F.broadcast(own) if few else own, "version_id", "left_anti")
            out = one if out is None else out.unionByName(one)
        return out

    def merge(self) -> None:
        """Merge ``MERGED`` segments of like size, the smallest first, until no such are left; their rows are not tokenised again."""
        while True:
            segments = self.state()
            tiers: dict[int, list[dict]] = {}
            for s in segments:
                tiers.setdefault(max(0, s["docs"]).bit_length() // 2, []).append(s)
            some = next((t for _, t in sorted(tiers.items()) if len(t) >= MERGED), None)
            if not some:
                return
            numbers = {s["segment"] for s in some}
            live = self.documents().where(F.col("segment").isin(*numbers)).select("version_id")
            made = self._write(self.version + 1, self.postings(some), live)
            self._commit([*(s for s in segments if s["segment"] not in numbers), made])

    def search(self, queries: DataFrame, limit: int = 50) -> DataFrame:
        """``query_id``, ``version_id``, ``score``, ``rank``: the same as :func:`fulltext.search` over all that counts.

        Queries that ask for the same are answered once.
        """
        segments = self.state()
        none = self.spark.createDataFrame([], "query_id long, version_id long, score double, rank int")
        if not segments:
            return none
        asks = self._questions(queries)
        terms = asks.where("query_id = first").select("query_id", "plan", F.lit(limit).alias("most"))
        rows = None
        for s in segments:
            one = self.spark.read.schema(_HEAD).parquet(f"{self.path}/segments/{s['segment']}/rows").withColumn("segment", F.lit(s["segment"]).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        asked = [r["lexeme"] for r in terms.select(F.explode("plan.lexeme").alias("lexeme")).distinct().limit(fulltext.PUSHED + 1).collect()]
        if len(asked) <= fulltext.PUSHED:
            rows = rows.where(F.col("lexeme").isin(*asked)) if asked else rows.where("false")
        gone = self.dead(segments)
        first = stored(self._candidates(rows, gone, terms, segments, limit, None), "text-candidates")
        scored = stored(self._scored(rows, first, terms), "text-scores")
        last = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "version_id"))).where(F.col("r") == limit).select("query_id", F.col("score").alias("least"))
        others = stored(self._candidates(rows, gone, terms, segments, limit, last), "text-candidates")
        both = scored.unionByName(self._scored(rows, others, terms)).repartition("query_id").groupBy("query_id", "version_id").agg(F.max("score").alias("score"))
        best = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "version_id"))).where(F.col("rank") <= limit)
        return best.withColumnRenamed("query_id", "first").join(asks.select("query_id", "first"), "first").select("query_id", "version_id", "score", "rank")

    def _questions(self, queries: DataFrame) -> DataFrame:
        """``query_id``, ``plan`` (what it asks for), ``first``: the least id of the queries that ask for the same."""
        row = F.struct("alternative", "wanted", "clause", "lexeme", "distance")
        made = stored(fulltext.query_terms(queries, self.english).groupBy("query_id").agg(F.array_sort(F.collect_set(row)).alias("plan")), "questions")
        return made.join(made.groupBy("plan").agg(F.min("query_id").alias("first")), "plan").select("query_id", "plan", "first")

    def _candidates(self, rows: DataFrame, gone: DataFrame | None, terms: DataFrame, segments: list[dict], limit: int, last: DataFrame | None) -> DataFrame:
        """Documents to be scored, a row for each query and part, and a row for each block of positions that this takes: the best by bound of each part, or with ``last`` (``query_id``, ``least``) those behind them whose bound reaches it."""
        n, parts = terms.count(), sum(s["parts"] for s in segments)
        # A block moves once for each load that asks for it, so there are no more loads than keep all cores busy, whatever the queries.
        loads = _loads(n, parts, self.spark.sparkContext.defaultParallelism)
        terms = terms.withColumn("load", F.expr(f"cast(pmod(xxhash64(query_id), {loads}) as int)"))
        heads = rows.where("block = -1").select("segment", "part", "lexeme", "ids", "tfs", "sums").join(terms.select(F.explode("plan.lexeme").alias("lexeme"), "load").distinct(), "lexeme")
        places = self.spark.createDataFrame([(s["segment"], p) for s in segments for p in range(s["parts"])], "segment long, part int")
        if gone is not None:
            sizes = F.broadcast(self.spark.createDataFrame([(s["segment"], s["parts"]) for s in segments], "segment long, parts int"))
            dead = gone.join(sizes, "segment").select("segment", F.expr("cast(pmod(xxhash64(version_id), parts) as int)").alias("part"), "version_id")
            # The dead of a part come to each of its groups as one more head.
            dead = dead.groupBy("segment", "part").agg(F.sort_array(F.collect_list("version_id")).alias("dead")).crossJoin(F.broadcast(terms.select("load").distinct()))
            heads = heads.withColumn("dead", F.lit(None).cast("array<bigint>")).unionByName(dead, allowMissingColumns=True)
        else:
            heads = heads.withColumn("dead", F.lit(None).cast("array<bigint>"))
        # A query with fewer scores than it wants may have a match of any score.
        terms = terms.withColumn("least", F.lit(0.0)) if last is None else terms.join(last, "query_id", "left").fillna(0.0, ["least"])
        told = terms.select("load", "query_id", "plan", "least").crossJoin(F.broadcast(places))
        group = ["segment", "part", "load"]
        heads = heads.select(*group, "lexeme", "ids", "tfs", "sums", "dead")
        # Both sides come from the same terms; renamed, their columns are told apart.
        heads, told = heads.toDF(*heads.columns), told.toDF(*told.columns)
        return heads.groupBy(*group).cogroup(told.groupBy(*group)).applyInArrow(_chosen(limit, last is not None), _CANDIDATES)

    def _scored(self, rows: DataFrame, chosen: DataFrame, terms: DataFrame) -> DataFrame:
        """Scores of the candidates that match, the best ``most`` of each query in each part; a block moves once for each group of queries that asks for it."""
        key, group = ["segment", "part", "lexeme", "block"], ["segment", "part", "load"]
        blocks = rows.where("block >= 0").join(chosen.where("query_id is null").select(*key, "load"), key).select(*group, "lexeme", "block", "ids", "tfs", "data")
        found = chosen.where("query_id is not null").select(*group, "query_id", "alternative", "ids", "sums").join(terms, "query_id")
        blocks, found = blocks.toDF(*blocks.columns), found.toDF(*found.columns)
        return found.groupBy(*group).cogroup(blocks.groupBy(*group)).applyInArrow(_measured, "query_id long, version_id long, score double")


def _loads(n: int, parts: int, cores: int) -> int:
    """Groups of ``n`` queries in each part: of at most ``QUERIES``, and so many that all parts together have two groups a core, unless they are of fewer than ``LEAST``."""
    return max(1, -(-n // QUERIES), min(-(-n // LEAST), -(-2 * cores // parts)))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids, tfs, steps = ([read(x) for x in b.column(c).to_pylist()] for c, read in ((1, _unpack_ids), (2, unpack), (3, unpack)))
        lexeme = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in ids])))
        ids, tfs, steps = map(np.concatenate, (ids, tfs, steps))
        ends = np.append(0, np.cumsum(tfs))
        run = np.cumsum(steps)
        places = (run - np.repeat((run - steps)[ends[:-1]], tfs)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), lexeme, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places))], ["version_id", "lexeme", "places"])


def _alternatives(plan: list[dict]) -> dict[int, list[tuple[bool, list[tuple[str, int]]]]]:
    """Of each alternative of a query its clauses: wanted, lexemes with their distance from the first."""
    out: dict[int, dict[int, tuple]] = {}
    for t in plan:
        out.setdefault(t["alternative"], {}).setdefault(t["clause"], (t["wanted"], []))[1].append((t["lexeme"], t["distance"]))
    return {a: list(c.values()) for a, c in out.items()}


def _chosen(limit: int, rest: bool):
    def run(heads: pa.Table, told: pa.Table) -> pa.Table:
        if not heads.num_rows or not told.num_rows:
            return _CANDIDATES_ARROW.empty_table()
        group = [heads[c][0].as_py() for c in ("segment", "part", "load")]
        packed, known, dead = {}, {}, np.zeros(0, np.int64)
        for i, lexeme in enumerate(heads["lexeme"].to_pylist()):
            if lexeme is None:
                dead = np.array(heads["dead"][i].as_py())
            else:
                packed[lexeme] = i

        def head(x: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if x not in known:
                ids, tfs, sums = (heads[c][packed[x]].as_py() for c in ("ids", "tfs", "sums"))
                known[x] = (_unpack_ids(ids), unpack(tfs).astype(np.int32), np.frombuffer(_whole(sums)))
            return known[x]

        out, blocks = [], {}
        for query, plan, least in zip(*(told[c].to_pylist() for c in ("query_id", "plan", "least"))):
            for alternative, clauses in _alternatives(plan).items():
                wanted = {x for w, c in clauses if w for x, _ in c}
                exact = len(wanted) == 1 and all(len(c) == 1 for _, c in clauses)
                if not wanted <= packed.keys() or (exact and rest):
                    continue
                lists = sorted((head(x) for x in wanted), key=lambda k: len(k[0]))
                ids = lists[0][0]
                for other, _, _ in lists[1:]:
                    ids = ids[np.isin(ids, other, assume_unique=True)]
                for w, c in clauses:
                    # A single word that must not occur; phrases are looked at with their positions.
                    if not w and len(c) == 1 and c[0][0] in packed:
                        ids = ids[~np.isin(ids, head(c[0][0])[0], assume_unique=True)]
                if len(dead):
                    ids = ids[~np.isin(ids, dead)]
                if not len(ids):
                    continue
                at = [np.searchsorted(k[0], ids) for k in lists]
                # One word: the sum of its weights is the score.
                bound = lists[0][2][at[0]].round(fulltext.DIGITS) if exact else len(wanted) * np.minimum.reduce([k[1][i] for k, i in zip(lists, at)]).astype(float)
                n = limit if exact else limit * FIRST
                if len(ids) > n or exact:
                    order = np.lexsort((ids, -bound))
                    order = order[n:] if rest else order[:n]
                    ids, bound = ids[order], bound[order]
                elif rest:
                    continue
                if rest:
                    ids = ids[bound >= least - 10.0**-fulltext.DIGITS]
                    if not len(ids):
                        continue
                if exact:
                    out.append((*group, query, alternative, ids.tobytes(), bound.tobytes(), None, None))
                    continue
                ids = np.sort(ids)
                out.append((*group, query, alternative, _pack_ids(ids), None, None, None))
                for x in wanted | {x for _, c in clauses if len(c) > 1 for x, _ in c if x in packed}:
                    own = head(x)[0]
                    slot = np.minimum(np.searchsorted(own, ids), len(own) - 1)
                    blocks.setdefault(x, set()).update((np.unique(slot[own[slot] == ids] // BLOCK_DOCS)).tolist())
        out += [(*group, None, None, None, None, x, b) for x, own in blocks.items() for b in own]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _CANDIDATES_ARROW)], schema=_CANDIDATES_ARROW) if out else _CANDIDATES_ARROW.empty_table()

    return run


def _measured(found: pa.Table, blocks: pa.Table) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("version_id", pa.int64()), ("score", pa.float64())])
    parts: dict[str, list] = {}
    for i, (lexeme, block) in enumerate(zip(blocks["lexeme"].to_pylist(), blocks["block"].to_pylist())):
        parts.setdefault(lexeme, []).append((block, i))
    known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def read(x: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ends and places of a lexeme in the blocks that are there."""
        if x not in known:
            rows = [[blocks[c][i].as_py() for c in ("ids", "tfs", "data")] for _, i in sorted(parts.get(x, ()))]
            ids, tfs, steps = ([f(r[c]) for r in rows] for c, f in enumerate((_unpack_ids, unpack, unpack)))
            ids, tfs, steps = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (ids, tfs, steps))
            ends, run = np.append(0, np.cumsum(tfs)), np.cumsum(steps)
            known[x] = (ids, ends, (run - np.repeat((run - steps)[ends[:-1]], tfs)).astype(np.int32))
        return known[x]

    out = []
    for query, alternative, ids, sums, plan, most in zip(*(found[c].to_pylist() for c in ("query_id", "alternative", "ids", "sums", "plan", "most"))):
        if sums is not None:
            ids, score = np.frombuffer(ids, np.int64), np.frombuffer(sums)
        else:
            ids, score = _densities(_unpack_ids(ids), _alternatives(plan)[alternative], read)
        order = np.lexsort((ids, -score))[:most]
        out.append((np.full(len(order), query), ids[order], score[order]))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema) if out else schema.empty_table()


def _hits(own: np.ndarray, ends: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ids`` and in their texts of all occurrences of a lexeme."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
    doc = np.flatnonzero(own[at] == ids)
    at = at[doc]
    n = ends[at + 1] - ends[at]
    return np.repeat(doc, n), places[np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)


def _densities(ids: np.ndarray, clauses: list[tuple[bool, list[tuple[str, int]]]], read) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``ids`` that match, with their :func:`fulltext.cover_density`, all documents at once."""
    wanted = sorted({x for w, c in clauses if w for x, _ in c})
    phrases = [(w, c) for w, c in clauses if len(c) > 1]
    hits = {x: _hits(*read(x), ids) for x in {*wanted, *(x for _, c in phrases for x, _ in c)}}
    good = np.ones(len(ids), bool)
    for w, c in phrases:
        starts = [doc << 33 | (place // 2 - distance + (1 << 32)) for (doc, place), distance in ((hits[x], d) for x, d in c)]
        holds = np.zeros(len(ids), bool)
        holds[functools.reduce(np.intersect1d, starts) >> 33] = True
        good &= holds == w
    doc, place = (np.concatenate([hits[x][k] for x in wanted]) for k in (0, 1))
    kind = np.repeat(np.arange(len(wanted)), [len(hits[x][0]) for x in wanted])
    order = np.argsort(doc << 33 | place, kind="stable")
    doc, place, kind = doc[order], place[order], kind[order]
    at = np.arange(len(doc))
    # A minimal cover ends where the least of the last places of all lexemes moves on, and begins there.
    left = np.minimum.reduce([np.maximum.accumulate(np.where(kind == k, at, -1)) for k in range(len(wanted))])
    right = np.flatnonzero((left >= np.searchsorted(doc, doc)) & (left > np.append(-1, left[:-1])))
    left = left[right]
    weight = np.append(0, np.cumsum(np.where(place & 1, 1 / fulltext.WEIGHTS["A"], 1 / fulltext.WEIGHTS["B"])))
    n, pos = right - left + 1, place // 2
    cover = n / (weight[right + 1] - weight[left]) / (1 + np.maximum(0, pos[right] - pos[left] - (n - 1)))
    total = np.bincount(doc[right], cover, len(ids))[good]
    return ids[good], np.array([round(x, fulltext.DIGITS) for x in total.tolist()], np.float64)


def changed_documents(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an index of ``before`` needs to be one of ``after`` (both ``version_id``, ``heading``, ``body``): the documents to put in, and ids to take out.

    A heading belongs to a node, so a changed one touches all versions of the
    node.  Texts are compared by hashes; only the changed ones move whole.
    """
    mark = lambda d, name: d.select("version_id", F.sha2(F.concat_ws("\x00", F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit(""))), 256).alias(name))
    both = mark(before, "old").join(mark(after, "new"), "version_id", "full_outer")
    changed = both.where("new is not null and (old is null or old <> new)").select("version_id")
    return after.join(changed, "version_id", "left_semi"), both.where("new is null").select("version_id")
