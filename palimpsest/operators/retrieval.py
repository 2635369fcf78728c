"""Ranked retrieval: trigram, vector, rank fusion, and their hooks.

Each retriever takes a table of queries and returns ``query_id``,
``version_id``, ``score`` and ``rank``, at most ``limit`` rows for each query.
Source and visibility are filtered below the ranking, so that every retriever
ranks what may be shown and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import similarity, text
from palimpsest.operators import ann, fulltext, textindex
from palimpsest.operators.temporal import is_current
from palimpsest.sources.scratch import stored

#: Constant of reciprocal rank fusion.
FUSION = 60
#: Trigrams of a table of queries that are told to the tasks.
TOLD = 1_000
#: Queries that are joined with texts by rows of trigrams.
FEW = 64
#: Queries and texts of a block of trigram sets, trigrams of a block of queries, and cells of the table of both.
QUERY_SETS, TEXT_SETS, SET_CODES, SET_CELLS = 1_024, 4_096, 16_384, 1 << 25
#: Queries that go to the tasks at a time, and vectors that a task compares with them at a time.
QUERY_BLOCK, VECTOR_ROWS = 2_048, 4_096
#: Queries of a block that are scored at a time.
AT_ONCE = 256
#: More than a matrix product and a sum in fixed order can differ by for unit vectors.
SLACK = 1e-9


def searchable(nodes: DataFrame, versions: DataFrame, source: str | None = None, include_pending: bool = False) -> DataFrame:
    """Current versions with path, heading and source; an unknown source gives none."""
    n = nodes.select("node_id", "source", "path", "heading", "parent_path")
    n = n if source is None else n.where(F.col("source") == source)
    return versions.where(is_current(include_pending)).join(n, "node_id")


def _top(scored: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "version_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "version_id", "score", "rank")


def trigram_search(docs: DataFrame, queries: DataFrame, threshold: float = 0.1, limit: int = 50, col: str = "heading") -> DataFrame:
    """Trigram likeness of at least ``threshold`` with ``col``.

    Up to ``FEW`` queries and the texts meet through the trigrams they share,
    counted in one aggregation; the union follows from the sizes.  Up to
    ``TOLD`` trigrams of the queries are told to the tasks, which then send no
    others.  More queries are packed, and so are texts; blocks of both meet in
    tasks that keep the best of each query, so pairs are never rows.
    """
    if queries.limit(FEW + 1).count() > FEW:
        return _top(_trigram_blocks(docs, queries, threshold, limit, col), limit)
    q = queries.select("query_id", similarity.trigrams(F.col("query")).alias("t")).select("query_id", F.size("t").alias("m"), F.explode("t").alias("t"))
    asked = [r["t"] for r in q.select("t").distinct().limit(TOLD + 1).collect()]
    d = docs.select("version_id", similarity.trigrams(F.col(col)).alias("t"))
    own = F.array_intersect("t", F.array(*map(F.lit, asked)).cast("array<string>")) if len(asked) <= TOLD else F.col("t")
    d = d.select("version_id", F.size("t").alias("n"), F.explode(own).alias("t"))
    both = d.join(q, "t").groupBy("query_id", "version_id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    return _top(both.select("query_id", "version_id", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score")).where(F.col("score") >= threshold), limit)


def _trigram_blocks(docs: DataFrame, queries: DataFrame, threshold: float, limit: int, col: str) -> DataFrame:
    """``query_id``, ``version_id``, ``score``: the best of each query in each task."""
    made = queries.select("query_id", similarity.trigrams(F.col("query")).alias("t")).where(F.size("t") > 0)
    asked = stored(_sets(made, "query_id", QUERY_SETS, SET_CODES), "trigram-queries")
    d = docs.select("version_id", similarity.trigrams(F.col(col)).alias("t")).where(F.size("t") > 0)
    if threshold > 0:
        # k of n and m trigrams are at most m / n alike.
        most = asked.agg(F.max("most").alias("m")).first()["m"] or 0
        d = d.where(F.size("t") <= most / threshold + 1)
    # Each part sends the best of every query: enough of them for all cores, whatever the number of texts.
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    held = stored(_sets(d, "version_id", TEXT_SETS, SET_CODES * 16), "trigram-texts").repartition(parts)
    told = asked.select(F.col("ids").alias("names"), F.col("sizes").alias("widths"), F.col("codes").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list] = {}  # of each block of queries, the ids and scores of each query
        for b in batches:
            for row in range(b.num_rows):
                ids, sizes, codes, names, widths, wanted = (b.column(c)[row].as_py() for c in range(6))
                own = [np.frombuffer(x, t) for x, t in ((ids, np.int64), (sizes, np.int32), (codes, np.int64), (widths, np.int32), (wanted, np.int64))]
                best[names] = _likest(best.get(names), *own, threshold, limit)
        for names, found in best.items():
            no = np.repeat(np.frombuffer(names, np.int64), [len(i) for i, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(no), *(pa.array(np.concatenate(x)) for x in zip(*found))], ["query_id", "version_id", "score"])

    return held.select("ids", "sizes", "codes").crossJoin(told).mapInArrow(run, "query_id long, version_id long, score double")


def _sets(rows: DataFrame, key: str, most: int, most_codes: int) -> DataFrame:
    """Blocks of up to ``most`` rows of ``key`` and trigrams ``t``, and of ``most_codes`` trigrams if they are several: ids, sizes, and each trigram as a number of its three code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = np.array(b.column(0).to_pylist(), np.int64), b.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            known = np.array([ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2]) for t in coded.dictionary.to_pylist()], np.int64)
            codes, ends = known[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(sizes, dtype=np.int64)
            at, done = 0, 0
            while at < len(ids):
                to = min(at + most, max(at + 1, int(np.searchsorted(ends, done + most_codes, "right"))))
                kept = codes[done : ends[to - 1]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((int(sizes[at:to].max()), pa.int32()), (ids[at:to].tobytes(), pa.binary()), (sizes[at:to].tobytes(), pa.binary()), (kept.tobytes(), pa.binary()))], ["most", "ids", "sizes", "codes"])
                at, done = to, int(ends[to - 1])

    return rows.select(F.col(key).cast("long").alias(key), "t").mapInArrow(run, "most int, ids binary, sizes binary, codes binary")


def _likest(best: list | None, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, widths: np.ndarray, wanted: np.ndarray, threshold: float, limit: int) -> list:
    """The best ids and scores of each query among those so far and a block of sets."""
    best = best or [(np.zeros(0, np.int64), np.zeros(0))] * len(widths)
    known, rows = np.unique(wanted, return_inverse=True)
    asked = np.split(rows, np.cumsum(widths)[:-1])
    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    held, owner = known[place] == codes, np.repeat(np.arange(len(ids)), sizes)
    place, owner = place[held], owner[held]
    step = max(64, SET_CELLS // len(known))
    for at in range(0, len(ids), step):
        some = slice(*np.searchsorted(owner, [at, at + step]))
        n = sizes[at : at + step].astype(np.int64)
        has = np.zeros((len(known), len(n)), np.uint8)
        has[place[some], owner[some] - at] = 1
        for q, (own, m) in enumerate(zip(asked, widths.tolist())):
            common = np.add.reduce(has[own], axis=0, dtype=np.uint8 if m < 256 else np.int32)
            found, score = best[q]
            least = max(threshold, score[-1]) if len(found) >= limit else threshold
            # score >= least, but for rounding, in terms of k; what passes is scored exactly.
            hit = np.flatnonzero(common >= np.maximum(least / (1 + least) * (n + m) - 1e-6, 1))
            if len(hit):
                k = common[hit].astype(np.int64)
                alike = k / (n[hit] + m - k)
                found, score = np.append(found, ids[at + hit[alike >= threshold]]), np.append(score, alike[alike >= threshold])
                order = np.lexsort((found, -score))[:limit]
                best[q] = (found[order], score[order])
    return best


def _packed(rows: DataFrame, key: str, col: str, most: int) -> DataFrame:
    """``n``, ``ids``, ``unit``: blocks of up to ``most`` ids and unit vectors as bytes; null, zero and non-finite vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = ann.vectors_of(b.column(1))
            ids = np.array(b.column(0).to_pylist(), np.int64)[at] if len(at) else np.zeros(0, np.int64)
            for k in range(0, len(ids), most):
                part = [pa.array([len(ids[k : k + most])], pa.int32()), pa.array([ids[k : k + most].tobytes()], pa.binary()), pa.array([x[k : k + most].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(part, ["n", "ids", "unit"])

    return rows.select(F.col(key).cast("long").alias(key), col).mapInArrow(run, "n int, ids binary, unit binary")


def vector_search(docs: DataFrame, queries: DataFrame, limit: int = 50, col: str = "embedding") -> DataFrame:
    """The nearest by cosine, exactly, of each of ``queries`` (``query_id`` and ``col``), ties by id.

    Both sides are packed, thousands of vectors to a row, and each block of
    documents meets each block of queries; no vector passes the driver.  Each
    task keeps its best ``limit`` for each query, then those are ranked.  Null,
    zero and non-finite vectors are near nothing; all vectors have one dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # of each block of queries: number of the query, id, score
        for b in batches:
            for row in range(b.num_rows):
                # One row at a time: a batch holds many blocks, and no second copy of them.
                n, ids, unit, m, names, asked = (c[row].as_py() for c in b.columns)
                x, q, ids = np.frombuffer(unit).reshape(n, -1), np.frombuffer(asked).reshape(m, -1), np.frombuffer(ids, np.int64)
                best[names] = _best_so_far(best.get(names), x, ids, q, limit)
        for names, parts in best.items():
            for k, (no, ids, score) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)[no + k * AT_ONCE]), pa.array(ids), pa.array(score)], ["query_id", "version_id", "score"])

    asked = _packed(queries, "query_id", col, QUERY_BLOCK).toDF("m", "names", "asked")
    return _top(_packed(docs, "version_id", col, VECTOR_ROWS).crossJoin(asked).mapInArrow(run, "query_id long, version_id long, score double"), limit)


def _best_so_far(best: list | None, unit: np.ndarray, ids: np.ndarray, q: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_better` of each ``AT_ONCE`` queries of a block, so that a table of scores is small."""
    parts = range(0, len(q), AT_ONCE)
    return [_better(old, unit, ids, q[k : k + AT_ONCE], limit) for old, k in zip(best or [None] * len(parts), parts)]


def _better(best: tuple | None, unit: np.ndarray, ids: np.ndarray, q: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of each query among those so far and a block of vectors."""
    best = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    scores = unit @ q.T
    # All at or above the last place count, so that ties are settled by id.
    row, no = np.nonzero(scores >= np.partition(scores, max(0, len(ids) - limit), axis=0)[max(0, len(ids) - limit)] - SLACK)
    # A product rounds by the place of a row in its block; sums row by row give equal vectors equal scores.
    exact = [(unit[row[k : k + VECTOR_ROWS]] * q[no[k : k + VECTOR_ROWS]]).sum(axis=1) for k in range(0, len(row), VECTOR_ROWS)]
    no, found, score = (np.concatenate(x) for x in zip(best, (no, ids[row], np.concatenate(exact))))
    order = np.lexsort((found, -score, no))
    kept = order[np.arange(len(no)) - np.searchsorted(no[order], no[order]) < limit]
    return no[kept], found[kept], score[kept]


def fuse(lists: dict[str, DataFrame], k: int = FUSION) -> DataFrame:
    """``query_id``, ``version_id``, ``score`` (sum of 1 / (k + rank)), ``rank``, ``components``.

    Ties keep the order of first appearance: earlier list, then better rank.
    Parts are added in the order of the lists, so sums come out alike anywhere.
    """
    rows = None
    for i, (name, df) in enumerate(lists.items()):
        one = df.select("query_id", "version_id", F.lit(i).alias("list"), F.lit(name).alias("name"), F.col("rank"), F.col("score").alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    parts = F.array_sort(F.collect_list(F.struct("list", "rank", "name", "part")))
    g = rows.groupBy("query_id", "version_id").agg(parts.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / (F.lit(k) + p["rank"]))
    g = g.select("query_id", "version_id", score.alias("score"), F.get("parts", F.lit(0)).alias("first"), F.map_from_entries(F.transform("parts", lambda p: F.struct(p["name"], p["part"]))).alias("components"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank", "version_id")
    return g.withColumn("rank", F.row_number().over(w)).drop("first")


Expander = Callable[[str], str]
Reranker = Callable[[str, list[tuple[int, str]]], list[int]]


def expanded(queries: DataFrame, expand: Expander | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Queries rewritten by a hook, then with the words of a table (``term``, ``synonym``) put behind terms they hold.

    Where the hook fails or gives nothing, a query stays.  Synonyms are added
    each once, in order of their bytes, by a join on the words of the queries.
    """
    if expand is not None:

        def one(q: str) -> str:
            try:
                return expand(q) or q
            except Exception:  # noqa: BLE001 - a hook must not stop a search
                return q

        queries = queries.withColumn("query", F.pandas_udf(lambda s: s.map({q: one(q) for q in s.dropna().unique()}), "string")("query"))
    if synonyms is None:
        return queries
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(fulltext.WORD), 0))).alias("term"))
    more = words.join(synonyms.select(F.lower("term").alias("term"), "synonym"), "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("synonym")), " ").alias("more"))
    return queries.join(more, "query_id", "left").withColumn("query", F.concat_ws(" ", "query", "more")).drop("more")


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, rerank: Reranker | None = None, top: int = 20) -> DataFrame:
    """The first ``top`` of each query's hits in the order of a hook; without one, or where it fails, in their own."""
    if rerank is None:
        return hits.where(F.col("rank") <= top)
    rows = hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("version_id", "body"), "version_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own = pdf["version_id"].tolist()
        try:
            order = [i for i in dict.fromkeys(rerank(pdf["query"].iloc[0], list(zip(own, pdf["body"])))) if i in set(own)]
        except Exception:  # noqa: BLE001
            order = own
        order = order[:top]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "version_id": order, "score": pdf.set_index("version_id")["score"].loc[order].tolist(), "rank": range(1, len(order) + 1)})

    return rows.select("query_id", "version_id", "score", "rank", "query", "body").groupBy("query_id").applyInPandas(run, "query_id long, version_id long, score double, rank int")


def hybrid_search(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, expand: Expander | None = None, limit: int = 20, per_retriever: int = 50, english: bool = True, index: textindex.Index | None = None) -> DataFrame:
    """Full text, trigram and (if ``vectors`` of the queries are given) nearest vectors, fused and cut, with what ``docs`` has of each hit.

    ``index`` is a stored one of the same ``docs``; without it, all their words are read.
    """
    q = expanded(queries, expand)
    by_words = index.search(q, per_retriever) if index else fulltext.search(fulltext.postings(docs, "version_id", english=english), q, limit=per_retriever, english=english)
    lists = {"fts": by_words, "trigram": trigram_search(docs, q, limit=per_retriever)}
    if vectors is not None:
        lists["vector"] = vector_search(docs, vectors, limit=per_retriever)
    return fuse(lists).where(F.col("rank") <= limit).join(docs.select("version_id", "node_id", "path", "heading", "body"), "version_id")


def browse_search(docs: DataFrame, queries: DataFrame, pins: DataFrame, limit: int = 20, most: int = 50, least_chars: int = 2) -> DataFrame:
    """``query_id``, ``place``, ``version_id``, ``path``, ``exact``, ``snippet``: an exactly cited version first, then hits.

    ``pins`` are (``query_id``, ``version_id``) that citations resolve to.
    """
    limit = max(1, min(limit, most))
    q = queries.where(F.length(text.strip(F.col("query"))) >= least_chars)
    hits = hybrid_search(docs, q, limit=limit).select("query_id", "version_id", F.col("rank").alias("r"))
    pinned = pins.join(q.select("query_id"), "query_id", "left_semi").select("query_id", "version_id")
    rows = pinned.withColumn("r", F.lit(0)).unionByName(hits.join(pinned, ["query_id", "version_id"], "left_anti"))
    w = W.partitionBy("query_id").orderBy("r", "version_id")
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).withColumn("exact", F.col("r") == 0)
    rows = rows.join(docs.select("version_id", "path", "heading", "body"), "version_id").join(q.select("query_id", "query"), "query_id")
    return rows.select("query_id", "place", "version_id", "path", "heading", "exact", text.search_snippet(F.col("body"), F.col("query")).alias("snippet"))


def tool_search(docs: DataFrame, nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Hits with snippet, scores and the heading of their chapter."""
    hits = hybrid_search(docs, queries, limit=min(limit, 50)).join(docs.select("version_id", "source", "parent_path"), "version_id")
    chapter = nodes.where("parent_path is null").select("source", F.col("path").alias("parent_path"), F.col("heading").alias("chapter_heading"))
    return hits.join(chapter, ["source", "parent_path"], "left").select("query_id", "rank", "version_id", "path", "heading", text.snippet(F.col("body")).alias("snippet"), "score", "components", "chapter_heading")


def pending_embeddings(versions: DataFrame) -> DataFrame:
    """Versions whose text changed since it was embedded."""
    return versions.where(F.col("content_hash") != F.coalesce("embedding_source_hash", F.lit("")))


def fake_embedding(s: str, width: int = 1024) -> list[float]:
    """A unit vector from SHA-256 of the text under a counter; for tests without a model."""
    raw = b"".join(hashlib.sha256(f"{i}:{s}".encode()).digest() for i in range(-(-width // 8)))
    v = np.frombuffer(raw, "<u4")[:width].astype(np.float64) / 0xFFFFFFFF * 2 - 1
    return (v / (np.linalg.norm(v) or 1)).tolist()


def embed(versions: DataFrame, embed_batch: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64, limit: int | None = None) -> DataFrame:
    """``version_id``, ``embedding``, ``embedding_source_hash``, ``error`` of the pending versions (with ``limit``, the first so many by id).

    ``embed_batch`` gets at most ``batch`` texts; if it fails or returns another
    number of vectors, its rows keep no embedding and carry the error.
    """
    make = embed_batch or (lambda texts: [fake_embedding(t) for t in texts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                own, error = pdf.iloc[at : at + batch], None
                try:
                    vectors = make(own["text"].tolist())
                    if len(vectors) != len(own):
                        raise ValueError(f"{len(vectors)} vectors for {len(own)} texts")
                except Exception as e:  # noqa: BLE001 - reported by row
                    vectors, error = [None] * len(own), str(e) or type(e).__name__
                yield pd.DataFrame({"version_id": own["version_id"], "embedding": vectors, "embedding_source_hash": None if error else own["content_hash"], "error": error})

    todo = pending_embeddings(versions).select("version_id", text.embedding_text(F.col("heading"), F.col("body")).alias("text"), "content_hash")
    if limit is not None:
        todo = todo.orderBy("version_id").limit(limit)
    return todo.mapInPandas(run, "version_id long, embedding array<float>, embedding_source_hash string, error string")
