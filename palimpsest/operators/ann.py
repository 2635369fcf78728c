"""Approximate nearest vectors: an inverted file with product-quantised codes.

Unit vectors belong to the cell of their nearest centroid; a row of the index
holds its id, its cell and a code of one byte for each of a few subspaces of
what is left over the centroid.  A search asks only the cells nearest to a
query, ranks their rows by sums looked up from their codes, and scores the best
again from the vectors themselves, so scores are exact and only the choice of
rows is approximate.

The model is fitted on a bounded sample that hashes of all ids draw
(``SAMPLE``); every row is indexed.  How many cells a search asks is found on
the sample too: the least number that reaches ``AIM`` of the sample's own true
neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most rows that a model is fitted on, most cells, and rows of the sample that a cell needs.
SAMPLE, MOST_CELLS, ROWS_PER_CELL = 65_536, 4_096, 16
#: Rounds of the fit, and its seed.
ROUNDS, SEED = 12, 11
#: Share of true neighbours that the number of cells asked is chosen for, the neighbours looked at, and the rows of the sample that ask.
AIM, NEIGHBOURS, ASKING = 0.97, 10, 256
#: Rows of a cell, and queries to it, that meet in one group.
PART_ROWS, PART_QUERIES = 16_384, 1_024
#: Rows of queries and cells that a task makes at a time.
ASKED_ROWS = 8_192
#: Rows by code that are scored again, for each one wanted.
RESCORED = 16


@dataclass
class Model:
    """Centroids (cells x dim), codebooks (subspaces x 256 x width), and cells to ask."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the rows that have a direction; nulls, zeros and non-finite ones have none."""
    rows = column.to_pylist()
    at = [i for i, v in enumerate(rows) if v and None not in v]
    x = np.array([rows[i] for i in at], np.float64) if at else np.zeros((0, 1))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(at, np.int64)[good], _unit(x[good])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid by distance, a block of rows at a time."""
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centroids.T - half, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, int)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k means; a mean without rows starts anew at a row of the sample."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def _subspaces(dim: int) -> int:
    """As many parts of at least four components as divide ``dim`` evenly, else one for each component."""
    return next((dim // w for w in (4, 5, 6, 7, 8) if dim % w == 0), dim)


def fit(docs: DataFrame, id_col: str = "version_id", col: str = "embedding") -> Model | None:
    """A model for ``docs``; None if no row has a vector.  The driver holds at most ``SAMPLE`` vectors."""
    rows = docs.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), F.xxhash64(id_col).alias("h"))
    x = vectors_of(pa.array([r["v"] for r in rows.orderBy("h").limit(SAMPLE).select("v").collect()], pa.list_(pa.float64())))[1]
    if not len(x):
        return None
    rng = np.random.default_rng(SEED)
    # Cells for the sample alone: more would leave too few rows to fit each.
    cells = max(1, min(MOST_CELLS, int(len(x) ** 0.5), len(x) // ROWS_PER_CELL))
    centroids = _means(x, cells, rng)
    rest = x - centroids[_nearest(x, centroids)]
    parts = _subspaces(x.shape[1])
    books = np.stack([_means(p, 256, rng) for p in np.split(rest, parts, axis=1)])
    return Model(centroids, books, _probes(x, centroids, rng))


def _probes(x: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> int:
    """The least number of cells that hold ``AIM`` of the nearest neighbours of rows of the sample."""
    ask = rng.choice(len(x), min(ASKING, len(x)), replace=False)
    own = _nearest(x, centroids)
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -2
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[ask] @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) + 1


def index(docs: DataFrame, model: Model, id_col: str = "version_id", col: str = "embedding") -> DataFrame:
    """``version_id``, ``cell``, ``code`` of every row that has a direction.  Row by row: nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        parts = len(m.books)
        for b in batches:
            at, x = vectors_of(b.column(1))
            cell = _nearest(x, m.centroids)
            rest = np.split(x - m.centroids[cell], parts, axis=1) if len(x) else []
            codes = np.stack([_nearest(p, c) for p, c in zip(rest, m.books)], 1).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["version_id", "cell", "code"])

    return docs.select(F.col(id_col).cast("long").alias("version_id"), col).mapInArrow(run, "version_id long, cell int, code binary")


def write_index(docs: DataFrame, model: Model, path: str, mode: str = "overwrite", id_col: str = "version_id", col: str = "embedding") -> None:
    """Store the index, a folder for each cell, and the model beside it; ``mode`` append adds rows under the stored model.

    Rows are dealt by ranges of (cell, hash), so that a cell with a third of
    all rows is written by many tasks.
    """
    rows = index(docs, model, id_col, col).withColumn("salt", F.xxhash64("version_id"))
    rows.repartitionByRange("cell", "salt").sortWithinPartitions("cell", "salt").drop("salt").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
    docs.sparkSession.createDataFrame([(bytearray(pickle.dumps((model.centroids, model.books, model.probes))),)], "model binary").write.mode("overwrite").parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, Model]:
    model = Model(*pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()["model"])))
    return spark.read.schema("version_id long, code binary, cell int").parquet(f"{path}/rows"), model


def _asking(b: pa.RecordBatch, centroids: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """``query_id``, ``cell``, ``q`` of a batch of queries, at most ``ASKED_ROWS`` rows at a time (those of one query stay together)."""
    at, x = vectors_of(b.column(1))
    n = min(probes, len(centroids))
    step = max(1, ASKED_ROWS // n)
    for k in range(0, len(x), step):
        some = x[k : k + step]
        near = np.argsort(-(some @ centroids.T), axis=1, kind="stable")[:, :n]
        ends = np.arange(near.size + 1, dtype=np.int32) * x.shape[1]
        q = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.repeat(some, n, axis=0).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(at[k : k + step], n))), pa.array(near.ravel().astype(np.int32)), q], ["query_id", "cell", "q"])


def _asked_cells(queries: DataFrame, model: Model, probes: int, col: str) -> DataFrame:
    """``query_id``, ``cell``, ``q`` (the unit vector), a row for each cell to be asked."""
    held = queries.sparkSession.sparkContext.broadcast(model.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _asking(b, held.value, probes)

    return queries.select(F.col("query_id").cast("long").alias("query_id"), col).mapInArrow(run, "query_id long, cell int, q array<double>")


def search(docs: DataFrame, queries: DataFrame, rows: DataFrame, model: Model, limit: int = 50, probes: int | None = None, col: str = "embedding") -> DataFrame:
    """``query_id``, ``version_id``, ``score``, ``rank``: as the exact search, but from the cells nearest to each query.

    Queries are rows: they meet the index in groups of a part of a cell and a
    part of its queries, both bounded, whose best by code go on.  ``docs`` are
    read once more for the vectors of those.
    """
    spark = docs.sparkSession
    asked = _asked_cells(queries, model, min(probes or model.probes, len(model.centroids)), col)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("loads"))
    # One row for each cell: at most MOST_CELLS.
    plan = F.broadcast(sizes.join(loads, "cell"))
    left = asked.join(plan, "cell").withColumn("load", F.expr("cast(pmod(xxhash64(query_id), loads) as int)")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = rows.join(plan, "cell").withColumn("part", F.expr("cast(pmod(xxhash64(version_id), parts) as int)")).withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)))
    held, most = spark.sparkContext.broadcast(model), limit * RESCORED

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("version_id", pa.int64()), ("near", pa.float32())])
        if not q.num_rows or not d.num_rows:
            return schema.empty_table()
        m = held.value
        x = np.array(q["q"].to_pylist())
        ids = np.asarray(d["version_id"])
        codes = np.frombuffer(b"".join(d["code"].to_pylist()), np.uint8).reshape(len(ids), len(m.books))
        cell = int(q["cell"][0].as_py())
        parts = np.split(x, len(m.books), axis=1)
        tables = np.stack([p @ c.T for p, c in zip(parts, m.books)], 1).astype(np.float32)  # query, subspace, code
        base = x @ m.centroids[cell]
        out = []
        names = q["query_id"].to_pylist()
        for i, name in enumerate(names):
            score = tables[i][np.arange(codes.shape[1]), codes].sum(1)
            best = np.lexsort((ids, -score))[:most] if len(ids) > most else np.arange(len(ids))
            out.append((np.full(len(best), name), ids[best], (score[best] + base[i]).astype(np.float32)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    group = ["cell", "part", "load"]
    near = left.select(*group, "query_id", "q").groupBy(*group).cogroup(right.select(*group, "version_id", "code").groupBy(*group)).applyInArrow(run, "query_id long, version_id long, near float")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "version_id"))).where(F.col("r") <= most).select("query_id", "version_id")
    return _rescored(docs, queries, near, limit, col)


def _rescored(docs: DataFrame, queries: DataFrame, near: DataFrame, limit: int, col: str) -> DataFrame:
    """The exact cosines of the candidates, ranked."""
    pairs = near.join(docs.select("version_id", F.col(col).alias("d")), "version_id").join(queries.select("query_id", F.col(col).alias("q")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, q = (_unit(np.array(b.column(i).to_pylist(), np.float64).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, 1)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((d * q).sum(axis=1))], ["query_id", "version_id", "score"])

    scored = pairs.select("query_id", "version_id", "d", "q").mapInArrow(run, "query_id long, version_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "version_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id``, ``n_exact``, ``n_found``: of each query's exact hits, how many the other search has; a hit of equal score (to 9 digits) counts as well."""
    key = F.round("score", 9).alias("s")
    have = found.select("query_id", "version_id").withColumn("_have", F.lit(True))
    ties = found.select("query_id", key).distinct().withColumn("_tie", F.lit(True))
    both = exact.select("query_id", "version_id", key).join(have, ["query_id", "version_id"], "left").join(ties, ["query_id", "s"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count_if(F.coalesce("_have", "_tie", F.lit(False))).alias("n_found"))
