"""Weighted full-text search over postings.

A posting is a lexeme of a version with its positions and weights.  Positions
run through heading and body and count stop words, so phrases stay exact.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.stemming import STOP_WORDS, stem

#: Weights of headings (A) and bodies (B).
WEIGHTS = {"A": 1.0, "B": 0.4}
#: Digits of a score that count: sums in another order differ behind them, and would part ties.
DIGITS = 9
WORD = r"(?U)[\p{L}\p{N}]+"
#: Lexemes of a table of queries that are told to the scan.
PUSHED = 1_000
#: Words that are looked at at a time, and words whose lexemes a worker keeps.
WORDS, KEPT = 1 << 18, 1 << 18


@functools.lru_cache(maxsize=KEPT)
def lexeme_of(word: str) -> str | None:
    """The stem of an English word; None of a stop word."""
    return None if word in STOP_WORDS else stem(word)


def _pieces(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``WORDS`` words each, if they are several rows."""
    ends, at = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, WORDS + (ends[at - 1] if at else 0), "right")))
        yield at, to
        at = to


def postings(df: DataFrame, *keys: str, english: bool = True) -> DataFrame:
    """``keys``, ``lexeme``, ``at``: an array of (pos, weight), ascending; positions count from 1, stop words too.

    ``english``: stop words go, the rest is stemmed; each distinct word of a
    piece of ``WORDS`` words is stemmed once, if the worker doesn't know it.
    Otherwise lexemes are the words in lower case.
    All words of a version are in its row, so nothing is shuffled.
    """
    kinds = dict(df.dtypes)
    found = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), 0)
    d = df.select(*keys, found("heading").alias("_h"), found("body").alias("_b"))
    d = d.select(*keys, F.size("_h").alias("_n"), F.concat("_h", "_b").alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, to - at) for b in batches for at, to in _pieces(b.column(len(keys) + 1))):
            own, n_heading, lists = batch.columns[: len(keys)], batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(lists.flatten())
            pos = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
            words = coded.dictionary.to_pylist()
            named = list(map(lexeme_of, words)) if english else words
            lexemes = pa.array(named, pa.string()).dictionary_encode()
            code = pc.fill_null(lexemes.indices.cast(pa.int32()), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(doc) else np.zeros(0, np.int32)
            order = np.lexsort((pos, code, doc))
            order = order[code[order] >= 0]
            doc, code, pos = doc[order], code[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.zeros(0, np.int64)
            weight = pa.array(np.where(pos <= n_heading[doc], "A", "B"), pa.string())
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.StructArray.from_arrays([pa.array(pos, pa.int32()), weight], names=["pos", "weight"]))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(doc[first])) for c in own), lexemes.dictionary.take(pa.array(code[first])), at], names=[*keys, "lexeme", "at"])

    return d.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lexeme string, at array<struct<pos: int, weight: string>>")


def write_postings(post: DataFrame, path: str) -> None:
    """Store an index, in order of lexeme: a search then reads the row groups of its own lexemes."""
    keys = [c for c in post.columns if c not in ("lexeme", "at")]
    post.repartitionByRange("lexeme", *keys).sortWithinPartitions("lexeme", *keys).write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_PIECE = re.compile(r'(-?)"([^"]*)"|(\S+)')


def read_query(query: str, english: bool = True) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives of conditions: (wanted, lexemes with their distance from the first).

    Terms must all occur; ``or`` separates alternatives; ``-`` negates; quotes
    make phrases.  Stray quotes and operators are read as blanks.
    """
    out: list[list] = [[]]
    if query.count('"') % 2:
        query = query[::-1].replace('"', " ", 1)[::-1]
    for m in _PIECE.finditer(query):
        if m[3] and m[3].lower() == "or":
            out.append([])
            continue
        piece = m[2] if m[3] is None else m[3]
        wanted = not (m[1] if m[3] is None else m[3].startswith("-"))
        lexemes, first = [], None
        for i, w in enumerate(re.findall(r"[^\W_]+", piece.lower())):
            if english and w in STOP_WORDS:
                continue
            first = i if first is None else first
            lexemes.append((stem(w) if english else w, i - first))
        if lexemes:
            out[-1].append((wanted, lexemes))
    return [c for c in out if any(w for w, _ in c)]


def cover_density(hits: list[tuple[int, str, str]], wanted: set[str]) -> float:
    """Sum over minimal covers: weight of their hits over one and the words between.

    ``hits`` are (position, weight, lexeme); one that two clauses of a query ask for counts once.
    """
    hits = sorted(set(hits))
    total, count, left, need = 0.0, dict.fromkeys(wanted, 0), 0, len(wanted)
    for right, (end, _, lexeme) in enumerate(hits):
        count[lexeme] += 1
        need -= count[lexeme] == 1
        while need == 0:
            # Shrink to the minimal cover that ends here.
            first = hits[left][2]
            if count[first] > 1:
                count[first] -= 1
                left += 1
                continue
            inside = hits[left : right + 1]
            spread = max(0, (end - hits[left][0]) - (len(inside) - 1))
            total += len(inside) / sum(1 / WEIGHTS[w] for _, w, _ in inside) / (1 + spread)
            count[first] -= 1
            need += 1
            left += 1
    return total


_ROWS = "query_id long, alternative int, wanted boolean, clause int, lexeme string, distance int"


def query_terms(queries: DataFrame, english: bool = True) -> DataFrame:
    """A table of (``query_id``, ``query``) as rows of lexemes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(q, a, wanted, c, lexeme, d) for q, text in zip(pdf["query_id"], pdf["query"]) for a, clauses in enumerate(read_query(text or "", english)) for c, (wanted, lexemes) in enumerate(clauses) for lexeme, d in lexemes]
            yield pd.DataFrame(rows, columns=["query_id", "alternative", "wanted", "clause", "lexeme", "distance"])

    return queries.select("query_id", "query").mapInPandas(run, _ROWS)


def _density(hits: pd.Series) -> pd.Series:
    out = []
    for rows in hits:
        found = [(int(p["pos"]), p["weight"], r["lexeme"]) for r in rows for p in r["at"]]
        out.append(round(cover_density(found, {x for _, _, x in found}), DIGITS))
    return pd.Series(out, dtype="float64")


def search(post: DataFrame, queries: DataFrame, key: str = "version_id", limit: int | None = 50, english: bool = True) -> DataFrame:
    """``query_id``, ``key``, ``score``, ``rank`` of at most ``limit`` matches for each query; with None all matches, without a rank.

    Only postings of the queries' lexemes are read further; a document meets a
    query only through a lexeme they share.  Up to ``PUSHED`` lexemes reach the
    scan of a stored index as a filter.
    """
    terms = query_terms(queries, english)
    asked = [r["lexeme"] for r in terms.select("lexeme").distinct().limit(PUSHED + 1).collect()]
    if len(asked) <= PUSHED:
        post = post.where(F.col("lexeme").isin(asked))
    hits = post.join(terms, "lexeme")
    starts = F.transform("at", lambda x: x["pos"] - F.col("distance"))
    # A clause holds where all its lexemes stand at their distances from one start.
    need = terms.groupBy("query_id", "alternative", "clause").agg(F.count(F.lit(1)).alias("n_lexemes"))
    placed = hits.select("query_id", "alternative", "clause", "wanted", key, "lexeme", "at", F.array_distinct(starts).alias("starts"))
    clause = placed.groupBy("query_id", "alternative", "clause", "wanted", key).agg(F.count(F.lit(1)).alias("found"), F.collect_list("starts").alias("starts"), F.collect_list(F.struct("lexeme", "at")).alias("hits"))
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    clause = clause.join(need, ["query_id", "alternative", "clause"]).where((F.col("found") == F.col("n_lexemes")) & (F.size(common) > 0))
    wanted = terms.where("wanted").groupBy("query_id", "alternative").agg(F.countDistinct("clause").alias("n_clauses"))
    whole = clause.groupBy("query_id", "alternative", key).agg(F.count_if(F.col("wanted")).alias("n"), F.count_if(~F.col("wanted")).alias("bad"), F.flatten(F.collect_list(F.when(F.col("wanted"), F.col("hits")))).alias("hits"))
    whole = whole.join(wanted, ["query_id", "alternative"]).where("n = n_clauses and bad = 0")
    scored = whole.withColumn("score", F.pandas_udf(_density, "double")("hits")).groupBy("query_id", key).agg(F.max("score").alias("score"))
    if limit is None:
        return scored
    # Spark keeps each task's first ``limit`` before it ranks (a limit on the window's groups).
    w = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
