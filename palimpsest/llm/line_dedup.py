"""Line dedup across documents, with DataFrame functions only.

Normalised lines are exploded and hashed, each hash counts the documents that
hold it, lines of hashes at or over the threshold go, and what stays is put
together again by position.

Two 64-bit hashes under different seeds stand for a line, so that chance
collisions stay out of reach at 10^12 lines.  The count is partly aggregated
before its shuffle, after each document has dropped its own repeats, so a line
that a third of all documents share costs one row for each map task.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, documents_of, stored

#: Below this many frequent lines (16 bytes each) the set is broadcast; above, it is shuffled.
BROADCAST_LINES = 1_000_000
#: Lines so frequent that a shuffle by line would be uneven; their number bounds their broadcast.
HEAVY_LINES = 1_000


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z (and no other letters) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``h1``, ``h2``, ``n_docs`` of every line key of at least ``min_chars`` code points in ``min_docs`` rows or more."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_key))).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """Drop the lines that many documents share.

    Returns ``doc_id``, ``kept`` (the text of the lines that stay), ``n_lines``
    and ``n_dropped``, one row for each input row, and ``carried`` if asked for.

    Null or empty text: one empty line, which has no key and stays.  Null ids
    are ids like others.  Each input row is a document of its own, repeated
    rows too.  An empty table gives an empty result.  Extra columns are ignored.
    """
    base = documents_of(docs, id_col, text_col, carry)
    found = stored(frequent_lines(base, min_docs, min_chars), "frequent-lines")
    lines = base.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", *_hashes(F.col("key")))
    if found.count() <= BROADCAST_LINES:
        hits = lines.join(F.broadcast(found.select("h1", "h2")), ["h1", "h2"], "left_semi")
    else:
        heavy = found.orderBy(F.desc("n_docs"), "h1", "h2").limit(HEAVY_LINES).select("h1", "h2", F.lit(True).alias("heavy"))
        marked = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
        rest = found.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").select("h1", "h2")
        hits = marked.where("heavy").drop("heavy").unionByName(marked.where("heavy is null").drop("heavy").join(rest, ["h1", "h2"], "left_semi"))
    dropped = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped")).select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "dropped")
    b = base.withColumn("text_hash", F.xxhash64("text"))
    joined = b.join(dropped, b.doc_id.eqNullSafe(dropped.d_id) & (b.text_hash == dropped.d_hash), "left")
    split = joined.withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["carried"] if carry else []),
    )
