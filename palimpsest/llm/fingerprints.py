"""Document fingerprints from closed syncmers, with DataFrame functions only.

The units are words.  A k-mer of ``K`` words is an anchor if the smallest hash
among its inner ``S``-mers stands at its first or last place.  Whether it is
depends on its own words alone, so an edit moves no anchor outside the edit.

A fingerprint is every anchor of the whole text in order, with its hash and its
place (the number of words before its last one).  Texts are matched by position:
their features are the anchors and the steps from one anchor to the next, which
are the hashes of both and the number of words between their places, and their
likeness is the Jaccard likeness of these.  An edit changes the places of all
anchors behind it but no step outside it.  :func:`matches` lists where two texts
have anchors in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents_of, long_array, order_bounds, order_bucket

K, S = 4, 2


def with_anchors(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds array<bigint> ``name``, the hashes of the anchors of ``text``, array<int> ``name_at``, their places, and array<bigint> ``name_set``, the features.

    ``K - 1`` empty words stand before the text, so that a text of one word has
    a k-mer too.  The text with no word has the fingerprint of no anchors.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    d = d.withColumn("_w", F.when(F.size("_w") > 0, F.concat(F.array(*[F.lit(i).cast("long") for i in range(K - 1)]), F.col("_w"))).otherwise(F.array().cast("array<bigint>")))
    n = F.size("_w")
    d = d.withColumn("_s", F.zip_with(F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    s = lambda i: F.get(F.col("_s"), i)
    places = F.when(F.size("_s") >= K - S + 1, F.sequence(F.lit(0), F.size("_s") - (K - S + 1))).otherwise(F.array().cast("array<int>"))
    chosen = F.filter(places, lambda i: s(i + 1) >= F.least(s(i), s(i + 2)))
    d = d.withColumn(f"{name}_at", chosen)
    at, n = F.col(f"{name}_at"), F.greatest(F.size(f"{name}_at") - 1, F.lit(0))
    steps = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda i, j: F.xxhash64(s(i), s(i + 2), s(j), s(j + 2), j - i))
    d = d.withColumn(name, F.transform(at, lambda i: F.xxhash64(s(i), s(i + 2))))
    return d.withColumn(f"{name}_set", F.array_distinct(F.concat(name, steps))).drop("_w", "_s")


def matches(a: Column, a_at: Column, b: Column, b_at: Column) -> Column:
    """For each anchor of ``a`` (hashes and places) that ``b`` has too: its place in ``a`` and its first place in ``b``, array<struct<at, there>>."""
    both = F.filter(F.arrays_zip(a.alias("hash"), a_at.alias("at")), lambda x: F.array_contains(b, x["hash"]))
    return F.transform(both, lambda x: F.struct(x["at"].alias("at"), F.element_at(b_at, F.array_position(b, x["hash"]).cast("int")).alias("there")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of the features of two texts; two texts without anchors are alike (1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_string(hashes: Column, places: Column) -> Column:
    """For each anchor in order 16 hexadecimal digits of its hash and 8 of its place."""
    return F.lower(F.array_join(F.zip_with(hashes, places, lambda h, i: F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(i), 8, "0"))), ""))


def with_next(base: DataFrame, carry: list[str], rows_per_bucket: int = 200, derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds ``next_<c>`` for each ``c`` of ``carry``: the value of the row with the next id, after the last the first's.

    ``derive`` adds columns behind the shuffle, so that they need not be moved.

    No task sees the whole order: rows go to buckets of consecutive ids, and the
    first row of each bucket is also sent to the bucket before it.
    """
    ids = base.select("doc_id")
    bounds = order_bounds(ids, rows_per_bucket=rows_per_bucket)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    firsts = {r["b"]: r["least"]["doc_id"] for r in ids.groupBy(order_bucket(F.col("doc_id"), bounds).alias("b")).agg(least.alias("least")).collect()}
    if not firsts:
        return derive(base).select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    d = base.withColumn("_b", order_bucket(F.col("doc_id"), bounds))
    every = range(len(bounds) + 1)
    # Null ids can only be the first of the first bucket.
    null_first = F.lit(firsts[used[0]] is None) & (F.col("_b") == used[0])
    first = F.when(null_first, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.get(long_array([firsts.get(b) or 0 for b in every]), F.col("_b")))
    own, guest = F.struct(F.col("_b").cast("long").alias("b"), F.lit(False).alias("guest")), F.struct(F.get(long_array([before.get(b, 0) for b in every]), F.col("_b")).alias("b"), F.lit(True).alias("guest"))
    copies = F.when(first, F.array(own, guest)).otherwise(F.array(own))
    d = d.withColumn("_c", F.explode(copies))
    d = d.select("*", F.col("_c")["b"].alias("_to"), F.col("_c")["guest"].alias("_guest")).drop("_b", "_c")
    d = derive(d.repartition("_to"))
    w = W.partitionBy("_to").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_t")
    d = d.withColumn("_t", F.xxhash64("text"))
    d = d.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where(~F.col("_guest"))
    return d.drop("_to", "_guest", "_t")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text replaces the last ``floor(n_chars / 4)`` code points by the
    first as many of the next document in order of id (after the last: of the
    first).  Columns: ``doc_id``, ``n_chars``, ``edited_text``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Null text counts as empty.  Rows with equal ids are ordered by a hash of
    their text.  Null ids come first.  A single row is its own next document;
    an empty table gives an empty result.
    """
    d = with_next(documents_of(docs, id_col, text_col), ["text", "fp_set"], derive=lambda d: with_anchors(d, F.col("text"), "fp"))
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    d = d.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    d = with_anchors(d.drop("next_text"), F.col("edited_text"), "edited_fp")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_text",
        as_string(F.col("fp"), F.col("fp_at")).alias("fingerprint"),
        as_string(F.col("edited_fp"), F.col("edited_fp_at")).alias("edited_fingerprint"),
        likeness(F.col("fp_set"), F.col("edited_fp_set")).alias("near_edited"),
        likeness(F.col("fp_set"), F.col("next_fp_set")).alias("near_next"),
    )
