"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame with the columns of ``documents`` (the last one:
places of pieces in sequences).  Stages are written as Parquet and read again.

In every stage null text counts as empty, null and repeated ids and repeated
rows are rows of their own, other columns than those of ``documents`` are left
out, texts of any length are read whole, and an empty table gives an empty
result.  What a stage adds to this, its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard_join, line_dedup, packing, pii, quality_classifier
from palimpsest.llm.common import read_table, stored
from palimpsest.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.7 go; empty texts have a score like others, equal texts have equal scores, and without labels all scores are the same."""
    trees = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs.select(*COLUMNS), trees, threshold=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them; a text may become empty, but stays.  Empty lines are never shared; null text comes out empty."""
    out = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1, carry=["lang", "source"])
    return out.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; texts without words are groups of their own."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is masked by its kind; null text stays null, with 0 characters."""
    out = pii.mask_private(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("best-fit packing", sequences),
]

#: Trees, tokenizers and packing are beyond SQL; the tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
