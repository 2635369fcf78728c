"""Quality rules: a table of thresholds compiled into one projection.

All measures are array and string functions within the row: no shuffle and no
user functions.  A document is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent words of English, Spanish, German and French prose.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "que", "el", "en", "los", "se", "der", "die", "und", "das", "den", "le", "les", "des", "et", "un", "une")


@dataclass(frozen=True)
class Rule:
    """Fails a document whose ``measure`` lies outside ``low`` to ``high`` (either may be None)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table.  Ratios of an empty document are 0.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("repetition", "repeat_ratio", high=0.30),
    Rule("mean_word_length", "mean_word_chars", low=2, high=20),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("duplicate_lines", "dup_line_ratio", high=0.30),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("shouting", "exclaim_ratio", high=0.30),
)


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """One boolean expression for the whole table: true where every rule holds."""
    kept = F.lit(True)
    for r in rules:
        m = measures[r.measure]
        if r.low is not None:
            kept = kept & (m >= F.lit(r.low))
        if r.high is not None:
            kept = kept & (m <= F.lit(r.high))
    return kept


def with_measures(base: DataFrame, window: int = 8) -> DataFrame:
    """Adds the counts that the rules are made of.

    Windows of eight words are hashed by doubling: pairs, fours, eights.  Only
    a document with an equal hash at two places sorts them to find which words
    they cover; sorting, not searching, keeps that n log n for any length.
    """
    assert window == 8
    d = base.withColumn("words", F.filter(F.split("text", WORD_GAP), lambda w: w != ""))
    d = d.withColumn("n", F.size("words"))
    pair = lambda a, gap: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - gap, F.lit(0))), F.slice(a, 1 + gap, F.greatest(F.size(a) - gap, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    d = d.withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("w2", pair(F.col("w1"), 1)).withColumn("w4", pair(F.col("w2"), 2)).withColumn("w8", pair(F.col("w4"), 4))
    d = d.withColumn("repeats", F.size("w8") > F.size(F.array_distinct("w8")))
    at = F.when(F.col("repeats"), F.array_sort(F.transform("w8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("sorted", at)
    same = lambda j, k: F.get(F.col("sorted"), j)["h"] == F.get(F.col("sorted"), k)["h"]
    starts = F.array_sort(F.transform(F.filter("sorted", lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))), lambda x: x["i"]))
    d = d.withColumn("starts", F.when(F.col("repeats"), starts))
    gaps = F.zip_with(F.slice("starts", 1, F.size("starts") - 1), F.slice("starts", 2, F.size("starts") - 1), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.aggregate(gaps, F.lit(window).cast("long"), lambda acc, g: acc + g)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.withColumn("lines", lines)
    return d.select(
        *base.columns,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_text_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.endswith("!!"))).cast("long").alias("n_shouts"),
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every document.

    ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (under 20 words, or over 30 % of the
    words in repeated windows) and ``kept`` (every rule holds).

    Null or empty text has no words and fails.  Rows are judged one by one, so
    ties, repeated rows and null ids need no rule; an empty table stays empty.
    """
    m = with_measures(documents_of(docs, id_col, text_col))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    measures = {
        "n_words": F.col("n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_text_lines"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "exclaim_ratio": ratio("n_shouts", "n_words"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules, measures)).alias("kept"))
