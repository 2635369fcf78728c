"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a batch come from its bytes and numbered words by numpy.  The
trees are fitted on a bounded sample of labelled rows and flattened into arrays
of one length for each level, so that a batch goes down all of them by indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of
from .shingles import hash_words, mixed, word_codes
from .tokens import slices

#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
#: Fold of ``crc32(id) % FOLDS`` that is never learned from.
FOLDS, HELD_OUT = 4, 2

NAMES = ("log_words", "chars_a_word", "symbols", "exclamations", "bars", "capitals", "digits", "beyond_ascii", "punctuation", "distinct_words", "commonest_word", "adjacent_repeats", "repeated_pairs", "repeated_eights", "short_words", "words_a_line", "repeated_lines", "log_longest_word")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOLS, _MARKS, _BARS = _class("#*$%&<>^~=_\\{}[]@"), _class("!"), _class("|")
_CAPITALS, _DIGITS, _PUNCTUATION = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:?'\"()-")


def _repeated(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many of a text's items equal another of its items."""
    if not len(codes):
        return np.zeros(n)
    _, at, count = np.unique(codes ^ mixed(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    return np.bincount(doc, count[at] > 1, n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of :data:`NAMES` for each text (no nulls)."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw, ends = raw[ends[0] : ends[-1]], ends - ends[0]
    count = lambda table: _per_text(table[raw], ends)
    words, codes, bounds = word_codes(texts, lower=False)
    size = np.diff(bounds)
    n_words = size.astype(np.float64)
    per_word = np.maximum(n_words, 1)
    chars = np.array([len(w) for w in words.to_pylist()], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    n_chars = np.maximum(_per_text(chars, bounds), 1)
    doc = np.repeat(np.arange(n), size)
    hashed = hash_words(words)[codes]
    longest, commonest, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(codes):
        np.maximum.at(longest, doc, chars)
        _, first, times = np.unique(doc * max(1, len(words)) + codes, return_index=True, return_counts=True)
        distinct = np.bincount(doc[first], minlength=n).astype(float)
        np.maximum.at(commonest, doc[first], times)
    pair = (hashed[:-1] * np.uint64(31) + hashed[1:], doc[:-1], doc[:-1] == doc[1:]) if len(codes) > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    adjacent = np.bincount(pair[1][pair[2] & (hashed[:-1] == hashed[1:])], minlength=n) if len(codes) > 1 else np.zeros(n)
    pairs = _repeated(pair[0][pair[2]], pair[1][pair[2]], n)
    m = max(0, len(codes) - 7)
    eight = np.zeros(m, np.uint64)
    for k in range(8):
        eight = eight * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + m]
    whole = doc[:m] == doc[7:] if m else np.zeros(0, bool)
    eights = _repeated(mixed(eight[whole]), doc[:m][whole], n)
    lines = [t.split("\n") for t in texts.to_pylist()]
    filled = [[x for x in ls if x.strip()] for ls in lines]
    n_lines = np.array([max(1, len(x)) for x in filled], float)
    same_lines = np.array([len(x) - len(set(x)) for x in filled], float)
    beyond = _per_text((raw & 0xC0) == 0xC0, ends)
    return np.column_stack([
        np.log1p(n_words), n_chars / per_word, count(_SYMBOLS) / n_chars, count(_MARKS) / n_chars, count(_BARS) / n_chars, count(_CAPITALS) / n_chars, count(_DIGITS) / n_chars, beyond / n_chars, count(_PUNCTUATION) / n_chars,
        distinct / per_word, commonest / per_word, adjacent / per_word, pairs / per_word, eights / per_word, _per_text(chars <= 1, bounds) / per_word, n_words / n_lines, same_lines / n_lines, np.log1p(longest),
    ])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: level by level, and a value for each leaf."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # (trees, 2**depth - 1); right if the statistic is greater
    value: np.ndarray  # (trees, 2**depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row."""
        n, (trees, inner) = len(x), self.feature.shape
        at = np.zeros((n, trees), np.int64)
        row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        margin = self.start + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Boosted trees for the log loss, each split chosen from histograms of gradients."""
    n, width = x.shape
    inner = 2**depth - 1
    feature, cut, value = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(feature, cut, value, start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])  # bin k: edges[k-1] < v <= edges[k]
    margin = np.full(n, start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best, choice = np.zeros(nodes), [(0, np.inf)] * nodes
            local = at - first
            for j in range(width):
                cell = local * bins + binned[:, j]
                gs = np.bincount(cell, g, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    for node in np.flatnonzero(gain[np.arange(nodes), k] > best + 1e-9):
                        best[node], choice[node] = gain[node, k[node]], (j, edges[j][k[node]])
            for node, (j, c) in enumerate(choice):
                feature[t, first + node], cut[t, first + node] = j, c
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = rate * gs / (hs + ridge)
        margin += value[t][leaf]
    return Trees(feature, cut, value, start)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample_of(labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``s_id``, ``label`` of at most ``rows`` labelled rows outside the held-out fold, by hash of the id."""
    some = labels.select(labels[id_col].cast("long").alias("s_id"), labels[label_col].cast("int").alias("label")).where("s_id is not null and label is not null")
    return some.where(~held_out(F.col("s_id"))).orderBy(F.xxhash64("s_id"), "s_id", "label").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled documents; only their statistics reach the driver.

    Without labelled documents, or with one label only, every score is the same.
    """
    base = documents_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in statistics(part.column(1))], pa.binary())], names=["label", "x"])

    some = base.join(F.broadcast(sample_of(labels, id_col, label_col, sample_rows)), F.col("doc_id") == F.col("s_id")).select("label", "text")
    rows = some.mapInArrow(run, "label int, x binary").toPandas().sort_values(["label", "x"])
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.float64).reshape(-1, len(NAMES))
    return fit(x, (rows["label"].to_numpy(float) > 0).astype(float))


def score_documents(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null text counts as empty, and empty texts are scored by their statistics
    too.  Rows are scored one by one, so repeated rows and ties need no rule;
    a null id is in no fold.  An empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(statistics(part.column(1))))], names=["doc_id", "score"])

    scored = documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all columns.

    Null text is scored as empty text and stays null.  Rows are judged one by
    one, so repeated rows and ties stay or go together; columns of any name are
    kept, texts are read whole, and an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                text = part.column(at).cast(pa.string()).fill_null("")
                yield part.filter(pa.array(held.value.score(statistics(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
