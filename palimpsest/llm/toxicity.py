"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity runs from 0 (none) to 3.  One weight for each feature is shared by all
thresholds: ``P(severity > k) = logistic(w . x - theta_k)`` with ascending
thetas.  Features are words and word beginnings, by one and the logarithm of their
count; the expected severity is the sum of these probabilities.

Labels say toxic or not, not how severe.  The grades that the model is fitted
to rank the toxic rows of the sample by how much of the toxic vocabulary they
hold: the least third is 1, the next 2, the rest 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of
from .quality_classifier import SAMPLE_ROWS, held_out, sample_of
from .shingles import word_codes
from .tokens import slices

GRADES = 4
#: Features kept at most, those with the clearest difference between toxic and other rows.
VOCABULARY = 2_000
#: Least log-likelihood ratio of a feature (chi-squared with one degree of freedom) and least documents that hold it.
LEAST_RATIO, LEAST_DOCS = 20.0, 5
#: Characters of a word's beginning.
BEGINNING = 5


def features_of(word: str) -> list[str]:
    """The word without marks at its ends, and its beginning if it is longer."""
    bare = word.strip(".,;:!?\"'()[]{}<>*#$%&|-_")
    return [] if not bare else [bare, bare[:BEGINNING] + "*"] if len(bare) > BEGINNING else [bare]


def amount(n: np.ndarray) -> np.ndarray:
    """What n occurrences of a feature weigh: the first is 1, more of them ever less."""
    return 1 + np.log(n)


def _batch_features(texts: pa.Array, vocabulary: dict[str, int] | None) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    words, codes, bounds = word_codes(texts)
    each = [features_of(w) for w in words.to_pylist()]
    if vocabulary is not None:
        each = [[f for f in fs if f in vocabulary] for fs in each]
    return each, codes, bounds


def counts(texts: pa.Array, vocabulary: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the places of its features in the vocabulary and how often each occurs."""
    each, codes, bounds = _batch_features(texts, vocabulary)
    some = np.array([bool(x) for x in each], bool)
    hit = some[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(hit)])
    kept = codes[hit].tolist()
    out = []
    for a, b in zip(before[bounds[:-1]].tolist(), before[bounds[1:]].tolist()):
        at = np.array([vocabulary[f] for c in kept[a:b] for f in each[c]], np.int64)
        out.append(np.unique(at, return_counts=True))
    return out


@dataclass(frozen=True)
class Severity:
    vocabulary: dict[str, int]
    weight: np.ndarray
    theta: np.ndarray

    def above(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(severity > k) for each row and k."""
        z = np.array([float(self.weight[at] @ amount(n)) for at, n in rows])
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - z[:, None], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, width: int, steps: int = 1500, ridge: float = 1e-5, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by gradient steps of adaptive size.

    The log likelihood of grade g is log(P(> g-1) - P(> g)).
    """
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(at) for at, _ in rows])
    col = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in rows)])
    val = np.concatenate([np.zeros(0), *(amount(c) for _, c in rows)])
    k = GRADES - 1
    # theta_0, then the logarithms of the gaps, keeps the thresholds ascending.
    param = np.concatenate([np.zeros(width), [2.0], np.zeros(k - 1)])
    m, v = np.zeros_like(param), np.zeros_like(param)
    hot = np.zeros((n, GRADES))
    hot[np.arange(n), grade] = 1
    for step in range(1, steps + 1):
        w, theta = param[:width], param[width] + np.concatenate([[0], np.cumsum(np.exp(param[width + 1 :]))])
        z = np.bincount(doc, val * w[col], n)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -500, 500)))
        edge = np.column_stack([np.ones(n), p, np.zeros(n)])
        slope = np.column_stack([np.zeros(n), p * (1 - p), np.zeros(n)])
        share = np.maximum((hot * (edge[:, :-1] - edge[:, 1:])).sum(1), 1e-12)
        lower, upper = (hot * slope[:, :-1]).sum(1) / share, (hot * slope[:, 1:]).sum(1) / share
        by_z = (lower - upper) / n
        by_theta = np.zeros(k)
        for j in range(k):
            # theta_j is the lower edge of grade j + 1 and the upper edge of grade j.
            by_theta[j] = (upper[grade == j].sum() - lower[grade == j + 1].sum()) / n
        tail = by_theta[::-1].cumsum()[::-1]
        grad = np.concatenate([np.bincount(col, val * by_z[doc], width) - ridge * w, [by_theta.sum()], tail[1:] * np.exp(param[width + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        param = param + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return param[:width], param[width] + np.concatenate([[0], np.cumsum(np.exp(param[width + 1 :]))])


def _ratio(a: np.ndarray, na: float, b: np.ndarray, nb: float) -> np.ndarray:
    """Log-likelihood ratio of a of na against b of nb."""

    def part(x, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / (n * p)), 0) + np.where(n - x > 0, (n - x) * np.log(np.where(n - x > 0, n - x, 1) / (n * (1 - p) + 1e-12)), 0)

    p = (a + b) / (na + nb)
    return 2 * (part(a, na, p) + part(b, nb, p))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Severity:
    """Fitted on at most ``sample_rows`` labelled documents outside the held-out fold.

    The vocabulary is counted over them by Spark; at most ``VOCABULARY``
    features, and those features of the sample, reach the driver.  Without
    toxic rows the model has no features and finds nothing toxic.
    """
    some = documents_of(docs, id_col, text_col).join(F.broadcast(sample_of(labels, id_col, label_col, sample_rows)), F.col("doc_id") == F.col("s_id")).select(F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "text").cache()
    try:
        n = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        none = Severity({}, np.zeros(0), np.array([5.0, 6.0, 7.0]))
        if not n.get(1):
            return none

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    each, codes, bounds = _batch_features(part.column(1), None)
                    found, marks = [], []
                    for k, label in enumerate(part.column(0).to_pylist()):
                        own = {f for c in np.unique(codes[bounds[k] : bounds[k + 1]]).tolist() for f in each[c]}
                        found += own
                        marks += [label] * len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["f", "label"])

        share = n[1] / (n[1] + n.get(0, 0))
        tally = some.mapInArrow(distinct, "f string, label int").groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("toxic")).where((F.col("df") >= LEAST_DOCS) & (F.col("toxic") > share * F.col("df")))
        # The commonest among toxic rows first; far more than can pass the ratio.
        top = tally.orderBy(F.desc(F.col("toxic") / F.sqrt("df")), "f").limit(10 * VOCABULARY).toPandas()
        a = top["toxic"].to_numpy(float)
        ratio = _ratio(a, n[1], top["df"].to_numpy(float) - a, max(n.get(0, 0), 1))
        chosen = sorted(zip(-ratio, top["f"]))[:VOCABULARY]
        vocabulary = {f: i for i, f in enumerate(sorted(f for r, f in chosen if -r >= LEAST_RATIO))}

        def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    rows = counts(part.column(1), vocabulary)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x, _ in rows], pa.list_(pa.int64())), pa.array([x.tolist() for _, x in rows], pa.list_(pa.int64()))], names=["label", "at", "n"])

        pdf = some.mapInArrow(sparse, "label int, at array<long>, n array<long>").toPandas()
    finally:
        some.unpersist()
    rows = sorted((int(label), tuple(at), tuple(c)) for label, at, c in zip(pdf["label"], pdf["at"], pdf["n"]))
    label = np.array([r[0] for r in rows])
    pairs = [(np.array(at, np.int64), np.array(c, np.int64)) for _, at, c in rows]
    much = np.array([amount(c).sum() for _, c in pairs])
    grade = np.zeros(len(rows), np.int64)
    cuts = np.quantile(much[label == 1], [1 / 3, 2 / 3])
    grade[label == 1] = 1 + np.searchsorted(cuts, much[label == 1], "left")
    weight, theta = fit(pairs, grade, len(vocabulary))
    return Severity(vocabulary, weight, theta)


def score_documents(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``expected_severity`` (0 to 3), ``grade`` (the likeliest), ``p_toxic`` and ``predicted`` (1 if ``p_toxic`` reaches ``threshold``).

    Null or empty text has no features and gets what the thresholds alone say.
    Rows are scored one by one, so repeated rows, ties and null ids need no
    rule; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                above = held.value.above(counts(part.column(1), held.value.vocabulary))
                edge = np.column_stack([np.ones(len(above)), above, np.zeros(len(above))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(1)), pa.array((edge[:, :-1] - edge[:, 1:]).argmax(1).astype(np.int32)), pa.array(above[:, 0])], names=["doc_id", "expected_severity", "grade", "p_toxic"])

    scored = documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_severity", "grade", "p_toxic", (F.col("p_toxic") >= threshold).cast("int").alias("predicted"))
