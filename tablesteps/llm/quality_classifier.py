"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One pass over the texts gives a short vector of statistics per document. Class means and covariances are
sums over all labelled rows of the training folds, made by Spark's own aggregates; each covariance is
shrunk towards the pooled one and its diagonal. The Cholesky factors are made once on the driver (a few
numbers) and every document gets the difference of the two Mahalanobis log densities.

Defined results: a NULL or empty text has the statistics of no words and is scored like any other; a NULL
label does not train; a NULL id joins no label and counts as the empty text in the fold; with only one class, or none, to learn from every score
is that class' share (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, named, texts

STATISTICS = (
    "log_words", "word_length", "distinct_share", "next_repeats", "line_repeats", "upper_share", "digit_share",
    "symbol_words", "shout_words", "bar_words", "mark_share", "line_words", "line_ends",
)
_SYMBOLS, _MARKS = b"#*$%&<>=~^_{}\\", b".,;:!?'\"()"


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; shares are on a square-root scale."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[128:].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines)
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
    shares = [
        len(numbers) / n, float((at[1:] == at[:-1]).sum()) / n, 1 - len(set(lines)) / max(1, len(lines)), bytes_[65:91].sum() / letters,
        bytes_[48:58].sum() / max(1, len(raw)), min(1.0, bytes_[list(_SYMBOLS)].sum() / n / 3), min(1.0, raw.count(b"!!") / n),
        min(1.0, bytes_[124] / n), min(1.0, bytes_[list(_MARKS)].sum() / n),
    ]
    return [
        float(np.log1p(len(words))), float(np.log1p(len(raw) / n)), *map(float, np.sqrt(shares)),
        float(np.log1p(len(words) / max(1, len(lines)))), float(np.sqrt(ends / max(1, len(lines)))),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x array<double>`` for every row."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray], shrink: float, ridge: float):
        total = sum(counts)
        self.share = (counts[1] / total) if total else 0.5
        self.single = min(counts) < 2
        if self.single:
            return
        means = [s / c for s, c in zip(sums, counts)]
        spreads = [q / c - np.outer(m, m) for q, c, m in zip(squares, counts, means)]
        pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / total
        floor = np.diag(np.diag(pooled) + 1e-6)
        self.parts = []
        for mean, spread, count in zip(means, spreads, counts):
            mixed = (1 - shrink) * spread + shrink * pooled
            factor = np.linalg.cholesky((1 - ridge) * mixed + ridge * floor)
            self.parts.append((mean, np.linalg.inv(factor), -2 * np.log(np.diag(factor)).sum() + 2 * np.log(count / total)))

    def scores(self, x: np.ndarray, temper: float) -> np.ndarray:
        if self.single:
            return np.full(len(x), self.share)
        dense = [bias - (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, bias in self.parts]
        return 1 / (1 + np.exp(-np.clip((dense[1] - dense[0]) / 2 / temper, -30, 30)))


def fit(measured: DataFrame, labels: DataFrame, training: Column, label_col: str, id_col: str = "doc_id", shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Learns from all labelled rows for which ``training``, a condition on ``doc_id``, holds."""
    known = labels.select(named(labels, id_col).alias("doc_id"), named(labels, label_col).cast("int").alias("label"))
    known = known.where(training & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    size = len(STATISTICS)
    pairs = list(combinations_with_replacement(range(size), 2))
    x = [F.col("x")[i] for i in range(size)]
    sums = measured.join(known, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("q")
    )
    by = {r.label: r for r in sums.collect()}
    counts, first, second = [], [], []
    for label in (0, 1):
        counts.append(float(by[label].n) if label in by else 0.0)
        first.append(np.array(by[label].s) if label in by else np.zeros(size))
        square = np.zeros((size, size))
        if label in by:
            for (i, j), v in zip(pairs, by[label].q):
                square[i, j] = square[j, i] = v
        second.append(square)
    return Discriminant(counts, first, second, shrink, ridge)


def score(measured: DataFrame, model: Discriminant, temper: float = 1.0) -> DataFrame:
    """``doc_id, score`` for every row of ``measured``."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x, temper))], ["doc_id", "score"])

    return measured.mapInArrow(run, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: measures the texts once, learns, and scores every row."""
    measured = Scratch(docs.sparkSession, "quality").put(measure(docs, id_col, text_col), "statistics")
    return score(measured, fit(measured, labels, training, label_col, id_col))
