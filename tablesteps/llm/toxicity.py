"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased and stripped of marks at both ends; a text's features are its distinct words and their
stems, pairs of neighbours and pairs with one word between, hashed. The labelled rows train on a sample of at most about
``max_rows`` rows chosen by a hash of the id. Each coordinate has its own rate; the L1 term keeps
most weights at zero, so what is sent to the tasks are the non-zero weights alone, at most ``2**bits``.

Defined results: a NULL or empty text has no features and gets the score of the intercept; a NULL label
does not train; a NULL id counts as the empty text in the fold; an empty table, or one without labels
of the training folds, gives scores of an untrained model (0.5).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import named, texts

BITS = 22
#: Bound of the training sample.
MAX_ROWS = 12_000
_REMEMBERED = 300_000
#: Bytes of the stems by which inflected words share features.
_STEMS = (5, 7)
_MARKS = bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\xc2\xab\xbb"


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a row: crc32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


class _Hashes(dict):
    """Hash of each word as it stands in a text, and of its stems."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > _REMEMBERED:
            self.clear()
        bare = word.strip(_MARKS)
        self[word] = value = (xxhash.xxh64_intdigest(bare), *[xxhash.xxh64_intdigest(bare[:k], k) for k in _STEMS])
        return value


def features(text: str | None, hashes: dict, bits: int = BITS) -> np.ndarray:
    """Hashed features of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.array(list(map(hashes.__getitem__, words)), np.uint64).reshape(len(words), 1 + len(_STEMS))
    h = each[:, 0]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    skips = h[:-2] * np.uint64(0x165667B19E3779F9) ^ h[2:] * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([each.ravel(), pairs, skips]) >> np.uint64(64 - bits)).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights of FTRL-proximal over rows (distinct features, label), and the intercept."""
    size = (1 << bits) + 1  # the last coordinate is the intercept, without L1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        limit = np.where(at == size - 1, 0.0, l1)
        return np.where(np.abs(zi) <= limit, 0.0, -(zi - np.sign(zi) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            at = np.append(at, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, label_col: str, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
    max_rows: int = MAX_ROWS, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, epochs: int = 8,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights, and the intercept. ``training`` is a condition on ``doc_id``."""
    known = labels.select(named(labels, id_col).alias("doc_id"), named(labels, label_col).cast("int").alias("label"))
    known = known.where(training & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    grain = 1 << 20
    share = min(grain, max_rows * grain // max(1, total))
    # about max_rows rows of two numbers: small enough to send to every task
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(grain)) < share)
    joined = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def extract(batches):
        hashes = _Hashes()
        for batch in batches:
            rows = [np.unique(features(x.as_py(), hashes, bits)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "at"])

    def learn(batches):
        rows = [(np.asarray(at, np.int64), y, i) for b in batches for i, y, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.values.to_numpy() for x in b.column(2)))]
        rows.sort(key=lambda r: (r[2], len(r[0])))  # the order of arrival must not matter
        w, bias = train([r[:2] for r in rows], bits, alpha, beta, l1, l2, epochs) if rows else (np.zeros(1), 0.0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int32())), pa.array([w[at]], pa.list_(pa.float64())), pa.array([bias])], ["at", "w", "bias"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    sample = joined.mapInArrow(extract, f"doc_id {kind}, label int, at array<int>")
    model = sample.repartition(1).mapInArrow(learn, "at array<int>, w array<double>, bias double").collect()
    if not model:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(model[0].at, np.int64), np.array(model[0].w), model[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    at, w, bias = model
    rows = texts(docs, id_col, text_col)

    def run(batches):
        hashes, dense = _Hashes(), np.zeros(1 << bits, np.float32)
        dense[at] = w
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = features(text.as_py(), hashes, bits)
                found = np.unique(found[dense[found] != 0])
                out.append(1 / (1 + np.exp(-np.clip(bias + dense[found].sum(dtype=np.float64), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
