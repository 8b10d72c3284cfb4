"""Embedding whitening with exact cross-products from bit-sliced vectors.

Entries become whole numbers. Each distinct whole vector is shifted to be non-negative and taken apart into
bit planes: plane ``b`` of a dimension packs bit ``b`` of 64 rows into one word. The cross-product of two
dimensions is the sum over their planes of 2^(a+b) times the set bits of the planes' AND, so it is exact;
one more plane of ones gives the count and the sums alike. Tasks add up their blocks, Spark adds up the
tasks, and what reaches the driver is one number per pair of dimensions, whatever the rows. The driver
centres these whole numbers (n C - S S'), divides once, and takes eigenvectors.

Defined results: rows whose vector is NULL, empty, or holds NULL or non-finite entries are dropped, and so are
vectors of another length than the commonest (of equally common ones the longer) or with entries of 2^34 or
more in size; a NULL id stays NULL; repeated rows give rows each, but count once in the fit list; a component
without variance (one vector, dimensions that follow from others) has a NULL ``whitened`` and is left out of
``identity_error``; without any rows there is no result; fewer dimensions than ``components`` give fewer
components; ``deviation`` is NULL beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, named

SCALE, OFFSET = 64, 1_000_000
#: Entries must stay below this after scaling, so that sums of products fit 38 digits.
MOST = float(1 << 40)
#: Bits of a value up to which the products of one block fit 63 bits.
_SAFE_BITS = 25
_SPLIT = 40


@dataclass(frozen=True)
class Whitening:
    """Components of a fit list; its size depends on the dimensions only."""

    n: int
    sums: list[int]
    shift: list[int]
    reach: int  # largest difference between two values of a dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column per component
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, x array<long>)`` of the usable rows."""
    entries = F.col("vector")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < MOST))
    rows = rows.select(named(rows, id_col).alias("vec_id"), named(rows, vec_col).alias("vector"))
    rows = rows.where(entries.isNotNull() & (F.size(entries) > 0) & fine)
    common = rows.groupBy(F.size(entries).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(entries) == (common.d if common else 0))
    return rows.select("vec_id", F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    size = max(64, min(4096, (1 << 22) // d))
    for batch in batches:
        x = _matrix(batch.column(0), d)
        for at in range(0, len(x), size):
            yield x[at : at + size]


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """``planes[dimension, bit, word]`` of non-negative whole numbers ``y[row, dimension]``; 64 rows to a word."""
    rows, d = y.shape
    y = np.pad(y, ((0, -rows % 64), (0, 0))).T
    packed = np.stack([np.packbits(((y >> b) & 1).astype(np.uint8), axis=1) for b in range(bits)], axis=1)
    return np.ascontiguousarray(packed).view(np.uint64)


def cross_products(planes: np.ndarray) -> Iterator[np.ndarray]:
    """For each dimension its exact cross-products with itself and all later ones."""
    d, bits, _ = planes.shape
    weights = np.array([1 << b for b in range(bits)], np.int64 if bits <= _SAFE_BITS else object)
    for i in range(d):
        row = np.zeros(d - i, weights.dtype)
        for a in range(bits):
            if planes[i, a].any():
                both = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
                row = row + (both.astype(weights.dtype) @ weights) * weights[a]
        yield row


def _bounds(d: int):
    def run(batches):
        low = high = None
        for x in _blocks(batches, d):
            lo, hi = x.min(axis=0), x.max(axis=0)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(low), pa.array(high)], ["i", "low", "high"])

    return run


def _scatter(d: int, shift: np.ndarray, bits: int):
    def out(i: int, row: np.ndarray) -> pa.RecordBatch:
        hi, lo = (row >> _SPLIT).astype(np.int64), (row & ((1 << _SPLIT) - 1)).astype(np.int64)
        j = np.arange(i, i + len(row), dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int32)), pa.array(j), pa.array(hi), pa.array(lo)], ["i", "j", "hi", "lo"])

    def run(batches):
        total, held = None, 0
        for x in _blocks(batches, d):
            ones = np.ones((len(x), 1), np.int64)  # dimension 0 counts, and sums the others
            rows = list(cross_products(bit_planes(np.hstack([ones, x - shift]), bits)))
            if total is not None and bits <= _SAFE_BITS and (held + len(x)) << (2 * bits) >= 1 << 62:
                yield from (out(i, row) for i, row in enumerate(total))
                total, held = None, 0
            total = rows if total is None else [p + q for p, q in zip(total, rows)]
            held += len(x)
        yield from (out(i, row) for i, row in enumerate(total or ()))

    return run


def fit(fit_list: DataFrame) -> Whitening | None:
    """Components of ``fit_list(x array<long>)``, distinct vectors of one length; None without rows."""
    first = fit_list.first()
    if first is None:
        return None
    d = len(first.x)
    bounds = fit_list.mapInArrow(_bounds(d), "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = sorted(bounds.collect())
    shift, reach = [r.low for r in bounds], max(r.high - r.low for r in bounds)
    parts = fit_list.mapInArrow(_scatter(d, np.array(shift, np.int64), max(1, reach.bit_length())), "i int, j int, hi long, lo long")
    wide = "decimal(38,0)"
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("hi").cast(wide)).alias("hi"), F.sum(F.col("lo").cast(wide)).alias("lo")).collect()
    c = {(r.i, r.j): (int(r.hi) << _SPLIT) + int(r.lo) for r in sums}
    n, s = c[0, 0], [c[0, i] for i in range(1, d + 1)]
    v = np.zeros((d, d))
    trace = 0
    for i in range(d):
        for j in range(i, d):
            centred = n * c[i + 1, j + 1] - s[i] * s[j]
            trace += centred if i == j else 0
            v[i, j] = v[j, i] = centred / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, [a + n * b for a, b in zip(s, shift)], shift, reach, values, vectors, trace / (n * n))


def _centred(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n x - S, exact; Python numbers where 62 bits might not do."""
    rest = [s - model.n * b for s, b in zip(model.sums, model.shift)]
    kind = np.int64 if model.n * max(1, model.reach) < 1 << 62 else object
    return (x - np.array(model.shift, np.int64)).astype(kind) * model.n - np.array(rest, kind)


def _whitened(model: Whitening, centred: np.ndarray, components: int) -> np.ndarray:
    k = np.flatnonzero(model.usable[:components])
    return (centred.astype(float) / model.n) @ (model.vectors[:, k] / np.sqrt(model.values[k]))


def identity_error(fit_list: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest entry of (covariance of the whitened fit list - identity), centred before multiplying."""
    d, k = len(model.sums), int(model.usable[:components].sum())
    if not k:
        return None

    def added(value):
        def run(batches):
            total = np.zeros((k, k))
            for x in _blocks(batches, d):
                total += value(_whitened(model, _centred(model, x), components))
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["at", "v"])

        rows = fit_list.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(rows)]).reshape(k, k) / model.n

    mean = added(lambda w: np.broadcast_to(w.sum(axis=0), (k, k)))[0]
    return float(np.abs(added(lambda w: (w - mean).T @ (w - mean)) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row per usable row and component: ``vec_id, component, n, deviation decimal, whitened, explained, identity_error``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    whole = scratch.put(whole_vectors(rows, id_col, vec_col), "whole")
    fit_list = scratch.put(whole.select("x").distinct(), "fit")
    model = fit(fit_list)
    id_type = whole.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(fit_list, model, components)
    d, m = len(model.sums), min(components, len(model.sums))
    explained = model.values[:m] / model.trace if model.trace > 0 else np.zeros(m)
    small = d * (model.n * max(1, model.reach)) ** 2 < 1 << 63

    def project(batches):
        size = max(1, (1 << 22) // max(d, m))
        for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            centred = _centred(model, _matrix(batch.column(1), d))
            white = np.full((len(centred), m), np.nan)
            white[:, np.flatnonzero(model.usable[:m])] = _whitened(model, centred, m)
            if small:
                deviation = pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in centred]
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            count = len(centred)
            each = pa.array(np.repeat(np.arange(count), m))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, model.n)),
                deviation.take(each), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, count)),
                pa.array([error] * (count * m), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, schema)
