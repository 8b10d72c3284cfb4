import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesteps.llm import whitening
from tablesteps.llm.queries import op11_whitening
from tests.llm.conftest import TABLES


def brute(vectors, components=16):
    """The contract with Python's whole numbers: n, deviations, whitened (rows, components), explained."""
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3 for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    centred = [[n * c - t for c, t in zip(v, s)] for v in x]
    deviation = [sum(c * c for c in v) for v in centred]
    return n, deviation, np.array(centred, float) / n @ vecs / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(cov)


def frame(spark, vectors, **more):
    rows = [(k, v) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def check(result, vectors, components=16):
    n, deviation, white, explained = brute(vectors, components)
    got = {(r.vec_id, r.component): r for r in result.collect()}
    m = min(components, len(vectors[0]))
    assert len(got) == len(vectors) * m
    w = np.array([[got[k, c + 1].whitened for c in range(m)] for k in range(len(vectors))], float)
    sign = np.sign((w * white).sum(axis=0))
    assert np.abs(w * sign - white).max() < 1e-6
    assert [int(got[k, 1].deviation) for k in range(len(vectors))] == deviation
    assert {r.n for r in got.values()} == {n}
    assert np.allclose([got[0, c + 1].explained for c in range(m)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got.values()}) == 1 and next(iter(got.values())).identity_error < 1e-6


def test_query_against_brute(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    out = op11_whitening(spark, TABLES)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["n"] == "bigint"
    check(out, [r.embedding for r in rows])


def test_repeats_and_large_entries(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 5)) * [1, 50, 1e4, 0.1, 3]).astype(np.float32).tolist()
    vectors += [vectors[0]] * 70
    check(whitening.whiten(frame(spark, vectors, n=1, x="x", component="c")), vectors)
    big = (rng.normal(size=(40, 3)) * [1e9, 1e6, 1e9]).astype(np.float32).tolist()  # beyond 25 bits
    check(whitening.whiten(frame(spark, big)), big)


def test_dropped_rows_and_nulls(spark):
    good = np.random.default_rng(1).normal(size=(30, 3)).astype(np.float32).tolist()
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    df = frame(spark, good).unionByName(spark.createDataFrame([(100 + k, v) for k, v in enumerate(bad)], "vec_id long, embedding array<float>"))
    check(whitening.whiten(df), good)
    lost = spark.createDataFrame([(None, good[0]), (1, good[1]), (1, good[1])], "vec_id long, embedding array<float>")
    out = whitening.whiten(lost).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted([(0, c) for c in (1, 2, 3)] + [(1, c) for c in (1, 1, 2, 2, 3, 3)])
    # two distinct vectors span one component
    assert all((r.whitened is None) == (r.component > 1) for r in out)


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_one_vector(spark, vectors):
    out = whitening.whiten(frame(spark, vectors)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, None, 0.0, None)] * (2 * len(vectors))


def test_empty(spark):
    out = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_planes():
    y = np.random.default_rng(0).integers(0, 1 << 12, (200, 4))
    rows = list(whitening.cross_products(whitening.bit_planes(y, 12)))
    want = y.T @ y
    assert all((row == want[i, i:]).all() for i, row in enumerate(rows))
