import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesteps.llm import embedding_dedup
from tablesteps.llm.queries import op12_embedding_dedup
from tests.llm.conftest import TABLES


def brute(ids, vectors, least=0.9):
    """Links per row, component of each row as its smallest id."""
    v = np.array(vectors, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= least
    root = np.arange(len(v))
    for k in range(len(v)):
        stack = [k] if root[k] == k else []
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(near[x] & (root > k)):
                root[y] = k
                stack.append(y)
    low = {r: min(ids[k] for k in np.flatnonzero(root == r)) for r in set(root.tolist())}
    return near.sum(axis=1) - 1, [low[r] for r in root.tolist()]


def frame(spark, vectors):
    return spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)


def told(df):
    rows = df.collect()
    assert [r.kept for r in rows] == [r.vec_id is not None and r.vec_id == r.component_id for r in rows]
    return sorted((r.vec_id, r.n_links, r.component_id) for r in rows)


def test_query_against_brute(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").orderBy("vec_id").collect()
    links, roots = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert told(op12_embedding_dedup(spark, TABLES)) == [(r.vec_id, n, c) for r, n, c in zip(rows, links, roots)]


def planted(rng, d=32, shift=0.0):
    """Clusters of every size and width, chains, copies and scaled copies among random vectors."""
    free = rng.normal(size=(1200, d)) + shift
    out = [free]
    for k in range(40):
        for noise in (0.02, 0.1, 0.3):
            out.append(free[k] + noise * np.linalg.norm(free[k]) / d**0.5 * rng.normal(size=(1 + k % 7, d)))
    out.append(free[50] + 0.1 * rng.normal(size=(300, d)))  # a large group of near copies
    out += [free[:20], 3.5 * free[20:40], np.repeat(free[60:61], 100, axis=0)]
    return np.vstack(out).astype(np.float32)


@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_recall_and_precision(spark, monkeypatch, shift):
    monkeypatch.setattr(embedding_dedup, "SHARD", 256)
    monkeypatch.setattr(embedding_dedup, "PART", 300)
    vectors = planted(np.random.default_rng(4), shift=shift)
    want, _ = brute(range(len(vectors)), vectors.tolist())
    rows = sorted(embedding_dedup.near_duplicates(frame(spark, vectors.tolist())).collect())
    found = np.array([r.n_links for r in rows])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    some = want > 0
    assert (found[some] / want[some]).mean() >= 0.95
    group = {r.component_id for r in rows[60:61]} | {r.component_id for r in rows[-100:]}
    assert len(group) == 1


def test_parts_do_not_change_the_result(spark, monkeypatch):
    vectors = planted(np.random.default_rng(7))[:1700].tolist()
    whole = told(embedding_dedup.near_duplicates(frame(spark, vectors)))
    monkeypatch.setattr(embedding_dedup, "PART", 150)
    assert told(embedding_dedup.near_duplicates(frame(spark, vectors))) == whole


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 0.0]), (6, [float("nan"), 1.0, 0.0]),
        (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [1e38, 1e37, 0.0]),
        (None, None), (12, [0.0, -0.0, 1.0]), (13, [0.0, 0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("size", "cid", "vector", "low", "k1", "shard", "part"):
        df = df.withColumn(name, F.lit("extra"))
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()]
    want = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)] + [(1, 4, 1, True)] + [(2, 4, 1, False)] * 2 + [(None, 4, 1, False), (11, 4, 1, False), (None, 0, None, False)]
    want += [(12, 1, 12, True), (13, 1, 12, False)]
    assert sorted(out, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [1.0])] * 3])
def test_tiny(spark, rows):
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in out] == [(1, len(rows) - 1, 1, True)] * len(rows)
