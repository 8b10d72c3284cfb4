"""Positional pairing by runs against two sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from tablesteps.operators import reconcile as R
from tablesteps.operators import runs


def face(rows_r, rows_g):
    key = lambda row: tuple((c is None, c if c is not None else 0) for c in row)
    a, b = sorted(rows_r, key=key), sorted(rows_g, key=key)
    out = {}
    for pair in zip(a, b):
        out[pair] = out.get(pair, 0) + 1
    return out, abs(len(a) - len(b))


@pytest.mark.parametrize("block", [3, 50, 100_000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_sorted_lists(spark, monkeypatch, block, seed):
    monkeypatch.setattr(runs, "BLOCK", block)
    rng = random.Random(seed)
    some = [None, *"abcdefgh"]
    ref = [(rng.choice(some), rng.choice([None, 1, 2, 3])) for _ in range(300)] + [("d", 2)] * 150
    gen = [r if rng.random() < 0.9 else (rng.choice(some), 9) for r in ref][: 450 - 7 * seed]
    schema = "k STRING, x INT"
    left, right = (spark.createDataFrame(x, schema).repartition(5) for x in (ref, gen))
    got, beyond = {}, None
    for row in runs.face_to_face(left, right, ["k", "x"]).collect():
        if row["_both"]:
            pair = ((row["r_k"], row["r_x"]), (row["g_k"], row["g_x"]))
            got[pair] = got.get(pair, 0) + row["_w"]
        else:
            assert beyond is None
            beyond = row["_w"]
    assert (got, beyond) == face(ref, gen)


def test_equal_tables_are_not_sorted(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"))
    assert runs.face_to_face(rows, rows.repartition(3), ["k"]) is None
    assert R.compare_values(rows, rows).collect() == []


def test_one_side_empty(spark):
    rows = spark.range(10).select(F.col("id").alias("k"))
    for ref, gen in ((rows, rows.limit(0)), (rows.limit(0), rows)):
        assert [(r.kind, r.rows_affected) for r in R.compare_values(ref, gen).collect()] == [("surplus_rows", 10)]


def test_a_hot_row_is_cut_into_blocks(spark, monkeypatch):
    """A third of the rows are equal; they face rows one place off, a block at a time."""
    monkeypatch.setattr(runs, "BLOCK", 1000)
    ref = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 15_000).otherwise(F.col("id")).alias("k"))
    gen = ref.filter("k <> 1").unionByName(spark.range(1).select(F.lit(99_999).cast("long").alias("k")))
    placed = runs.placed(runs.row_runs(ref, gen), ["k"])
    cut = runs._cut(placed.withColumn("_row", F.struct("k")), "_r", "_rs").groupBy("_block").count()
    assert cut.agg(F.max("count")).first()[0] <= 1000 and cut.count() == 30
    a, b = (sorted(r.k for r in d.collect()) for d in (ref, gen))
    got = R.compare_values(ref, gen).first()
    assert got.rows_affected == sum(x != y for x, y in zip(a, b)) and got.max_diff == max(abs(x - y) for x, y in zip(a, b))
    assert got.mean_diff == pytest.approx(sum(abs(x - y) for x, y in zip(a, b)) / len(a))
