"""A full merge hands its pairs on one by one."""

from __future__ import annotations

from itertools import product

from tablesteps.operators.joins import merge_by


def test_full_merge_without_full_outer_join(spark):
    a = [(None, 1), (None, 2), (1, 3), (2, 4), (2, 5)]
    b = [(None, 6), (None, 7), (2, 8), (2, 9), (3, 10)]
    left, right = spark.createDataFrame(a, "k INT, x INT"), spark.createDataFrame(b, "k INT, y INT")
    out = merge_by(left, right, ["k"], in_=("in_a", "in_b"))
    want = [(k, x, y, True, True) for (k, x), (j, y) in product(a, b) if k == j]
    want += [(1, 3, None, True, False), (3, None, 10, False, True)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    # a full outer sort-merge join holds all pairs of one key in memory
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
