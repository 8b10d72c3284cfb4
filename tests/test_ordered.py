"""Ordered operators: the chunked plan for hot or missing groups equals the window plan and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tablesteps.operators import joins as J
from tablesteps.operators import ordered as O
from tablesteps.operators import procs as P
from tests.conftest import rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    out = []
    for i in range(900):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        value = None if rng.random() < 0.3 else rng.randrange(50)
        out.append((key, rng.randrange(60), i, value))
    return out


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k STRING, t INT, i INT, v INT").repartition(5).cache()


ORDER = ["t", "i"]


def groups(data):
    by = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def expected(data, fn):
    return {r[2]: x for rows_ in groups(data).values() for r, x in zip(rows_, fn(rows_), strict=True)}


def running(rs):
    total, out = 0, []
    for r in rs:
        total += r[3] or 0
        out.append(total)
    return out


def kept(rs):
    last, out = None, []
    for r in rs:
        last = r[3] if r[3] is not None else last
        out.append(last)
    return out


def lagged(n):
    return lambda rs: [rs[j - n][3] if j >= n else None for j in range(len(rs))]


CASES = {
    "counter": (lambda d: O.row_counter(d, ORDER, by=["k"], name="x"), lambda rs: list(range(1, len(rs) + 1))),
    "first": (lambda d: O.first_last(d, ["k"], ORDER).withColumn("x", F.col("first")), lambda rs: [j == 0 for j in range(len(rs))]),
    "last": (lambda d: O.first_last(d, ["k"], ORDER).withColumn("x", F.col("last")), lambda rs: [j == len(rs) - 1 for j in range(len(rs))]),
    "sum": (lambda d: O.retain_sum(d, ["k"], "v", ORDER, name="x"), running),
    "sum_before": (lambda d: O.retain_sum(d, ["k"], "v", ORDER, name="x", exclusive=True), lambda rs: [0, *running(rs)[:-1]]),
    "retain": (lambda d: O.retain_last(d, ["k"], "v", ORDER, name="x"), kept),
    "lag1": (lambda d: O.lag_n(d, ["k"], "v", ORDER, 1, "x"), lagged(1)),
    "lag7": (lambda d: O.lag_n(d, ["k"], "v", ORDER, 7, "x"), lagged(7)),
    "lag300": (lambda d: O.lag_n(d, ["k"], "v", ORDER, 300, "x"), lagged(300)),
}


@pytest.mark.parametrize("case", CASES)
def test_window_plan(table, data, case):
    run, fn = CASES[case]
    assert {r["i"]: r["x"] for r in run(table).collect()} == expected(data, fn)


@pytest.mark.parametrize("case", CASES)
def test_chunk_plan(table, data, hot, case):
    run, fn = CASES[case]
    assert {r["i"]: r["x"] for r in run(table).collect()} == expected(data, fn)


def test_global_order(table, data):
    got = {r["i"]: r["n"] for r in O.row_counter(table, ORDER, name="n").collect()}
    want = {r[2]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])), 1)}
    assert got == want
    lag = {r["i"]: r["x"] for r in O.lag_n(table, None, "v", ORDER, 2, "x").collect()}
    flat = sorted(data, key=lambda r: (r[1], r[2]))
    assert lag == {r[2]: (flat[j - 2][3] if j >= 2 else None) for j, r in enumerate(flat)}


def test_descending_counter(table, data, hot):
    got = {r["i"]: r["n"] for r in O.row_counter(table, ORDER, by=["k"], name="n", desc=["t"]).collect()}
    want = {}
    for rs in groups(data).values():
        for n, r in enumerate(sorted(rs, key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_pick_rows_breaks_ties_with_other_columns(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("b", 2, 2)], "k STRING, t INT, z INT")
    assert rows(O.pick_rows(df, ["k"], ["t"])) == [("a", 1, 3), ("b", 2, 2)]
    assert rows(O.last_per_group(df, ["k"], ["t"])) == [("a", 1, 9), ("b", 2, 2)]


def test_rank_in_a_hot_group(table, data, hot):
    got = {r["i"]: r["x"] for r in P.proc_rank(table, "v", ["k"], ties="low", name="x").collect()}
    want = {}
    for rs in groups(data).values():
        values = sorted(r[3] for r in rs if r[3] is not None)
        for r in rs:
            want[r[2]] = None if r[3] is None else float(values.index(r[3]) + 1)
    assert got == want


@pytest.mark.parametrize("keep", ["all", "both", "left", "right", "left_only", "right_only"])
def test_merge_same_with_hot_keys(spark, keep, request):
    left = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4), (4, 5), *[(9, n) for n in range(12)]], "k INT, a INT")
    right = spark.createDataFrame([(None, 1), (None, 2), (1, 7), (3, 8), (9, 0)], "k INT, b INT")
    plain = rows(J.merge_by(left, right, ["k"], keep=keep, in_=("x", "y")))
    request.getfixturevalue("hot")
    assert rows(J.merge_by(left, right, ["k"], keep=keep, in_=("x", "y"))) == plain
    if keep == "all":
        assert len(plain) == 2 + 2 + 1 + 1 + 1 + 12


def test_empty_input(table, hot):
    none = table.filter("1 = 0")
    for run, _ in CASES.values():
        assert run(none).count() == 0
    assert O.row_counter(none, ORDER).count() == 0


def test_scratch_scope_removes_staged_tables(spark):
    from pathlib import Path

    from tablesteps.session import scratch_dir, scratch_scope

    folder = Path(scratch_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    with scratch_scope(spark):
        out = O.row_counter(spark.range(50).withColumnRenamed("id", "v"), ["v"]).count()
        during = {p.name for p in folder.iterdir()} - before
    assert out == 50 and during and {p.name for p in folder.iterdir()} == before
