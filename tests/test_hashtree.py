"""Differing key ranges against row-by-row comparison, and how little is read for one changed row."""

import random

import pytest
from pyspark.sql import functions as F

from tablesteps.operators import hashtree
from tablesteps.operators.reconcile import reconcile_periods


def plain(rows):
    return [{"k": F.col("k").cast("decimal(38,0)") if dict(d.dtypes)["k"] != "string" else F.col("k"), "v": F.col("v")} for d in rows]


@pytest.mark.parametrize("kind", ["INT", "STRING"])
def test_ranges_hold_every_difference(spark, kind):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), None if k % 50 == 0 else (k if kind == "INT" else f"k{k}"), rng.choice([None, 1.0, 2.0])) for k in range(3000)]
    changed = list(rows)
    for at in rng.sample(range(3000), 6):
        changed[at] = (*rows[at][:2], 9.0)
    del changed[17]
    changed.append(("z", -5 if kind == "INT" else "new", 1.0))
    ref, gen = (spark.createDataFrame(x, f"p STRING, k {kind}, v DOUBLE") for x in (rows, changed))
    left = hashtree.differing_rows(ref, gen, F.coalesce("p", F.lit("<null>")), ["k"], plain((ref, gen)))
    want = [sorted(set(a) - set(b), key=str) for a, b in ((rows, changed), (changed, rows))]
    for part, lost in zip(left, want):
        kept = [tuple(r) for r in part.collect()]
        assert set(lost) <= set(kept) and len(kept) < 700


def test_equal_sides_leave_nothing(spark):
    ref = spark.range(1000).select(F.lit("p").alias("p"), F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for side in hashtree.differing_rows(ref, ref.repartition(5), F.col("p"), ["k"], plain((ref, ref))):
        assert side.count() == 0


@pytest.mark.parametrize("low", [-(2**63), 0, 5])
def test_bounds_of_keys(spark, low):
    keys = [low, low + 1, 7, 2**63 - 1, None]
    ref = spark.createDataFrame([("p", k, 1.0) for k in keys], "p STRING, k LONG, v DOUBLE")
    for k in keys:
        gen = ref.withColumn("v", F.when(F.col("k").eqNullSafe(F.lit(k).cast("long")), 2.0).otherwise(F.col("v")))
        sides = hashtree.differing_rows(ref, gen, F.col("p"), ["k"], plain((ref, gen)))
        assert all(k in [r.k for r in s.collect()] for s in sides)


def test_merged_filters_still_cover(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "FILTERS", 3)
    ranges = hashtree.KeyRanges("k", 0, 256 * 10)
    cond = ranges.filter([1, 2, 9, 50, 51, 200, 255], 1)
    kept = {r.k for r in spark.range(2560).withColumnRenamed("id", "k").filter(cond).collect()}
    assert {k for n in (1, 2, 9, 50, 51, 200, 255) for k in range(10 * n, 10 * n + 10)} <= kept and len(kept) < 1500


def read_rows(df):
    """Rows that the scan of a frame gave out; without adaptive execution, so that the plan is the one that ran."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        counts = [leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())]
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")
    return max(counts)


def test_one_changed_row_of_many(spark, tmp_path):
    """After the hash pass, less than one row in a hundred is read where files are in key order."""
    n = 400_000
    made = spark.range(n).select(F.lit("2024").alias("p"), F.col("id").alias("k"), F.rand(1).alias("v"))
    made.sort("k").write.option("parquet.block.size", 64 * 1024).option("parquet.page.size", 8 * 1024).parquet(str(tmp_path / "ref"))
    spark.read.parquet(str(tmp_path / "ref")).withColumn("v", F.when(F.col("k") == 123_456, -1.0).otherwise(F.col("v"))).write.option(
        "parquet.block.size", 64 * 1024
    ).parquet(str(tmp_path / "gen"))
    ref, gen = (spark.read.parquet(str(tmp_path / x)) for x in ("ref", "gen"))
    sides = hashtree.differing_rows(ref, gen, F.col("p"), ["k"], plain((ref, gen)))
    assert [s.filter("k = 123456").count() for s in sides] == [1, 1]
    for side in sides:
        assert side.count() <= n / 2**15
        assert read_rows(side) < n / 100
    assert {r.p: r.status for r in reconcile_periods(ref, gen, "p", ["k"]).collect()} == {"2024": "FAIL"}
    assert reconcile_periods(ref, ref, "p", ["k"]).first().status == "PASS"
