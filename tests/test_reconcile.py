import pytest
from pyspark.sql import functions as F

from tablesteps.operators import profile as Q
from tablesteps.operators import reconcile as R


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def status(ref, gen, **kw):
    return R.overall_status(R.reconcile(ref, gen, **kw)).first()[0]


@pytest.mark.parametrize("keys", [None, ["K"]])
def test_outcomes(spark, keys):
    ref = table(spark, [("a", 2.0), ("b", 3.0), ("c", None)], "K STRING, MONTO DOUBLE")

    def gen(rows, schema="K STRING, MONTO DOUBLE"):
        return status(ref, table(spark, rows, schema), keys=keys)

    assert gen([("c", None), ("b", 3.0), ("a", 2.0)]) == "PASS"  # order and NULL on both sides
    assert gen([("a", 2.0 + 1e-9), ("b", 3.0), ("c", None)]) == "PASS"
    assert gen([("a", 2.01), ("b", 3.0), ("c", None)]) == "FAIL"
    assert gen([("A ", 2.0), ("b", 3.0), ("c", None)]) == ("PASS" if keys is None else "PASS")
    assert gen([("a", 2.0), ("b", None), ("c", 3.0)]) == "FAIL"
    assert gen([("a",), ("b",), ("c",)], "K STRING") == "FAIL"


def test_non_ascii_and_mojibake_names(spark):
    ref = table(spark, [(2024, 1.0)], "`AÃ\x91O` INT, MONTO DOUBLE")
    gen = table(spark, [(2024, 1.0)], "`AÑO` INT, `﻿MONTO` DOUBLE")
    assert status(ref, gen) == "PASS"


def test_text_dates_with_blanks(spark):
    ref = table(spark, [("2024-01-01 ", 1.0)], "F STRING, V DOUBLE")
    assert status(ref, table(spark, [("2024-01-01", 1.0)], "F STRING, V DOUBLE")) == "PASS"


def test_count_gate_stops_the_rest(spark):
    ref, gen = spark.range(1000), spark.range(998)
    tests = [r["test"] for r in R.reconcile(ref, gen).collect()]
    assert tests == ["schema", "row_count"]
    assert R.compare_counts(ref, spark.range(999)).first()["passed"]
    assert not R.compare_counts(ref, gen).first()["passed"]
    assert not R.compare_counts(spark.range(10), spark.range(9)).first()["passed"]


def test_duplicate_keys_pair_up(spark):
    ref = table(spark, [("a", 1), ("a", 2), ("b", 3)], "K STRING, V INT")
    gen = table(spark, [("a", 2), ("a", 1), ("b", 3), ("b", 4)], "K STRING, V INT")
    got = {r["kind"]: r["rows_affected"] for r in R.compare_values(ref, gen, keys=["K"]).collect()}
    assert got == {"extra_keys": 1}


def test_keyed_with_hot_key(spark, hot):
    rows = [("hot", i) for i in range(60)] + [("b", 1)]
    ref = table(spark, rows, "K STRING, V INT")
    gen = table(spark, rows[1:] + [("hot", 0)], "K STRING, V INT").repartition(6)
    assert R.compare_values(ref, gen, keys=["K"]).count() == 0


def test_majority_numeric_reports_lost_cells(spark):
    ref = table(spark, [("1",), ("2",), ("x",)], "V STRING")
    row = R.classify_columns(ref, ref).first()
    assert (row["is_numeric"], row["lost_in_ref"]) == (True, 1)


def test_sort_keys_edge(spark):
    df = spark.range(999).selectExpr("id", "id % 7 AS few", "'x' AS t")
    types = {"id": True, "few": True, "t": False}
    assert R.sort_keys(df, types) == ["few", "id", "t"]
    more = spark.range(1000).selectExpr("id", "id % 7 AS few", "'x' AS t")
    assert R.sort_keys(more, types) == ["few", "t"]
    assert R.sort_keys(more.select("id"), {"id": True}) == ["id"]


def test_causes(spark):
    ref = table(spark, [(1, "Año", "007", 1.0, 5), (2, "b", "8", 2.0, 6), (3, "c", "9", 3.0, 7)], "k INT, a STRING, b STRING, c DOUBLE, d INT")
    gen = table(spark, [(1, "ANO", "7", 1.004, 6), (2, "B", "8", 2.0, 5), (3, "c", "9", 3.0, None)], "k INT, a STRING, b STRING, c DOUBLE, d INT")
    got = {r["column"]: r["cause"] for r in R.diagnose(ref, gen, ["k"]).collect()}
    assert got["a"] == "collation" and got["b"] == "type_coercion" and got["c"] == "rounding"
    enc = table(spark, [(1, "AÃ±o", "007", 1.0, 6), (2, "b", "8", 2.0, 5)], "k INT, a STRING, b STRING, c DOUBLE, d INT")
    got = {r["column"]: (r["cause"], r["rows_affected"]) for r in R.diagnose(ref, enc, ["k"]).collect()}
    assert got["a"] == ("encoding", 1) and got["d"][0] == "row_order" and got[None] == ("missing_transform", 1)


def test_verify_tables(spark):
    spark.range(1).createOrReplaceTempView("t_have_view")
    spark.sql("CREATE DATABASE IF NOT EXISTS chk")
    conns = table(spark, [("a", "nowhere", "target", ["x"]), ("b", "chk", "source", ["y"])], "alias STRING, schema_name STRING, role STRING, tables ARRAY<STRING>")
    report = R.verify_tables(spark, conns)
    assert {r["problem"] for r in report.collect()} == {"missing_target", "missing_source"}
    assert R.verify_status(report).first()[0] == "blocked_missing_targets"
    assert R.verify_status(report.filter("role = 'source'")).first()[0] == "missing_sources"


def test_reconcile_all_modes(spark):
    df = spark.range(5)

    def broken(name):
        raise RuntimeError("no connection")

    assert R.reconcile_all(spark, {}, ["t"], lambda n: df)[1].first()["validation_mode"] == "not_applicable"
    assert R.reconcile_all(spark, {"t": df}, ["l.t"], broken)[1].first()["validation_mode"] == "blocked"
    results, summary = R.reconcile_all(spark, {"t": df}, ["l.t"], lambda n: df, where="id >= :lo", params={"lo": "0"})
    assert summary.first()["passed"] == 1 and results.count() > 0


def test_profile(spark):
    df = table(spark, [("n", 1.0), ("s", 2.0), (None, 3.0), ("n", 3.0)], "region STRING, monto DOUBLE")
    got = {r["column"]: r for r in Q.profile(df, samples=5).collect()}
    assert got["region"]["null_share"] == 0.25 and got["region"]["null_pct"] == 25.0
    assert got["region"]["unique_count"] == 2 and got["monto"]["unique_count"] == 3
    assert got["region"]["sample_values"] == ["n", "s"] and got["region"]["min_val"] is None
    assert got["monto"]["mean_val"] == 2.25 and got["monto"]["max_val"] == "3.0"


def test_profile_tables_replaces_db_rows(spark):
    prior = table(spark, [("db:x", "old"), ("file:y", "kept")], "source STRING, column STRING")
    out = Q.profile_tables(spark, {"db:x": lambda: spark.range(3)}, prior)
    assert sorted((r["source"], r["column"]) for r in out.collect()) == [("db:x", "id"), ("file:y", "kept")]


def kinds(ref, gen, **kw):
    return {(r["column"], r["kind"]): r["rows_affected"] for r in R.compare_values(ref, gen, **kw).collect()}


def test_large_integers_are_exact(spark):
    ref = table(spark, [(9007199254740993, 1), (9007199254740992, 2)], "K BIGINT, V BIGINT")
    gen = table(spark, [(9007199254740993, 1), (9007199254740992, 3)], "K BIGINT, V BIGINT")
    assert kinds(ref, gen, keys=["K"]) == {("V", "numeric"): 1}
    assert kinds(ref.select("K"), ref.select((ref.K + 1).alias("K"))) == {("K", "numeric"): 2}
    top = table(spark, [(2**63 - 1,), (2**63 - 1,)], "V BIGINT")
    assert status(top, top) == "PASS"


def test_nan_is_missing(spark):
    nan = table(spark, [("a", float("nan")), ("b", 1.0), ("c", None)], "K STRING, V DOUBLE")
    assert status(nan, nan) == "PASS" and status(nan, nan, keys=["K"]) == "PASS"
    assert kinds(nan, table(spark, [("a", None), ("b", 1.0), ("c", None)], "K STRING, V DOUBLE")) == {}
    most = table(spark, [(float("nan"),), (float("nan"),), (1.0,)], "V DOUBLE")
    assert {r["column"]: r["is_numeric"] for r in R.classify_columns(most, most).collect()} == {"V": True}
    assert Q.profile(nan).filter("column = 'V'").first()["null_count"] == 2


def test_lost_cells_are_compared(spark):
    ref = table(spark, [("1",), ("2",), ("zz",)], "V STRING")
    assert kinds(ref, table(spark, [("1",), ("2",), ("QQ",)], "V STRING")) == {("V", "lost_cells"): 1}
    assert kinds(ref, table(spark, [("1",), ("2",), (" ZZ",)], "V STRING")) == {}


def test_surplus_and_nothing_shared(spark):
    assert kinds(spark.range(5), spark.range(4)) == {(None, "surplus_rows"): 1}
    many = spark.range(5000)
    assert status(many, spark.range(4999)) == "FAIL"  # the sums differ, the surplus row alone would pass
    a, b = table(spark, [(1,)], "A INT"), table(spark, [(1,)], "B INT")
    assert kinds(a, b) == {(None, "no_shared_columns"): 1}
    assert kinds(a, a, keys=["A"]) == {(None, "no_shared_columns"): 1}


def test_ties_do_not_depend_on_input_order(spark):
    from tablesteps.operators import ordered as O

    data = [("g", 1, v) for v in range(40)]
    a = table(spark, data, "k STRING, t INT, v INT")
    b = table(spark, data[::-1], "k STRING, t INT, v INT").repartition(5)
    for fn in (
        lambda d: O.row_counter(d, ["t"], by=["k"]), lambda d: O.row_counter(d, ["t"]), lambda d: O.lag_n(d, ["k"], "v", ["t"]),
        lambda d: O.retain_sum(d, ["k"], "v", ["t"]), lambda d: O.retain_last(d, ["k"], "v", ["t"]),
    ):
        assert sorted(map(str, fn(a).collect())) == sorted(map(str, fn(b).collect()))


def test_sketches_merge_and_stay_within_their_error(spark, tmp_path):
    rows = spark.range(200_000).select(
        "id", (F.col("id") % 150_001).cast("string").alias("text"), F.when(F.col("id") % 4 > 0, F.col("id") * 0.5).alias("half"),
        (F.lit(9_007_199_254_740_992) + F.col("id")).alias("big"), (F.col("id") % 5).alias("p"),
    )
    Q.update_sketches(rows, str(tmp_path / "s"), "p")
    kept = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s").iterdir() if f.is_dir()}
    Q.update_sketches(rows.filter("p = 3"), str(tmp_path / "s"), "p")
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s").iterdir() if f.is_dir()}
    assert [n for n in kept if kept[n] != after[n]] == ["p=3"]
    merged = {r.column: r for r in Q.sketch_profile(spark.read.parquet(str(tmp_path / "s"))).collect()}
    once = {r.column: r for r in Q.profile(rows.drop("p"), exact=["id"]).collect()}
    exact = {r.column: r for r in Q.profile(rows.drop("p"), exact=True).collect()}
    for c, r in exact.items():
        for other in (merged[c], once[c]):
            assert other[:7] == r[:7] and (other.min_val, other.max_val) == (r.min_val, r.max_val)
            assert other.mean_val == r.mean_val or other.mean_val == pytest.approx(r.mean_val, rel=1e-12)
            assert abs(other.unique_count - r.unique_count) <= 0.04 * r.unique_count
    assert once["id"].unique_count == 200_000 and exact["big"].max_val == "9007199254940991"
    assert "Expand" not in Q.profile(rows)._jdf.queryExecution().executedPlan().toString()


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a INT, b STRING, c ARRAY<INT>")
    assert [(r.column, r.row_count, r.unique_count, r.null_share, r.min_val) for r in Q.profile(empty).collect()] == [("a", 0, 0, 0.0, None), ("b", 0, 0, 0.0, None)]
    assert Q.profile(empty.select("c")).count() == 0


def test_many_tables_in_one_plan(spark, monkeypatch):
    """Forty tables are written once; with two that fail while they are read, only halves with one of them run again."""
    written = []
    monkeypatch.setattr(Q, "stage", lambda df, label, keep=Q.stage: written.append(label) or keep(df, label))
    tables = {f"file:{k}": lambda k=k: spark.range(k + 1).withColumn("b", F.lit("x")) for k in range(40)}
    got = {(r.source, r.column): r for r in Q.profile_tables(spark, tables).collect()}
    assert len(got) == 80 and got["file:7", "id"].row_count == 8 and len(written) == 1
    written.clear()
    for k in (3, 30):
        tables[f"file:{k}"] = lambda: spark.range(5).select(F.raise_error(F.col("id").cast("string")).cast("int").alias("x"))
    got = [(r.source, r.column, r.error is None) for r in Q.profile_tables(spark, tables).collect()]
    assert {s for s, _, fine in got if not fine} == {"file:3", "file:30"} and len(got) == 78 and len(written) < 25
    assert Q.profile_tables(spark, {}).count() == 0
