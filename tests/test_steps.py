import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablesteps.functions import scalars as S
from tablesteps.operators import joins as J
from tablesteps.operators import procs as P
from tablesteps.operators import steps as D
from tests.conftest import rows


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_missing_is_lowest(spark):
    df = spark.createDataFrame([(None,), (3,), (7,)], "v INT")
    want = {"<": [None, 3], "<=": [None, 3], ">": [7], ">=": [7], "==": [], "!=": [None, 3, 7]}
    for op, values in want.items():
        assert [r.v for r in df.filter(D.missing_low("v", op, 5)).collect()] == values
    with pytest.raises(ValueError):
        D.missing_low("v", "~", 5)


def test_if_else_without_default_is_missing(spark):
    df = spark.createDataFrame([(1,), (None,)], "v INT")
    assert [r[0] for r in df.select(D.if_else([("v = 1", "a")])).collect()] == ["a", None]


def test_update_and_delete_ignore_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k INT, v INT")
    assert rows(D.update_where(df, {"v": "v + k", "k": "0"}, "v > 2")) == [(0, 7), (1, None), (3, 1)]
    assert rows(D.keep_not(df, "v > 2")) == [(1, None), (3, 1)]


def test_stack_widens_and_fills(spark):
    a = spark.createDataFrame([(1, "x")], "id INT, n STRING")
    b = spark.createDataFrame([(2.5, 7)], "id DOUBLE, m INT")
    out = D.stack(a, b)
    assert out.columns == ["id", "n", "m"] and dict(out.dtypes)["id"] == "double"
    assert D.stack(a, b, corresponding=True).columns == ["id"]


def test_transpose_refuses_repeated_ids(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3)], "k STRING, c STRING, v INT")
    with pytest.raises(PySparkException, match="repeated ID"):
        P.transpose(df, ["k"], "c", "v", values=["x", "y"]).collect()
    good = P.transpose(df.filter("v <> 2"), ["k"], "c", "v", prefix="m_")
    assert rows(good.select("k", "m_x", "m_y")) == [("a", 1, 3)]


def test_means_drops_missing_classes_and_keeps_null_sums(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5.0)], "g STRING, v DOUBLE")
    assert rows(P.proc_means(df, ["g"], ["v"], ["sum", "n"])) == [("a", 0, None)]
    assert len(rows(P.proc_means(df, ["g"], ["v"], ["sum"], missing=True))) == 2
    types = P.proc_means(df, ["g"], ["v"], ["n"], types=True)
    assert sorted((r["_TYPE_"], r["_FREQ_"]) for r in types.collect()) == [(0, 2), (1, 2)]


def test_freq_leaves_missing_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "g STRING")
    got = {r["g"]: (r["count"], float(r["percent"])) for r in P.proc_freq(df, "g").collect()}
    assert got == {"a": (2, 66.6667), "b": (1, 33.3333)}


def test_update_by_keeps_master_where_transaction_is_missing(spark):
    m = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k INT, x STRING, y INT")
    t = spark.createDataFrame([(1, None, 9), (3, "c", None)], "k INT, x STRING, y INT")
    assert rows(J.update_by(m, t, ["k"])) == [(1, "a", 9), (2, "b", 6), (3, "c", None)]


def test_set_equal_and_key_diff_count_null_keys_once(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "id INT")
    b = spark.createDataFrame([(1,), (2,)], "id INT")
    assert rows(J.key_diff(a, b, "id")) == [(2, "extra_in_b"), (None, "missing_in_b")]
    assert J.set_equal(a, a, "id").first()["equal"]


def test_prefix_join_takes_the_longest(spark):
    df = spark.createDataFrame([("big-2-mini",), ("big-9",), ("other",), (None,)], "model STRING")
    prices = spark.createDataFrame([("big", 1.0), ("big-2", 2.0)], "prefix STRING, p DOUBLE")
    over = spark.createDataFrame([("big", 7.0)], "prefix STRING, p DOUBLE")
    got = {r["model"]: r["p"] for r in J.prefix_join(df, prices, "model", overrides=over).collect()}
    assert got == {"big-2-mini": 2.0, "big-9": 7.0, "other": None, None: None}


def test_timeseries_fills(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-04", 5), ("a", "2024-01-01", 2)], "k STRING, d STRING, value INT")
    df = df.withColumn("d", F.col("d").cast("date"))
    zero = [r["value"] for r in P.proc_timeseries(df, ["k"], "d", fill="zero").orderBy("period").collect()]
    prev = [r["value"] for r in P.proc_timeseries(df, ["k"], "d", fill="previous").orderBy("period").collect()]
    assert zero == [3, 0, 0, 5] and prev == [3, 3, 3, 5]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.to_num(lit(" 1.5 ")), S.to_num(lit("1d")), S.to_num(lit("N/A")), S.to_num(lit("-2e3"))) == (1.5, None, None, -2000.0)
    assert one(spark, S.scan(lit("a,,b"), 2, ","), S.scan(lit("a,,b"), 2, ",", collapse=True), S.scan(lit("a"), 5, ",")) == ("", "b", None)
    assert one(spark, S.catx("-", lit(" a "), lit(" "), lit(None).cast("string"), lit("b")))[0] == "a-b"
    assert str(one(spark, S.mdy(lit(2), lit(30), lit(2024)))[0]) == "None"
    assert str(one(spark, S.intnx_month(lit("2024-01-31").cast("date"), 1))[0]) == "2024-02-29"
    assert one(spark, S.intck_month(lit("2024-01-31").cast("date"), lit("2024-02-01").cast("date")))[0] == 1
    assert one(spark, S.to_day_number(lit("2024-01-01").cast("date")))[0] == 23376
    assert one(spark, S.slugify(lit("Año: Ñuñoa / v2")), S.slugify(lit("***"))) == ("ano_nunoa_v2", "flujo")
    assert one(spark, S.url_host(lit("https://u:p@Ex.org:80/a?b")), S.url_host(lit("https://&base/x"))) == ("ex.org", "")
    assert one(spark, S.round_half_up(lit(2.5)), S.round_half_up(lit(-2.5))) == (3.0, -3.0)
    assert one(spark, S.repair_text(lit("AÃ±o")), S.repair_text(lit("Año"))) == ("Año", "Año")
    assert one(spark, S.put(lit(7), "z3."), S.put(lit(1234.5), "commax8.2"), S.put(lit("abcd"), "$2.")) == ("007", "1.234,50", "ab")
    assert one(spark, S.qualify(lit("t")), S.qualify(lit("lib.t"))) == ("WORK.T", "LIB.T")
