import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablesteps.plans import ledger as K
from tablesteps.queries import load
from tablesteps.sources import readers as S
from tablesteps.sources import sinks as W
from tablesteps.streaming import streams as T
from tests.conftest import rows


def test_latin1_and_bom(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,año\n1,ñandú\n".encode("latin-1"))
    (tmp_path / "bom.csv").write_bytes("id,v\n1,x\n".encode("utf-8-sig"))
    (tmp_path / "t.tsv").write_text("id\tv\n1\ta,b\n")
    latin = S.read_delimited(spark, str(tmp_path / "latin.csv"))
    assert latin.columns == ["id", "año"] and latin.first()["año"] == "ñandú"
    assert S.read_delimited(spark, str(tmp_path / "bom.csv")).columns == ["id", "v"]
    assert S.read_delimited(spark, str(tmp_path / "t.tsv")).first()["v"] == "a,b"


def test_torn_trace_line(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"task": "a", "outcome": "ok", "usage": null}\n{"task": "b", "outc')
    assert [r["task"] for r in S.read_trace(spark, str(tmp_path)).collect()] == ["a"]


def test_parameters(spark):
    df = spark.range(10)
    assert S.read_where(spark, df, "id > :lo AND ':no' <> ''", {"lo": "7", "other": None}).count() == 2
    with pytest.raises(ValueError, match="hi"):
        S.read_where(spark, df, "id > :lo AND id < :hi", {"lo": 1})
    with pytest.raises(ValueError):
        S.read_table_named(spark, "t_&A", {"A": "x; drop"})
    assert S.cast_params({"a": "1", "b": "1.5", "c": "x", "d": "1e3"}) == {"a": 1, "b": 1.5, "c": "x", "d": 1000.0}


def test_values_are_never_code(spark):
    df = spark.createDataFrame([("a' OR '1'='1",), ("b",)], "v STRING")
    assert S.read_where(spark, df, "v = :p", {"p": "a' OR '1'='1"}).count() == 1


def test_write_rules(spark, tmp_path):
    base = spark.createDataFrame([(1, "x", "2024"), (2, "y", "2025")], "id INT, v STRING, p STRING")
    W.create_as(base, "w_period", path=str(tmp_path / "w"), partition_by=["p"])
    with pytest.raises(AnalysisException):
        W.create_as(base, "w_period")
    with pytest.raises(ValueError, match="no column"):
        W.write_append(base.withColumn("zz", F.lit(1)), "w_period")
    with pytest.raises(ValueError, match="period"):
        W.write_period(base.drop("p"), "w_period", "p")
    new = spark.createDataFrame([(9, "z", "2025")], "id INT, v STRING, p STRING")
    for _ in range(2):
        W.write_period(new, "w_period", "p")
    assert rows(spark.table("w_period")) == [(1, "2024", "x"), (9, "2025", "z")]
    W.write_period(new, "w_period", "p", periods=["2024", "2025"])
    assert rows(spark.table("w_period")) == [(9, "2025", "z")]
    before = rows(spark.table("w_period"))
    strange = spark.createDataFrame([(3, "q", "2026"), (4, "q", None)], "id INT, v STRING, p STRING")
    with pytest.raises(ValueError, match="not being reloaded"):
        W.write_period(strange.unionByName(new), "w_period", "p", periods=["2025"])
    assert rows(spark.table("w_period")) == before
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_quoted_line_breaks_and_reference_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;v\n1;"x\ny"\n2;z\n', encoding="utf-8")
    got = S.read_reference(spark, str(tmp_path / "a.csv"), multiline=True)
    assert rows(got) == [("1", "x\ny"), ("2", "z")]


def test_stream_restarts(spark, tmp_path):
    events = spark.createDataFrame([(6, "t", "a", "r", "d", 2, None)], FAIL)
    events.write.parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        T.queue_stream(stream, spark.createDataFrame([], QUEUE), state, str(tmp_path / "check")).awaitTermination()
        return rows(T.latest_state(spark, state).select("node_id", "attempts"))

    assert run() == run() == [(2, "a")]  # a restart without new files
    events.withColumn("attempts", F.lit(5).cast("int")).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(5, "a")] == run()


def test_replace_is_idempotent_and_append_doubles(spark, tmp_path):
    df = spark.range(3)
    W.create_as(df, "w_plain", path=str(tmp_path / "p"))
    W.write_replace(df, "w_plain")
    W.write_replace(df, "w_plain")
    assert spark.table("w_plain").count() == 3
    W.write_append(df, "w_plain")
    assert spark.table("w_plain").count() == 6
    W.delete_where(spark, "w_plain", "id = 1")
    assert rows(spark.table("w_plain")) == [(0,), (0,), (2,), (2,)]


QUEUE = "id STRING, phase INT, task STRING, node_id STRING, reason STRING, detail STRING, attempts BIGINT, resolved BOOLEAN, resolution STRING"
FAIL = "phase INT, task STRING, node_id STRING, reason STRING, detail STRING, attempts BIGINT, at TIMESTAMP"


def test_queue_rules(spark):
    queue = spark.createDataFrame(
        [("NH-001", 6, "t", "a", "r", "d", 1, False, None), ("NH-007", 6, "t", "b", "r", "d", 1, True, "done")], QUEUE
    )
    failures = spark.sql("SELECT 6 AS phase, 't' AS task, n AS node_id, 'r' AS reason, '' AS detail, 3L AS attempts, current_timestamp() AS at FROM VALUES ('a'), ('b') AS x(n)")
    out = {r["id"]: r for r in K.queue_upsert(queue, failures).collect()}
    assert set(out) == {"NH-001", "NH-007", "NH-008"}
    assert out["NH-001"]["attempts"] == 3 and out["NH-001"]["detail"] == "d"
    assert out["NH-007"]["resolved"] and not out["NH-008"]["resolved"]
    again = K.queue_upsert(K.queue_upsert(queue, failures), failures)
    assert again.count() == 3
    fixed = spark.createDataFrame([("a",), (None,)], "node_id STRING")
    closed = {r["id"]: r["resolution"] for r in K.queue_resolve(queue, fixed, 6, "t", "ok").collect()}
    assert closed == {"NH-001": "ok", "NH-007": "done"}


def test_stream_replay_changes_nothing(spark, tmp_path):
    events = spark.createDataFrame([(6, "t", "a", "r", "d", 2, None), (6, "t", "b", "r", "d", 1, None)], FAIL)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], QUEUE)
    state = str(tmp_path / "state")

    def run(check):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = T.queue_stream(stream, empty, state, str(tmp_path / check))
        q.awaitTermination()
        return rows(T.latest_state(spark, state).select("node_id", "attempts"))

    first = run("check")
    assert first == [(2, "a"), (1, "b")] or first == [(1, "b"), (2, "a")]
    assert run("check-lost") == first  # the same batch again overwrites its own segment


def test_budget(spark):
    calls = spark.createDataFrame([(i, 40.0) for i in range(5)], "i INT, cost DOUBLE")
    got = [r["allowed"] for r in K.budget_cut(calls, 100, "cost", ["i"]).orderBy("i").collect()]
    assert got == [True, True, True, False, False]
    assert K.budget_cut(calls, 0, "cost", ["i"]).filter("NOT allowed").count() == 0


def test_trace_rejects(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"at": "2024-01-01T00:00:00Z", "task": "x"}\n\n{"at": "2024-01-0\nplain\n', encoding="utf-8")
    assert S.read_trace(spark, str(tmp_path)).filter("task = 'x'").count() == 1
    assert sorted(r["line"] for r in S.trace_rejects(spark, str(tmp_path)).collect()) == ['plain', '{"at": "2024-01-0']


def test_stream_counts_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.json").write_text('{"at": "2024-01-01T00:00:00Z", "task": "x"}\n{"at": "2024-01-0\nplain\n', encoding="utf-8")
    torn = T.trace_reject_source(spark, str(tmp_path / "in"))
    torn.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(
        availableNow=True
    ).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["line"] for r in got) == ["plain", '{"at": "2024-01-0'] and all(r["file"].endswith("t.json") for r in got)


def test_cells_keep_blanks_and_empty_texts(spark, tmp_path):
    texts = ["é", " lead", "trail ", "\ttab\t", "\nline\n", " ", "", None, '"', '" ', ",", "nul\x00", "\x00", "ä\x85"]
    given = [(k, None if k == 3 else "" if k == 4 else "es", v) for k, v in enumerate(texts)]
    df = spark.createDataFrame(given, "id INT, lang STRING, v STRING")
    for encoding in ("UTF-8", "ISO-8859-1"):
        W.export_csv(df, str(tmp_path / "cells"), encoding=encoding)
        back = S.read_delimited(spark, str(tmp_path / "cells"), schema=df.schema, multiline=True, keep_empty=True)
        assert sorted(tuple(r) for r in back.collect()) == given
    assert S.read_delimited(spark, str(tmp_path / "cells"), schema=df.schema, multiline=True).filter("v IS NULL").count() == 2


def test_encoding_query_on_odd_texts(spark, tmp_path):
    """The registered query against its SQL: blanks at the ends, empty, missing and control characters."""
    texts = ["é", " lead", "trail ", "\nline\n", "", None, "a\rb\r", "\r", "\x00", 'say "x"', "漢😀", "\x1f"]
    df = spark.createDataFrame([(k, v, "es" if k % 5 else None) for k, v in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    q = load()["s2_detect_encoding"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in q.run(spark, str(tmp_path)).collect()) == sorted(con.execute(q.sql).fetchall())
