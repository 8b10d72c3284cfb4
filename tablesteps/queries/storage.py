"""Queries for readers, writers, archives and streams."""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tablesteps.plans import ledger as K
from tablesteps.plans.programs import from_run_logs
from tablesteps.queries.base import query
from tablesteps.queries.ledgers import _previous, _reviews
from tablesteps.session import scratch_dir
from tablesteps.sources import archives as Z
from tablesteps.sources import readers as S
from tablesteps.sources import sinks as W
from tablesteps.streaming import streams as T


def _place(t, label):
    return f"{scratch_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def _table(t, df, label, partition_by=()):
    """A new catalog table with its files in the scratch folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    W.create_as(df, name, path=_place(t, label), partition_by=partition_by)
    return name


# --- readers ---------------------------------------------------------------------------------


@query("s1_read_delimited", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def _(t):
    path = _place(t, "csv")
    W.export_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, sep=";")
    return S.read_delimited(t.spark, path, sep=";", schema="c_custkey STRING, c_name STRING, c_acctbal DOUBLE")


@query("s2_detect_encoding", r"""SELECT doc_id, lang, md5(regexp_replace(replace(text, chr(13), ' '), '[^\x00-\x{FF}]', '?', 'g')) AS hash FROM documents""")
def _(t):
    path = _place(t, "latin")
    latin = F.regexp_replace(F.replace("text", F.lit("\r"), F.lit(" ")), r"[^\x00-\xFF]", "?")
    rows = t.documents.select("doc_id", "lang", latin.alias("text"))
    W.export_csv(rows, path, encoding="ISO-8859-1")
    back = S.read_delimited(t.spark, path, schema="doc_id BIGINT, lang STRING, text STRING", multiline=True, keep_empty=True)
    return back.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("s3_read_table", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return S.read_table(t.spark, f"{t.sf_dir}/nation.parquet").select("n_nationkey", "n_name")


@query("s4_read_qualified", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    name = _table(t, t.supplier, "supplier")
    return S.read_table(t.spark, f"default.{name}").select("s_suppkey", "s_name", "s_acctbal")


@query("s5_read_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000")
def _(t):
    out = S.read_where(t.spark, t.orders, "o_orderstatus = :status AND o_totalprice >= :price", {"status": "F", "price": "150000"})
    return out.select("o_orderkey", "o_totalprice")


@query("s6_read_table_named", "SELECT * FROM region")
def _(t):
    name = _table(t, t.region, "bd_r2024")
    return S.read_table_named(t.spark, "bd_r&ANIO&TRIM", {"ANIO": "2024", "TRIM": name.removeprefix("bd_r2024")})


@query(
    "s8_json_flatten",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def _(t):
    return S.json_flatten(t.events.select("event_id", "props"), "props", "k BIGINT")


@query(
    "s8_json_series",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CASE WHEN event_id % 9 <> 0 THEN round(value, 2) END AS value FROM events WHERE event_id % 4 <> 0
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 0""",
)
def _(t):
    from tablesteps.functions.scalars import to_dmy, to_num

    obs = F.struct(
        F.date_format("ts", "dd-MM-yyyy").alias("indexDateString"),
        F.when(F.col("event_id") % 9 == 0, "NeuN").otherwise(F.round("value", 2).cast("string")).alias("value"),
    )
    series = F.struct(F.struct(F.when(F.col("event_id") % 4 != 0, F.array(obs)).otherwise(F.array_remove(F.array(obs), obs)).alias("Obs")).alias("Series"))
    raw = t.events.select("event_id", F.to_json(series).alias("body"))
    flat = S.json_flatten(raw, "body", "Series STRUCT<Obs: ARRAY<STRUCT<indexDateString: STRING, value: STRING>>>", path="Series.Obs")
    return flat.select("event_id", to_dmy("indexDateString").cast("string").alias("d"), to_num("value").alias("value"))


@query(
    "s9_file_catalog",
    """SELECT 'r' || n_regionkey AS region, 'txt' AS type, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1""",
)
def _(t):
    """One file of names per region, catalogued and read back."""
    path = _place(t, "catalog")
    names = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("region"), F.col("n_name").alias("value"))
    names.coalesce(1).write.partitionBy("region").text(path)
    files = S.file_catalog(t.spark, path).withColumn("region", F.regexp_extract("path", "region=([^/]+)", 1))
    lines = t.spark.read.text(path).groupBy("region").agg(F.count(F.lit(1)).alias("n_lines"))
    return files.join(lines, "region").select("region", "type", "n_lines", "bytes")


def _trace_files(t):
    """The trace as JSON lines, one of them torn."""
    usage = F.struct(
        "input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_write_tokens").alias("cache_creation_input_tokens")
    )
    line = F.to_json(F.struct(F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"), "task", "model", "outcome", "duration_ms", usage.alias("usage")))
    path = _place(t, "trace")
    torn = t.region.filter("r_regionkey = 0").select(F.lit('{"at": "2024-01-01T00:00:00Z", "task": "x", "usa').alias("value"))
    t.trace.select(line.alias("value")).union(torn).write.text(path)
    return path


@query("s10_read_trace", "SELECT event_type AS task, count(*) AS calls, sum(event_id % 300)::BIGINT AS output_tokens FROM events GROUP BY 1")
def _(t):
    rows = S.read_trace(t.spark, _trace_files(t))
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("calls"), F.sum("usage.output_tokens").alias("output_tokens"))


def _zip(entries):
    """A zip file of stored entries, as ``zipfile`` lays it out; that module spends most of its time on one small entry."""
    files, directory = [], []
    at = 0
    for name, data in entries:
        raw = name.encode()
        # version, UTF-8 names, stored, time, 1980-01-01, checksum, size twice, length of the name, no extra field
        head = struct.pack("<5H3I2H", 20, 0x800, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(raw), 0)
        files += b"PK\3\4", head, raw, data
        directory += b"PK\1\2\x14\3", head, struct.pack("<3H2I", 0, 0, 0, 0o600 << 16, at), raw
        at += 30 + len(raw) + len(data)
    index = b"".join(directory)
    return b"".join(files) + index + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(entries), len(entries), len(index), at, 0)


def _zip_projects(batches):
    """Project archives of up to 100 programs each, as bytes."""
    element = "<w><Element><ID>{0}</ID><Type>{1}</Type><Label>{0}</Label><Container>PFD-1</Container></Element></w>"
    for batch in batches:
        ids, codes = (batch.column(c).to_pylist() for c in ("id", "code"))
        paths, contents = [], []
        for lo in range(0, len(ids), 100):
            xml, flow, entries = [], [], []
            for pid, code in zip(ids[lo : lo + 100], codes[lo : lo + 100], strict=True):
                xml += [element.format(f"{k}-{pid}", "TASK") for k in ("CodeTask", "Query", "ImportTask")]
                flow.append(f"<Process><Element><ID>Query-{pid}</ID></Element><Dependencies><D>CodeTask-{pid}</D></Dependencies></Process>")
                log = f"n note\ns  2    PROC SQL;\ns  3      SELECT '{pid}' FROM T;\ns  4    QUIT;\n"
                entries += [
                    (f"CodeTask-{pid}/code.sas", code.encode()), (f"old/PFD-1/CodeTask-{pid}/code.sas", b"old version"),
                    (f"old/PFD-1/CodeTask-gone{pid}/code.sas", b"lost"), (f"Query-{pid}/Log-1/result.log", b"n short"),
                    (f"Query-{pid}/Log-2/result.log", log.encode()),
                ]
            flows = "<w><Element><ID>PFD-1</ID><Type>CONTAINER</Type></Element><PFD>" + "".join(flow) + "</PFD></w>"
            entries.append(("project.xml", ("<P><Elements>" + "".join(xml) + flows + "</Elements></P>").encode("utf-16")))
            paths.append(f"{ids[lo]}.egp")
            contents.append(_zip(entries))
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})


def _archives(t):
    return Z.parse_archives(t.programs.select("id", "code").mapInArrow(_zip_projects, "path STRING, content BINARY"))


@query(
    "s11_archive_nodes",
    """SELECT 'CodeTask-' || id AS id, 'CodeTask' AS task_kind, code, false AS native FROM programs
UNION ALL SELECT 'Query-' || id, 'Query', '', false FROM programs UNION ALL SELECT 'ImportTask-' || id, 'ImportTask', '', true FROM programs""",
    uses=("programs",),
)
def _(t):
    return _archives(t).nodes().select("id", "task_kind", "code", "native")


@query("s11_archive_deps", "SELECT 'CodeTask-' || id AS source, 'Query-' || id AS target FROM programs", uses=("programs",))
def _(t):
    return _archives(t).deps.select("source", "target")


@query(
    "s11_archive_orphans",
    "SELECT 'CodeTask-gone' || id AS id, 'old/PFD-1/CodeTask-gone' || id || '/code.sas' AS entry, 'snapshot' AS place FROM programs",
    uses=("programs",),
)
def _(t):
    return _archives(t).orphans.select("id", "entry", "place")


@query(
    "s11_archive_query_code",
    "SELECT 'Query-' || id AS id, 'PROC SQL;' || chr(10) || '  SELECT ''' || id || ''' FROM T;' || chr(10) || 'QUIT;' AS code FROM programs",
    uses=("programs",),
)
def _(t):
    lines = Z.log_lines(_archives(t).logs)
    return from_run_logs(lines).select(F.substring_index("log_id", "|", -1).alias("id"), "code")


# --- writers ---------------------------------------------------------------------------------


@query("k1_export_csv", "SELECT r_regionkey, r_name FROM region")
def _(t):
    path = _place(t, "export")
    W.export_csv(t.nation, path)
    W.export_csv(t.region, path, bom=True)
    return S.read_delimited(t.spark, path, schema="r_regionkey INT, r_name STRING")


@query("k2_write_replace", "SELECT n_nationkey, n_name, CAST(NULL AS INT) AS n_regionkey FROM nation WHERE n_nationkey > 5")
def _(t):
    name = _table(t, t.nation, "replace")
    kept = t.spark.table(name).filter("n_nationkey > 5").select("n_name", "n_nationkey")
    W.write_replace(kept, name, reads_target=True)
    W.write_replace(t.spark.table(name), name, reads_target=True)
    return t.spark.table(name)


@query("k3_write_append", "SELECT * FROM region UNION ALL SELECT * FROM region UNION ALL SELECT r_regionkey + 10, 'X' FROM region")
def _(t):
    name = _table(t, t.region, "append")
    W.write_append(t.region, name)
    W.write_append(t.region.select(F.lit("X").alias("r_name"), (F.col("r_regionkey") + 10).alias("r_regionkey")), name)
    return t.spark.table(name)


@query("k4_create_as", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.spark.table(_table(t, t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "create"))


@query(
    "k5_write_period",
    """SELECT o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    name = _table(t, base, "period", partition_by=["o_orderstatus"])
    again = base.withColumn("o_totalprice", F.col("o_totalprice") + 1).filter("o_orderstatus = 'F'")
    W.write_period(again, name, "o_orderstatus")
    W.write_period(again, name, "o_orderstatus", periods=["F", "P"])
    return t.spark.table(name)


@query("k6_delete_from_table", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)")
def _(t):
    name = _table(t, t.customer.select("c_custkey", "c_acctbal"), "delete")
    W.delete_where(t.spark, name, "c_acctbal < :limit", {"limit": 1000})
    return t.spark.table(name)


@query(
    "k7_update_table",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_totalprice > 300000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(t):
    """The new value of the partition column moves rows to a partition that did not exist."""
    name = _table(t, t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "update", partition_by=["o_orderstatus"])
    W.update_table(t.spark, name, {"o_totalprice": "o_totalprice * 2", "o_orderstatus": "'Z'"}, "o_totalprice > :least", {"least": 300000})
    return t.spark.table(name)


@query("k10_observe_step", "SELECT 'orders' AS label, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) AS written_rows, true AS passed FROM orders")
def _(t):
    df, seen = W.observe_step(t.orders, "orders")
    path = _place(t, "observed")
    df.write.parquet(path)
    return W.check_written(seen, t.spark.read.parquet(path), "orders")


# --- streams ---------------------------------------------------------------------------------


@query(
    "t1_trace_stream",
    """WITH x AS (SELECT date_trunc('hour', ts) AS w, event_type AS task, event_id FROM events), c AS (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 10 MINUTE AS cut FROM events)
SELECT strftime(w, '%Y-%m-%d %H') AS window_start, task, count(*) AS calls, count(*) FILTER (event_id % 10 NOT IN (0, 5)) AS ok, count(*) FILTER (event_id % 10 = 0) AS needs_human,
 count(*) FILTER (event_id % 10 = 5) AS errors, sum(event_id % 300)::BIGINT AS output_tokens FROM x, c WHERE w + INTERVAL 1 HOUR <= cut GROUP BY 1, 2""",
)
def _(t):
    out, check = _place(t, "rollup"), _place(t, "rollup-check")
    rolled = T.trace_stream(T.trace_source(t.spark, _trace_files(t)))
    run = rolled.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    run.awaitTermination()
    done = t.spark.read.parquet(out)
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "task", "calls", "ok", "needs_human", "errors", "output_tokens")


def _stream_of(t, df, label):
    path = _place(t, label)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(
    "t2_ledger_stream",
    """WITH r AS (SELECT DISTINCT 'N' || (event_id % 3000 * 7) AS id FROM events)
SELECT l.id, pfd_id AS batch, CASE WHEN pos % 4 = 0 OR l.id IN (SELECT id FROM r) THEN 'reviewed' ELSE 'pending' END AS status FROM programs l""",
    uses=("programs",),
)
def _(t):
    ledger = K.ledger_init(t.programs, _previous(t))
    path = _place(t, "ledger")
    run = T.ledger_stream(_stream_of(t, _reviews(t).repartition(4), "reviews"), ledger, path, _place(t, "ledger-check"))
    run.awaitTermination()
    return T.latest_state(t.spark, path).select("id", "batch", "status")


@query(
    "t2_queue_stream",
    """SELECT 'N' || (event_id % 90) AS node_id, max(event_id % 7) AS attempts FROM events GROUP BY 1""",
)
def _(t):
    failures = t.events.select(
        F.lit(6).alias("phase"), F.lit("translate").alias("task"), F.concat(F.lit("N"), (F.col("event_id") % 90).cast("string")).alias("node_id"),
        F.lit("refusal").alias("reason"), F.lit("d").alias("detail"), (F.col("event_id") % 7).alias("attempts"), F.col("ts").cast("timestamp").alias("at"),
    )
    empty = t.spark.createDataFrame([], "id STRING, phase INT, task STRING, node_id STRING, reason STRING, detail STRING, attempts BIGINT, resolved BOOLEAN, resolution STRING")
    path = _place(t, "queue")
    run = T.queue_stream(_stream_of(t, failures.repartition(4), "failures"), empty, path, _place(t, "queue-check"))
    run.awaitTermination()
    return T.latest_state(t.spark, path).select("node_id", "attempts")


@query(
    "t3_reconcile_stream",
    """SELECT o_orderstatus AS period, CASE WHEN o_orderstatus = 'O' THEN 'FAIL' ELSE 'PASS' END AS status FROM orders GROUP BY 1""",
)
def _(t):
    ref = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("period"))
    gen = ref.withColumn("o_totalprice", F.when(F.col("period") == "O", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    path = _place(t, "progress")
    run = T.reconcile_stream(
        _stream_of(t, gen.select("period").repartition(3), "arrivals"),
        lambda periods: ref.join(periods, "period", "left_semi"),
        lambda periods: gen.join(periods, "period", "left_semi"),
        "period", path, _place(t, "progress-check"), ["o_orderkey"],
    )
    run.awaitTermination()
    return T.latest_state(t.spark, path).select("period", "status")
