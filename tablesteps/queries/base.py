"""Query registry, table access and the tables derived from the driver's parquet files.

Derived tables are given once, as SQL expressions both Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PROGRAM_COLUMNS = {
    "id": "concat('N', CAST(o_orderkey AS STRING))",
    "pfd_id": "concat('PFD-', CAST(o_custkey % 20 AS STRING))",
    "pos": "o_orderkey",
    "label": "concat(CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Check ' WHEN 1 THEN 'Carga ' ELSE 'Paso ' END, o_orderpriority)",
    "code": """CASE CAST(o_orderkey % 8 AS INT)
 WHEN 0 THEN concat('LIBNAME GG ODBC DSN=DWH; /* base; load */', chr(10), 'DATA WORK.T', CAST(o_orderkey AS STRING), '; SET GG.BASE; IF MONTO > 5601; RUN;')
 WHEN 1 THEN concat('PROC SQL; CREATE TABLE GG.R', CAST(o_orderkey % 50 AS STRING), ' AS SELECT T1.ID, SUM(T1.MONTO) AS TOTAL FROM WORK.T', CAST(o_orderkey - 1 AS STRING), ' T1 LEFT JOIN GG.SUCURSALES T2 ON T1.SUC = T2.SUC WHERE PERIODO = &PERIODO GROUP BY T1.ID; QUIT;')
 WHEN 2 THEN concat('PROC SORT DATA=GG.R', CAST((o_orderkey - 1) % 50 AS STRING), ' OUT=WORK.S', CAST(o_orderkey AS STRING), '; BY DESCENDING TOTAL; RUN;')
 WHEN 3 THEN concat('DATA WORK.U', CAST(o_orderkey AS STRING), '; SET WORK.S', CAST(o_orderkey - 1 AS STRING), '; BY ID; * keep; the total; RETAIN ACUM 0; IF FIRST.ID THEN ACUM = 0; ACUM + TOTAL; RUN;')
 WHEN 4 THEN concat('PROC EXPORT DATA=WORK.U', CAST(o_orderkey - 1 AS STRING), ' OUTFILE=''C:/out/u;v.csv'' DBMS=CSV REPLACE; RUN;')
 WHEN 5 THEN 'PROC DATASETS; APPEND BASE=GG.HIST DATA=WORK.DELTA FORCE; QUIT;'
 WHEN 6 THEN concat('FILENAME RESP TEMP; PROC HTTP URL="https://', CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'api.example.com' WHEN 1 THEN 'usr@ws.example.org:8443' ELSE '&base' END, '/ws?user=&user" METHOD="get" OUT=RESP; RUN;')
 ELSE concat('PROC SQL; SELECT * FROM A, B; QUIT;', chr(10), 'DATA OUT1; SET A (KEEP=ID MONTO) GG.BASE; TOTAL = LAG(MONTO); RUN;', chr(10), '%LET password = abc123; X = CASE WHEN MONTO > 5601 THEN ', CAST(o_custkey % 4 AS STRING), ' ELSE 0 END; Y = MONTO * TASA / 100;')
END""",
    "node_type": """CASE CAST(o_orderkey % 8 AS INT)
 WHEN 0 THEN 'DATA_STEP' WHEN 1 THEN 'PROC_SQL' WHEN 2 THEN 'PROC_SORT' WHEN 3 THEN 'DATA_STEP'
 WHEN 4 THEN 'EXPORT' WHEN 5 THEN 'PROC_OTHER' WHEN 6 THEN 'PROC_OTHER' ELSE 'QUERY' END""",
}
DERIVED = {
    "programs": "SELECT " + ",\n".join(f"{e} AS {n}" for n, e in PROGRAM_COLUMNS.items()) + "\nFROM orders",
    "edges": (
        "SELECT concat('N', CAST(o_orderkey - 1 AS STRING)) AS source, concat('N', CAST(o_orderkey AS STRING)) AS target"
        " FROM orders WHERE o_orderkey % 8 BETWEEN 1 AND 4"
    ),
    # datasets in and out of each program, as the chain of the program texts says
    "node_inputs": """SELECT concat('N', CAST(o_orderkey AS STRING)) AS id, CASE CAST(o_orderkey % 8 AS INT)
 WHEN 0 THEN 'GG.BASE' WHEN 1 THEN concat('WORK.T', CAST(o_orderkey - 1 AS STRING))
 WHEN 2 THEN concat('GG.R', CAST((o_orderkey - 1) % 50 AS STRING)) WHEN 3 THEN concat('TMP.S', CAST(o_orderkey - 1 AS STRING))
 WHEN 4 THEN concat('WORK.U', CAST(o_orderkey - 1 AS STRING)) ELSE 'WORK.DELTA' END AS dataset
FROM orders WHERE o_orderkey % 8 < 6""",
    "node_outputs": """SELECT concat('N', CAST(o_orderkey AS STRING)) AS id, CASE CAST(o_orderkey % 8 AS INT)
 WHEN 0 THEN concat('WORK.T', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('GG.R', CAST(o_orderkey % 50 AS STRING))
 WHEN 2 THEN concat('WORK.S', CAST(o_orderkey AS STRING)) WHEN 3 THEN concat('WORK.U', CAST(o_orderkey AS STRING))
 ELSE 'GG.HIST' END AS dataset
FROM orders WHERE o_orderkey % 8 IN (0, 1, 2, 3, 5)""",
    "mappings": """SELECT concat('N', CAST(o_orderkey AS STRING)) AS id FROM orders WHERE o_orderkey % 9 <> 0
UNION ALL SELECT concat('X', CAST(c_custkey AS STRING)) AS id FROM customer WHERE c_custkey % 100 = 0""",
    "ignored": "SELECT concat('N', CAST(o_orderkey AS STRING)) AS id FROM orders WHERE o_orderkey % 45 = 0",
    "left_k": """SELECT CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE c_custkey END AS k, c_acctbal AS bal, c_mktsegment AS seg
FROM customer WHERE c_custkey % 3 <> 0""",
    "right_k": """SELECT CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE c_custkey END AS k, c_acctbal + 1 AS bal, c_nationkey AS nat
FROM customer WHERE c_custkey % 5 <> 0""",
    "events_gap": """SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "trace": """SELECT event_id, ts AS at, event_type AS task,
 CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'alpha-large-2' WHEN 1 THEN 'alpha-small' WHEN 2 THEN 'alpha-large-2-mini' ELSE 'unlisted' END AS model,
 CASE WHEN event_id % 10 = 0 THEN 'needs_human:refusal' WHEN event_id % 10 = 5 THEN 'error:Timeout' ELSE 'ok' END AS outcome,
 event_id % 5000 AS duration_ms, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 900 END AS input_tokens,
 event_id % 300 AS output_tokens, event_id % 50 AS cache_read_tokens, event_id % 20 AS cache_write_tokens
FROM events""",
    "prices": """SELECT * FROM (VALUES ('alpha', 1.0, 5.0, 0.1, 1.25), ('alpha-large', 5.0, 25.0, 0.5, 6.25),
 ('alpha-large-2-mini', 2.0, 10.0, 0.2, 2.5)) AS p(prefix, input, output, cache_read, cache_write)""",
}
#: Programs of a task, about: what is grouped by program later stays in the task of its texts.
PROGRAMS_PER_TASK = 50_000
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``t.orders`` reads a parquet table, ``t.programs`` a derived one, ``t.sql`` runs SQL over both."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._spread: int | None = None

    def _tasks(self) -> int:
        """Tasks for the program texts: a task's share does not grow with the table."""
        if self._spread is None:
            self._spread = max(self.spark.sparkContext.defaultParallelism, -(-self.orders.count() // PROGRAMS_PER_TASK))
        return self._spread

    def __getattr__(self, name: str) -> DataFrame:
        if name == "programs":
            # the texts are made from one small file; spread them before text work starts
            return self.sql(DERIVED[name]).repartition(self._tasks(), "id")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in BASE_TABLES if _mentions(text, n)}
        for name, df in used.items():
            df.createOrReplaceTempView(f"_ts_{name}")
            text = _replace(text, name, f"_ts_{name}")
        return self.spark.sql(text)


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I) is not None


def _replace(text: str, name: str, new: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{new}", text, flags=re.I)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(t: Tables) -> DataFrame``; ``uses`` names derived tables the SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        text = sql
        if text is not None and uses:
            views = ",\n".join(f"{n} AS (\n{DERIVED[n]}\n)" for n in uses)
            body = text.strip()
            for lead in ("WITH RECURSIVE ", "WITH "):
                if body.startswith(lead):
                    text = f"{lead}{views},\n{body[len(lead):]}"
                    break
            else:
                text = f"WITH {views}\n{body}"
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), text)
        return fn

    return register
