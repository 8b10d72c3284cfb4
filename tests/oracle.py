"""Runs a registered query and its SQL side by side and compares rows, columns, types and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

from tablesteps.queries.base import BASE_TABLES

EXACT = bool(os.environ.get("ORACLE_EXACT"))  # compare doubles bit by bit

FAMILY = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
    "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date",
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float",
    "float": "float", "string": "str", "boolean": "bool", "date": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [cols[i] for i in order]


def compare(spark, con, query, sf_dir: str) -> list[str]:
    """Differences, empty when the query and its SQL agree."""
    df = query.run(spark, sf_dir)
    got, got_cols = _sorted([tuple(r) for r in df.collect()], df.columns)
    if query.sql is None:
        return [] if got else ["no rows"]
    rel = con.sql(query.sql)
    want, want_cols = _sorted(rel.fetchall(), rel.columns)
    problems = []
    if got_cols != want_cols:
        return [f"columns {got_cols} <> {want_cols}"]
    got_types = {c: FAMILY.get(t, t) for c, t in df.dtypes}
    want_types = {c: FAMILY.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    diff = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    if diff:
        problems.append(f"types {diff}")
    if not want:
        problems.append("SQL gives no rows")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} <> {len(want)}")
    if got != want:
        a = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else []
        b = [r for r in want if r not in set(got)][:3] if len(got) < 50000 else []
        problems.append(f"values\n   spark {a}\n   sql   {b}")
    return problems


if __name__ == "__main__":
    from tablesteps.queries import load
    from tablesteps.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, q in load().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            problems = compare(spark, con, q, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        bad += bool(problems)
        print(("FAIL" if problems else "ok  "), name, f"{time.time() - t0:.1f}s", *problems, flush=True)
    print("failures:", bad)
