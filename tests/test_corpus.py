"""Repetition in texts: normal forms that SQL would tell apart stay apart."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tablesteps.functions.scalars import EXPANDING, upper_by_letter
from tablesteps.plans import corpus as C


def test_upper_by_letter_is_sqls(spark):
    texts = ["straße", "STRASSE", "éñ ᾳŉx", "", *EXPANDING, "a" + EXPANDING + "z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(upper_by_letter("t")).collect()]
    given = pa.table({"t": texts})  # noqa: F841  read by name
    assert got == [r[0] for r in duckdb.sql("SELECT upper(t) FROM given").fetchall()]


def test_duplicate_lines_keep_sharp_s_apart_and_count_letters_once(spark):
    long = "x" * 54
    rows = [(k, f"{long} straße") for k in range(3)] + [(3, f"{long} strasse")]  # 61 and 62 letters
    rows += [(10 + k, f"{'y' * 58}ß") for k in range(3)]  # 59 letters, 60 were they spelled SS
    out = C.duplicate_blocks(spark.createDataFrame(rows, "id INT, text STRING"), 60, 3, None, text="text", sep="\n")
    assert [(r.term, r.n_ids) for r in out.select("term", F.col("n_ids")).collect()] == [(f"{'X' * 54} STRAẞE", 3)]


def test_library_evidence_reads_the_texts_once(spark):
    rows = [("A", "PROC SQL; CREATE TABLE GG.R AS SELECT * FROM GG.BASE; QUIT;"), ("B", "DATA GG.R; SET HR.P;"), ("C", "SET GG.BASE;")]
    programs = spark.createDataFrame(rows, "id STRING, code STRING")
    out = C.db_evidence(programs, declared=C.librefs(programs))
    got = sorted((r.libref, r.n_ids, r.n_tables, r.writes, r.unverified) for r in out.collect())
    assert got == [("GG", 3, 2, True, False), ("HR", 1, 1, False, True)]
    told = lambda df: df._jdf.queryExecution().analyzed().toString().count("APPEND")
    assert told(out) == told(C.table_programs(programs))


def test_found_categories_are_those_of_the_findings(spark):
    texts = {
        "A": "SELECT * FROM A, B", "B": "password = abc123", "C": "IF X > 4711 THEN Y = 1; Z", "D": "K = 4711", "E": "K = 4711; L = 'C:/x'",
        "F": "WHERE P = &P", "G": None, "H": "", "I": "D = '2024-01-31'",
    }
    for chosen in (texts, *[{k: texts[k]} for k in texts], {k: texts[k] for k in "CD"}, {k: texts[k] for k in "CDE"}, {}):
        df = spark.createDataFrame(list(chosen.items()), "id STRING, code STRING")
        want = {r[0] for r in C.scan_rules(df).select("category").distinct().collect()}
        got = C.found_categories(df)
        assert sorted(r[0] for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan
