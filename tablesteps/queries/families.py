"""Program texts of many shapes with their expected rows, spread over the orders table.

Each family is one text with what the parsers must say about it, written down by hand. A program takes the family of its
order key; ``@`` stands for the key. So the expected rows are a table, and no oracle repeats the parser's logic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tablesteps.plans import programs as P
from tablesteps.queries.base import query


@dataclass(frozen=True)
class Family:
    code: str
    #: Statements in order.
    says: list[str]
    #: ``position direction LIBRARY.TABLE kind`` of each reference.
    refs: list[str] = field(default_factory=list)
    #: (some statement needs row state, some statement SQL could say), if there is step logic.
    logic: tuple[bool, bool] | None = None
    #: Place of the program where DB is the only database library.
    place: str = "pandas"


A, B = "0 out WORK.A data", "1 in WORK.B set"
FAMILIES = [
    Family("DATA A@; SET B; RUN;", ["DATA A@", "SET B", "RUN"], ["0 out WORK.A@ data", B]),
    Family("DATA A; SET B; /* the rest ; DATA C; SET D;", ["DATA A", "SET B"], [A, B]),
    Family("DATA A; X = 'it''s; fine'; RUN;", ["DATA A", "X = 'it''s; fine'", "RUN"], [A], (False, True)),
    Family("%* gone; DATA A; RUN;", ["DATA A", "RUN"], [A]),
    Family("* gone; SET B;", ["SET B"], place="utility"),
    Family("PROC SORT DATA=DB.Q OUT=R@; BY K; RUN;", ["PROC SORT DATA=DB.Q OUT=R@", "BY K", "RUN"], ["0 in DB.Q proc_sort_data", "0 out WORK.R@ proc_sort_out"], place="hybrid"),
    Family("PROC SORT DATA=DB.Q OUT=DB.R; BY K; RUN;", ["PROC SORT DATA=DB.Q OUT=DB.R", "BY K", "RUN"], ["0 in DB.Q proc_sort_data", "0 out DB.R proc_sort_out"], place="sql_pushdown"),
    Family("PROC SQL; CREATE TABLE DB.A AS SELECT * FROM DB.B; QUIT;", ["PROC SQL", "CREATE TABLE DB.A AS SELECT * FROM DB.B", "QUIT"],
           ["1 out DB.A sql_create", "1 in DB.B sql_from"], place="sql_pushdown"),
    Family("PROC SQL; CREATE TABLE T AS SELECT * FROM DB.B X INNER JOIN DB.C Y ON X.K = Y.K; QUIT;",
           ["PROC SQL", "CREATE TABLE T AS SELECT * FROM DB.B X INNER JOIN DB.C Y ON X.K = Y.K", "QUIT"],
           ["1 out WORK.T sql_create", "1 in DB.B sql_from", "1 in DB.C sql_join"], place="hybrid"),
    Family("PROC SQL; CREATE VIEW DB.V AS SELECT * FROM DB.B; QUIT;", ["PROC SQL", "CREATE VIEW DB.V AS SELECT * FROM DB.B", "QUIT"],
           ["1 out DB.V sql_create", "1 in DB.B sql_from"], place="sql_pushdown"),
    Family("PROC SQL; DELETE FROM DB.W WHERE K = 1; QUIT;", ["PROC SQL", "DELETE FROM DB.W WHERE K = 1", "QUIT"], ["1 out DB.W sql_write", "1 in DB.W sql_from"], place="sql_pushdown"),
    Family("PROC SQL; INSERT INTO DB.W SELECT * FROM DB.V; QUIT;", ["PROC SQL", "INSERT INTO DB.W SELECT * FROM DB.V", "QUIT"],
           ["1 out DB.W sql_write", "1 in DB.V sql_from"], place="sql_pushdown"),
    Family("PROC SQL; UPDATE DB.W SET A = 1; QUIT;", ["PROC SQL", "UPDATE DB.W SET A = 1", "QUIT"], ["1 out DB.W sql_write"], place="sql_pushdown"),
    Family("PROC SQL; ALTER TABLE DB.W ADD C NUM; QUIT;", ["PROC SQL", "ALTER TABLE DB.W ADD C NUM", "QUIT"], ["1 out DB.W sql_write"], place="sql_pushdown"),
    Family("PROC SQL; TRUNCATE TABLE DB.W; DROP TABLE X; QUIT;", ["PROC SQL", "TRUNCATE TABLE DB.W", "DROP TABLE X", "QUIT"], ["1 out DB.W sql_write"], place="sql_pushdown"),
    Family("PROC SQL; CONNECT TO ODBC AS D (DSN=X); SELECT * FROM CONNECTION TO D (SELECT 1 FROM DUAL); QUIT;",
           ["PROC SQL", "CONNECT TO ODBC AS D (DSN=X)", "SELECT * FROM CONNECTION TO D (SELECT 1 FROM DUAL)", "QUIT"], place="sql_passthrough"),
    Family("PROC SQL; CONNECT TO ORACLE AS D (X); EXECUTE (DROP TABLE T) BY D; QUIT;", ["PROC SQL", "CONNECT TO ORACLE AS D (X)", "EXECUTE (DROP TABLE T) BY D", "QUIT"], place="sql_passthrough"),
    Family("DATA OUT@; SET &LIB..T; RUN;", ["DATA OUT@", "SET &LIB..T", "RUN"], ["0 out WORK.OUT@ data", "1 macro &MACRO.&LIB..T set"]),
    Family("PROC PRINT DATA=&X; RUN;", ["PROC PRINT DATA=&X", "RUN"], ["0 macro &MACRO.&X proc_print_data"], place="ambiguous"),
    Family("DATA A; SET B; AÑO = 2024; RUN;", ["DATA A", "SET B", "AÑO = 2024", "RUN"], [A, B], (False, True)),
    Family("DATA A; MERGE B (IN=X) C (IN=Y); BY K; IF X AND Y; RUN;", ["DATA A", "MERGE B (IN=X) C (IN=Y)", "BY K", "IF X AND Y", "RUN"],
           [A, "1 in WORK.B merge", "1 in WORK.C merge"], (False, True)),
    Family("DATA A; UPDATE B C; BY K; RUN;", ["DATA A", "UPDATE B C", "BY K", "RUN"], [A, "1 in WORK.B update", "1 in WORK.C update"]),
    Family("DATA A; SET B; RETAIN T 0; T + V; RUN;", ["DATA A", "SET B", "RETAIN T 0", "T + V", "RUN"], [A, B], (True, False)),
    Family("DATA A; SET B; BY K; IF FIRST.K THEN N = 0; RUN;", ["DATA A", "SET B", "BY K", "IF FIRST.K THEN N = 0", "RUN"], [A, B], (True, False)),
    Family("DATA A; SET B; X = LAG(V); Y = X * 2; RUN;", ["DATA A", "SET B", "X = LAG(V)", "Y = X * 2", "RUN"], [A, B], (True, True)),
    Family("DATA A; DO I = 1 TO 3; OUTPUT; END; RUN;", ["DATA A", "DO I = 1 TO 3", "OUTPUT", "END", "RUN"], [A], (True, False)),
    Family("DATA A; SET B; WHERE K > 1; KEEP K; FORMAT K 8.; RUN;", ["DATA A", "SET B", "WHERE K > 1", "KEEP K", "FORMAT K 8.", "RUN"], [A, B]),
    Family("DATA A C; SET B; IF X THEN OUTPUT A; ELSE OUTPUT C; RUN;", ["DATA A C", "SET B", "IF X THEN OUTPUT A", "ELSE OUTPUT C", "RUN"],
           [A, "0 out WORK.C data", B], (True, False)),
    Family("DATA _NULL_; SET B; PUT K; RUN;", ["DATA _NULL_", "SET B", "PUT K", "RUN"], [B], (True, False)),
    Family("DATA A (KEEP=K V) DB.C (DROP=V); SET DB.B (WHERE=(K > 1)); RUN;", ["DATA A (KEEP=K V) DB.C (DROP=V)", "SET DB.B (WHERE=(K > 1))", "RUN"],
           [A, "0 out DB.C data", "1 in DB.B set"], place="hybrid"),
    Family("DATA DB.A; SET DB.B; X = 1; RUN;", ["DATA DB.A", "SET DB.B", "X = 1", "RUN"], ["0 out DB.A data", "1 in DB.B set"], (False, True), "hybrid"),
    Family("LIBNAME OWN ORACLE PATH=X; DATA OWN.A; SET OWN.B; RUN;", ["LIBNAME OWN ORACLE PATH=X", "DATA OWN.A", "SET OWN.B", "RUN"],
           ["1 out OWN.A data", "2 in OWN.B set"], place="sql_pushdown"),
    Family("LIBNAME DOCS '/data/docs'; DATA DOCS.A; SET DOCS.B; RUN;", ["LIBNAME DOCS '/data/docs'", "DATA DOCS.A", "SET DOCS.B", "RUN"],
           ["1 out DOCS.A data", "2 in DOCS.B set"], place="ambiguous"),
    Family("PROC APPEND BASE=DB.H DATA=NEWS@ FORCE; RUN;", ["PROC APPEND BASE=DB.H DATA=NEWS@ FORCE", "RUN"],
           ["0 in WORK.NEWS@ proc_append_data", "0 out DB.H proc_append_base"], place="hybrid"),
    Family("PROC DATASETS; APPEND BASE=DB.H DATA=DELTA; QUIT;", ["PROC DATASETS", "APPEND BASE=DB.H DATA=DELTA", "QUIT"],
           ["1 in WORK.DELTA append_data", "1 out DB.H append_base"], place="hybrid"),
    Family("PROC MEANS DATA=B NWAY; CLASS K; RUN;", ["PROC MEANS DATA=B NWAY", "CLASS K", "RUN"], ["0 in WORK.B proc_means_data"]),
    Family("PROC IMPORT DATAFILE='in.csv' OUT=A DBMS=CSV; RUN;", ["PROC IMPORT DATAFILE='in.csv' OUT=A DBMS=CSV", "RUN"], ["0 out WORK.A proc_import_out"]),
    Family("PROC EXPORT DATA=DB.A OUTFILE='o;x.csv' DBMS=CSV; RUN;", ["PROC EXPORT DATA=DB.A OUTFILE='o;x.csv' DBMS=CSV", "RUN"], ["0 in DB.A proc_export_data"], place="hybrid"),
    Family("PROC TRANSPOSE DATA=B OUT=T; BY K; ID M; VAR V; RUN;", ["PROC TRANSPOSE DATA=B OUT=T", "BY K", "ID M", "VAR V", "RUN"],
           ["0 in WORK.B proc_transpose_data", "0 out WORK.T proc_transpose_out"]),
    Family("%LET P = 2024;", ["%LET P = 2024"], place="utility"),
    Family("%MACRO M(X); DATA A; SET &X; RUN; %MEND;", ["%MACRO M(X)", "DATA A", "SET &X", "RUN", "%MEND"], ["1 out WORK.A data", "2 macro &MACRO.&X set"]),
    Family("", [], place="utility"),
    Family(";;; ;", [], place="utility"),
    Family("DATA A; SET B; RUN", ["DATA A", "SET B", "RUN"], [A, B]),
    Family("data a@; set b; run;", ["data a@", "set b", "run"], ["0 out WORK.A@ data", B]),
    Family("DATA A; X = '/* no; comment */'; RUN;", ["DATA A", "X = '/* no; comment */'", "RUN"], [A], (False, True)),
    Family("PROC SQL; SELECT * FROM A, B; QUIT;", ["PROC SQL", "SELECT * FROM A, B", "QUIT"], ["1 in WORK.A sql_from"]),
    Family('DATA A; X = "un;closed; SET B; RUN;', ["DATA A", 'X = "un;closed; SET B; RUN;'], [A], (False, True)),
]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"{name}({columns}) AS (VALUES " + ",\n ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def _expected(columns: str, rows: list[tuple], *shown: str) -> str:
    """Expected rows of all programs: the family's rows with the key put in."""
    key = "CAST(o_orderkey AS VARCHAR)"
    cols = ", ".join(f"replace({c}, '@', {key}) AS {c}" if c in ("stmt", "tab") else c for c in shown)
    cols = cols.replace(" AS tab", ' AS "table"')
    return f"WITH {_values('e', 'f, ' + columns, rows)} SELECT 'F' || {key} AS id, {cols} FROM orders JOIN e ON e.f = o_orderkey % {len(FAMILIES)}"


def _programs(t):
    made = t.spark.createDataFrame([(k, f.code) for k, f in enumerate(FAMILIES)], "f LONG, text STRING")
    keys = t.orders.select("o_orderkey", (F.col("o_orderkey") % len(FAMILIES)).alias("f"))
    key = F.col("o_orderkey").cast("string")
    spread = keys.repartition(t.spark.sparkContext.defaultParallelism, "o_orderkey")
    return spread.join(made, "f").select(F.concat(F.lit("F"), key).alias("id"), F.replace("text", F.lit("@"), key).alias("code"))


def _refs() -> list[tuple]:
    out = []
    for k, f in enumerate(FAMILIES):
        for ref in f.refs:
            pos, direction, name, kind = ref.split(" ")
            lib, tab = name.split(".", 1)
            out.append((k, int(pos), direction, lib, tab, kind))
    return out


@query("c1_statement_families", _expected("pos, stmt", [(k, i, s) for k, f in enumerate(FAMILIES) for i, s in enumerate(f.says)], "pos", "stmt"))
def _(t):
    return P.statements(_programs(t)).select("id", "pos", "stmt")


@query("c2_reference_families", _expected("pos, direction, libref, tab, kind", _refs(), "pos", "direction", "libref", "tab", "kind"))
def _(t):
    return P.dataset_refs(_programs(t)).select("id", "pos", "direction", "libref", "table", "kind")


@query("c28_logic_families", _expected("procedural, sql_expressible", [(k, *f.logic) for k, f in enumerate(FAMILIES) if f.logic], "procedural", "sql_expressible"))
def _(t):
    return P.step_logic(_programs(t)).select("id", "procedural", "sql_expressible")


@query("c27_place_families", _expected("placement", [(k, f.place) for k, f in enumerate(FAMILIES)], "placement"))
def _(t):
    libs = t.region.limit(1).select(F.lit("DB").alias("libref"))
    return P.place(P.place_facts(_programs(t)), libs).select("id", "placement")


@query(
    "c27_dataset_families",
    _expected(
        "inputs, outputs",
        [(k, *(",".join(sorted({r.split(" ")[2] for r in f.refs if r.split(" ")[1] == d})) for d in ("in", "out"))) for k, f in enumerate(FAMILIES)],
        "inputs", "outputs",
    ).replace(", inputs, outputs FROM", ", replace(inputs, '@', CAST(o_orderkey AS VARCHAR)) AS inputs, replace(outputs, '@', CAST(o_orderkey AS VARCHAR)) AS outputs FROM"),
)
def _(t):
    facts = P.place_facts(_programs(t))
    return facts.select("id", *[F.array_join(c, ",").alias(c) for c in ("inputs", "outputs")])
