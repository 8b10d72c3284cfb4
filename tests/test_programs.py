from tablesteps.plans import corpus as C
from tablesteps.plans import lineage as G
from tablesteps.plans import programs as P
from tablesteps.sources.archives import parse_archives
from tests.conftest import rows

BAD = [
    "", " ", ";", ";;;", "/* open", "'open", '"open', "data", "proc", "proc sql", "proc sql; create table", "%macro x",
    "﻿data a; set b; run;", "\x00\x01\x02", "* only comment", "%* c;", "x" * 20000 + ";", "((((", "data a(keep=(b(c))) d;",
    "proc sql; select * from", "&lib..t", "\n\n\r\n", "data _null_; run;",
]


def programs(spark, *codes):
    return spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(codes)], "id STRING, code STRING")


def stmts(spark, code):
    return [r["stmt"] for r in P.statements(programs(spark, code)).orderBy("pos").collect()]


def refs(spark, code, direction):
    df = P.dataset_refs(programs(spark, code)).filter(f"direction = '{direction}'").orderBy("pos", "libref", "table")
    return [f"{r['libref']}.{r['table']}" for r in df.collect()]


def test_bad_texts_never_fail(spark):
    df = programs(spark, *BAD)
    for out in (P.statements(df), P.blocks(df), P.dataset_refs(df), P.file_refs(df), P.step_logic(df), P.pack_blocks(df, 50)):
        out.collect()
    facts = P.place_facts(df)
    none = spark.createDataFrame([], "libref STRING")
    assert P.place(facts, none).count() == len(BAD)
    assert C.scan_rules(df).count() >= 0


def test_statements(spark):
    assert stmts(spark, "a = b * c; /* x; y */ d = 'p;q''r'; * gone; %* too; e;") == ["a = b * c", "d = 'p;q''r'", "e"]
    assert stmts(spark, 'x = "/* no comment */"; y /* cut') == ['x = "/* no comment */"', "y"]


def test_blocks_respect_comments_and_strings(spark):
    code = "%let a = 1;\n/* proc sort */\n* proc means;\nproc sql; x = '\ndata no';\n quit;\n  DATA out; run;\n"
    got = [(r["kind"], r["offset"]) for r in P.blocks(programs(spark, code)).orderBy("block").collect()]
    assert got == [("preambulo", 0), ("proc sql", code.index("proc sql")), ("data", code.index("  DATA out"))]


def test_references(spark):
    code = """data a lib.b (keep=x) / view=v; set x y(where=(z=1)) nobs=n; merge m; run;
    proc sql; create table w.t as select * from s1 inner join l.s2 t2 on 1=1; delete from w.t; quit;
    proc sort data=lib.q out=r; by x; run; set ignored;"""
    assert refs(spark, code, "out") == ["LIB.B", "WORK.A", "W.T", "WORK.R"]
    assert refs(spark, code, "in") == ["WORK.X", "WORK.Y", "WORK.M", "L.S2", "WORK.S1", "W.T", "LIB.Q"]
    assert refs(spark, "data out; set &lib..t; run;", "macro") == ["&MACRO.&lib..t"]


def test_state_does_not_leak(spark):
    tagged = P.tag_statements(programs(spark, "proc sql; a; data x; quit; data y; b; proc sort; c; data z; d; run; e;"))
    got = [(r["head"], r["in_sql"], r["in_data"]) for r in tagged.orderBy("pos").collect()]
    assert [g for g in got if g[1]] == [("a", True, False), ("data", True, False)]
    assert [g for g in got if g[2]] == [("b", False, True), ("d", False, True)]


def test_files(spark):
    code = """proc import datafile="in.csv" out=a; run; data x; infile 'raw.txt'; file "o.txt"; run;
    proc sql; create table t as select * from '/d/z.sas7bdat'; quit; data '/d/out.xpt'; set a; run;"""
    got = rows(P.file_refs(programs(spark, code)).select("mode", "path"))
    assert got == sorted([("read", "in.csv"), ("read", "raw.txt"), ("write", "o.txt"), ("read", "/d/z.sas7bdat"), ("write", "/d/out.xpt")], key=repr)


PLACES = [
    ("proc sql; connect to odbc as d (x); execute (drop table t) by d; quit;", "sql_passthrough", "sql_passthrough"),
    ("proc sql; create table db.a as select * from db.b; quit;", "sql_pushdown", "sql_pushdown"),
    ("proc sql; create table work.a as select * from db.b; quit;", "hybrid", "sql_pushdown"),
    ("data a; set b; x = 1; run;", "pandas", "sql_pushdown"),
    ("data db.a; set db.b; x = 1; run;", "hybrid", "sql_pushdown"),
    ("data db.a; set db.b; retain x; run;", "hybrid", "hybrid"),
    ("proc sort data=db.a out=db.b; run;", "sql_pushdown", "hybrid"),
    ("data a; set nolib.b; run;", "ambiguous", "ambiguous"),
    ("data out; set &x; run;", "pandas", "sql_pushdown"),
    ("proc print data=&x; run;", "ambiguous", "ambiguous"),
    ("%let a = 1;", "utility", "utility"),
    ("libname own oracle; data own.a; set own.b; run;", "sql_pushdown", "sql_pushdown"),
]


def test_places(spark):
    df = programs(spark, *[c for c, _, _ in PLACES])
    libs = spark.createDataFrame([("db",)], "libref STRING")
    facts = P.place_facts(df)
    for column, sql_first in ((1, False), (2, True)):
        got = {r["id"]: r["placement"] for r in P.place(facts, libs, sql_first).collect()}
        assert [got[f"p{i}"] for i in range(len(PLACES))] == [p[column] for p in PLACES]


def test_noise_library_settles_as_files(spark):
    df = programs(spark, "data a; set nolib.b; run;", "data db.a; set nolib.b; run;", "data a; set other.b; run;")
    libs = spark.createDataFrame([("DB",)], "libref STRING")
    none = spark.createDataFrame([], "libref STRING")
    facts = P.place_facts(df)
    noise = spark.createDataFrame([("NOLIB",)], "libref STRING")
    got = {r["id"]: r["placement"] for r in P.rejudge(facts, P.place(facts, libs), libs, none, noise).collect()}
    assert got == {"p0": "pandas", "p1": "hybrid"}


def test_rollup(spark):
    cases = {"a": ["utility"], "b": ["ambiguous", "pandas"], "c": ["sql_passthrough"], "d": ["sql_passthrough", "sql_pushdown", "utility"], "e": ["sql_pushdown", "pandas"], "f": ["hybrid", "pandas"], "g": ["pandas"]}
    df = spark.createDataFrame([(k, p) for k, ps in cases.items() for p in ps], "id STRING, placement STRING")
    got = {r["id"]: r["placement"] for r in P.rollup_verdict(df).collect()}
    assert got == dict(a="utility", b="ambiguous", c="sql_passthrough", d="sql_pushdown", e="hybrid", f="hybrid", g="pandas")


def test_packing(spark):
    code = "proc a;1\nproc b;2\nproc c;3\n"
    def pack(limit):
        return [r["text"] for r in P.pack_blocks(programs(spark, code), limit).orderBy("chunk").collect()]
    assert pack(100) == [code]
    assert pack(18) == ["proc a;1\nproc b;2\n", "proc c;3\n"]
    assert pack(5) == ["proc a;1\n", "proc b;2\n", "proc c;3\n"]  # blocks above the limit stand alone


def test_fan_in_with_a_hot_term(spark):
    df = spark.range(300).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id < 200 THEN 'hot' ELSE CAST(id AS STRING) END AS term")
    row = C.term_fan_in(df, "term", "id", 2).first()
    assert (row["term"], row["n_ids"], len(row["ids"])) == ("hot", 200, 20)
    assert C.term_members(df, "term", "id", 2).count() == 200


def test_name_coverage_whole_identifiers(spark):
    names = spark.createDataFrame([("a", f"WORK.N{i}") for i in range(5)], "id STRING, name STRING")
    texts = spark.createDataFrame([("a", "n0 n1 n2_temp"), ("a", "x = n3.copy()")], "id STRING, text STRING")
    row = C.name_coverage(names, texts).first()
    assert (row["n_found"], row["passed"], row["missing"]) == (3, False, ["n2", "n4"])


def test_topo_order_with_cycle(spark):
    nodes = spark.createDataFrame([("d", 0), ("c", 1), ("b", 2), ("a", 3), ("x", 4), ("y", 5), ("z", 6)], "id STRING, pos INT")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "gone")], "source STRING, target STRING")
    got = {r["id"]: (r["level"], r["topo_order"]) for r in G.topo_order(nodes, edges).collect()}
    assert got == {"d": (0, 0), "a": (0, 1), "b": (1, 2), "c": (2, 3), "x": (None, 4), "y": (None, 5), "z": (None, 6)}


def test_lineage_matches_full_before_short(spark):
    nodes = spark.createDataFrame(
        [("s", "DATA_STEP", "", [], ["A.T", "B.T", "C.U"]), ("t", "PROC_SORT", "", ["A.T", "X.T", "Y.U"], [])],
        "id STRING, node_type STRING, code STRING, inputs ARRAY<STRING>, outputs ARRAY<STRING>",
    )
    edges = spark.createDataFrame([("s", "t"), ("s", "t")], "source STRING, target STRING")
    got = rows(G.lineage(nodes, edges).select("source_dataset", "target_dataset"))
    assert got == [("A.T", "A.T"), ("B.T", "X.T"), ("C.U", "Y.U")]


def test_broken_archive_is_a_row(spark):
    files = spark.createDataFrame([("x.egp", bytearray(b"no zip"))], "path STRING, content BINARY")
    out = parse_archives(files)
    assert out.errors.count() == 1 and out.nodes().count() == 0


def test_long_chain_and_ring_in_topo_order(spark):
    from tablesteps.plans import lineage as L

    n = 5000
    edges = [(k, k + 1) for k in range(n)] + [(n, n + 1), (n - 3, n + 1), (9001, 9002), (9002, 9003), (9003, 9001), (9003, 9010), (8000, 8001), (8001, 8000), (8001, 8002)]
    ids = sorted({x for e in edges for x in e} | {7777})
    nodes = spark.createDataFrame([(str(i), i) for i in ids], "id STRING, pos LONG")
    links = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source STRING, target STRING")
    got = {int(r["id"]): (r["level"], r["topo_order"]) for r in L.topo_order(nodes, links).collect()}
    assert all(got[k][0] == k for k in range(n + 2)) and got[7777][0] == 0
    assert all(got[k][0] is None for k in (9001, 9002, 9003, 9010, 8000, 8001, 8002))
    assert sorted(o for _, o in got.values()) == list(range(len(ids)))
    assert max(got[k][1] for k in range(n + 2)) < min(got[k][1] for k in (9001, 8000))


def test_a_task_of_program_texts_does_not_grow_with_the_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablesteps.queries import base

    monkeypatch.setattr(base, "PROGRAMS_PER_TASK", 60)
    tables = base.Tables(spark, "/root/testdata/sf0.001")
    counts = [r[0] for r in tables.programs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(counts) >= 20 and max(counts) < 150 and sum(counts) == tables.orders.count()


def test_places_read_texts_once(spark):
    """Rows with no, one and several outside libraries, known or not; the result no longer reads the texts."""
    df = programs(spark, "data a; set b; run;", "data a; set db.b; run;", "data a; set no.b; run;", "data a; set db.b no.c; run;", "data a; set db.b db2.c; run;", "")
    libs = spark.createDataFrame([("db",), ("DB2",), ("DB",)], "libref STRING")
    out = P.place(P.place_facts(df), libs)
    got = {r["id"]: (r["placement"], r["unknown_libs"], r["touches_db"]) for r in out.collect()}
    assert got == {
        "p0": ("pandas", [], False), "p1": ("hybrid", [], True), "p2": ("ambiguous", ["NO"], False),
        "p3": ("ambiguous", ["NO"], True), "p4": ("hybrid", [], True), "p5": ("utility", [], False),
    }
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_statements_that_name_no_dataset_are_left_out_before_their_words(spark):
    codes = [
        *BAD, "LIBNAME GG ODBC DSN=X; DATA A(KEEP=X) GG.B; SET C; IF X; RUN;", "PROC SQL; CREATE TABLE GG.R AS SELECT * FROM A JOIN B ON 1; QUIT;",
        "PROC SORT DATA=GG.R OUT=S; BY X; RUN;", "PROC DATASETS; APPEND BASE=GG.H DATA=D; QUIT;", "<data x; set y; data q; merge r s / z;", "append base=a data=b; x = 1;",
    ]
    df = programs(spark, *codes)
    assert rows(P.dataset_refs(df)) == rows(P.dataset_refs(df, tagged=P.tag_statements(df)))
    kept = P.tag_statements(programs(spark, *codes[-6:-2]), referring=True)
    assert sorted(r["head"] for r in kept.collect()) == ["append", "create", "data", "proc", "set"]
    got = {r["id"]: (r["inputs"], r["outputs"]) for r in G.program_io(programs(spark, "RUN;", codes[-6], None)).collect()}
    assert got == {"p0": ([], []), "p1": (["WORK.C"], ["GG.B", "WORK.A"]), "p2": ([], [])}
