"""Queries for the reconciliation and the profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablesteps.operators import profile as Q
from tablesteps.operators import reconcile as R
from tablesteps.operators.steps import stack
from tablesteps.queries.base import query
from tablesteps.session import scratch_dir

_REF = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_MOVED = "SELECT o_orderkey, lower(o_orderstatus) || ' ' AS o_orderstatus, o_totalprice + 0.01 AS o_totalprice, o_orderpriority FROM orders"
_HOLES = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders"""
_LESS = "SELECT o_orderkey, o_orderstatus, o_totalprice + 0.000000001 AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2000 <> 7"


def _sides(t, text):
    return t.sql(_REF), t.sql(text)


@query(
    "r1_compare_schema",
    """SELECT 'schema' AS test, 1 AS level, count(*) FILTER (c.column_name = 'o_custkey') = 0 AS passed, 'o_custkey' AS missing_columns, 'extra' AS extra_columns
FROM (DESCRIBE SELECT * FROM orders) AS c""",
)
def _(t):
    ref, gen = t.orders, t.orders.drop("o_custkey").withColumn("extra", F.lit(1))
    out = R.compare_schema(ref.withColumnRenamed("o_totalprice", "﻿o_totalprice"), gen)
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing_columns", "extra_columns")})


@query(
    "r1_hollow_columns",
    """SELECT c AS "column", n AS reference_values FROM (SELECT 'value' AS c, count(value) AS n FROM events
 UNION ALL SELECT 'props', count(props) FROM events) WHERE n > 0""",
)
def _(t):
    gen = t.events.withColumns({"value": F.lit(float("nan")), "props": F.lit(None).cast("string")})
    return R.hollow_columns(t.events, gen)


@query(
    "r2_compare_counts",
    """WITH c AS (SELECT (SELECT count(*) FROM orders) AS reference_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 2000 <> 7) AS generated_rows)
SELECT 'row_count' AS test, 2 AS level, abs(reference_rows - generated_rows) <= floor(reference_rows * 0.001) AS passed,
 reference_rows, generated_rows, abs(reference_rows - generated_rows) AS difference FROM c""",
)
def _(t):
    return R.compare_counts(*_sides(t, _LESS))


def _agg_sql(ref, gen):
    rows = []
    for col in ("o_orderkey", "o_totalprice"):
        for name, fn in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
            rows.append(
                f"SELECT '{col}' AS \"column\", '{name}' AS aggregate, CAST((SELECT {fn}({col}) FROM r) AS DOUBLE) AS reference,"
                f" CAST((SELECT {fn}({col}) FROM g) AS DOUBLE) AS generated"
            )
    body = "\nUNION ALL ".join(rows)
    return f"""WITH r AS ({ref}), g AS ({gen}), x AS ({body})
SELECT "column", aggregate, round(reference, 2) AS reference, round(generated, 2) AS generated,
 round(abs(reference - generated) / greatest(abs(reference), 1e-15), 9) AS relative_diff,
 abs(reference - generated) / greatest(abs(reference), 1e-15) <= 1e-6 AS passed FROM x"""


@query("r3_compare_aggregates", _agg_sql(_REF, _HOLES))
def _(t):
    out = R.compare_aggregates(*_sides(t, _HOLES))
    return out.withColumns(
        {"reference": F.round("reference", 2), "generated": F.round("generated", 2), "relative_diff": F.round("relative_diff", 9)}
    )


_MIXED = """SELECT event_id, CAST(value AS VARCHAR(30)) AS amount, CASE WHEN event_id % 3 = 0 THEN 'n.d.' ELSE '12' END AS mostly,
 event_type FROM events"""


@query(
    "r4_classify_columns",
    f"""WITH s AS ({_MIXED}), n AS (SELECT count(*) AS n FROM s), b AS (SELECT count(*) AS b FROM s WHERE mostly = 'n.d.')
SELECT 'event_id' AS "column", true AS is_numeric, CAST(0 AS BIGINT) AS lost_in_ref, CAST(0 AS BIGINT) AS lost_in_gen
UNION ALL SELECT 'amount', true, 0, 0
UNION ALL SELECT 'mostly', (SELECT b FROM b) < 0.5 * (SELECT n FROM n), (SELECT b FROM b), (SELECT b FROM b)
UNION ALL SELECT 'event_type', false, 0, 0""",
)
def _(t):
    src = t.sql(_MIXED.replace("VARCHAR(30)", "STRING"))
    return R.classify_columns(src, src)


@query(
    "r5_sort_keys",
    """SELECT k AS "column" FROM (SELECT 'o_orderpriority' AS k, 0 AS n UNION ALL SELECT 'o_orderstatus', 0
 UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey) FROM orders) WHERE n < 1000""",
)
def _(t):
    src = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    types = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_orderpriority": False}
    return t.spark.createDataFrame([(c,) for c in R.sort_keys(src, types)], "column STRING")


def _values_sql(gen, keyed):
    """Pairs rows like the operator: text keys first, the other columns break ties."""
    order = "p, s, k, v NULLS LAST"
    norm = (
        "SELECT CAST(o_orderkey AS DOUBLE) AS k, lower(trim(o_orderstatus)) AS s, CAST(o_totalprice AS DOUBLE) AS v,"
        " lower(trim(o_orderpriority)) AS p FROM ({})"
    )
    join = "r.k = g.k" if keyed else "r.i = g.i"
    tests = [
        ("o_totalprice", "numeric", "max(abs(r.v - g.v))", "avg(abs(r.v - g.v))", "count(*) FILTER (abs(r.v - g.v) > 1e-6)"),
        ("o_totalprice", "null_pattern", "NULL", "NULL", "count(*) FILTER ((r.v IS NULL) <> (g.v IS NULL))"),
        ("o_orderstatus", "string", "NULL", "NULL", "count(*) FILTER (r.s <> g.s)"),
        ("o_orderpriority", "string", "NULL", "NULL", "count(*) FILTER (r.p <> g.p)"),
    ]
    if not keyed:
        tests.append(("o_orderkey", "numeric", "max(abs(r.k - g.k))", "avg(abs(r.k - g.k))", "count(*) FILTER (abs(r.k - g.k) > 1e-6)"))
    rows = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, round(CAST({mx} AS DOUBLE), 6) AS max_diff,"
        f" round(CAST({mean} AS DOUBLE), 4) AS mean_diff, {n} AS rows_affected FROM r JOIN g ON {join}"
        for c, k, mx, mean, n in tests
    )
    keys = (
        "\nUNION ALL SELECT NULL, 'missing_keys', NULL, NULL, (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM g))"
        "\nUNION ALL SELECT NULL, 'extra_keys', NULL, NULL, (SELECT count(*) FROM (SELECT k FROM g EXCEPT SELECT k FROM r))"
        if keyed
        else ""
    )
    return f"""WITH r0 AS ({norm.format(_REF)}), g0 AS ({norm.format(gen)}),
 r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM r0), g AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM g0)
SELECT * FROM ({rows}{keys}) WHERE rows_affected > 0"""


def _rounded(out):
    return out.withColumns({"max_diff": F.round("max_diff", 6), "mean_diff": F.round("mean_diff", 4)})


@query("r6_values_positional", _values_sql(_MOVED, False))
def _(t):
    return _rounded(R.compare_values(*_sides(t, _MOVED)))


@query("r6_values_positional_holes", _values_sql(_HOLES, False))
def _(t):
    return _rounded(R.compare_values(*_sides(t, _HOLES)))


@query("r6_values_keyed", _values_sql(_HOLES, True))
def _(t):
    return _rounded(R.compare_values(*_sides(t, _HOLES), keys=["o_orderkey"]))


@query("r9_proc_compare", _values_sql(_LESS, True))
def _(t):
    return _rounded(R.proc_compare(*_sides(t, _LESS), id=["o_orderkey"]))


_BIG = "SELECT o_orderkey, 9007199254740992 + o_orderkey{} AS big, CAST(9007199254740992 + o_orderkey{} AS DECIMAL(38, 0)) AS wide FROM orders"
_TENTH = " + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END"


@query(
    "r6_values_bigint",
    """SELECT c AS "column", 'numeric' AS kind, CAST(1 AS DOUBLE) AS max_diff, round(count(*) FILTER (o_orderkey % 10 = 0) / count(*), 4) AS mean_diff,
 count(*) FILTER (o_orderkey % 10 = 0) AS rows_affected FROM orders, (VALUES ('big'), ('wide')) AS v(c) GROUP BY c""",
)
def _(t):
    return _rounded(R.compare_values(t.sql(_BIG.format("", "")), t.sql(_BIG.format(_TENTH, _TENTH)), keys=["o_orderkey"]))


@query(
    "r6_values_nan",
    """SELECT 'value' AS "column", 'null_pattern' AS kind, CAST(NULL AS DOUBLE) AS max_diff, CAST(NULL AS DOUBLE) AS mean_diff,
 count(*) AS rows_affected FROM events WHERE event_id % 14 = 0""",
)
def _(t):
    """NaN on one side and NULL on the other are both missing."""
    ref = t.sql("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events")
    gen = t.sql("SELECT event_id, CASE WHEN event_id % 14 = 0 THEN 0.5 WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
    return _rounded(R.compare_values(ref, gen, keys=["event_id"]))


@query(
    "r6_values_mixed_text",
    """SELECT 'code' AS "column", 'lost_cells' AS kind, CAST(NULL AS DOUBLE) AS max_diff, CAST(NULL AS DOUBLE) AS mean_diff,
 count(*) AS rows_affected FROM orders WHERE o_orderkey % 9 = 0""",
)
def _(t):
    text = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '{}' WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE CAST(o_orderkey AS STRING) END AS code FROM orders"
    return _rounded(R.compare_values(t.sql(text.format("zz")), t.sql(text.format("QQ")), keys=["o_orderkey"]))


@query(
    "r6_values_surplus",
    """SELECT CAST(NULL AS VARCHAR) AS "column", 'surplus_rows' AS kind, CAST(NULL AS DOUBLE) AS max_diff, CAST(NULL AS DOUBLE) AS mean_diff,
 count(*) AS rows_affected FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""",
)
def _(t):
    ref = t.sql("SELECT o_orderkey FROM orders")
    return _rounded(R.compare_values(ref, t.sql("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)")))


_TWINS = "SELECT o_orderstatus AS s, CASE WHEN o_orderkey % 100 = {} THEN 'zz' ELSE o_orderpriority END AS p FROM orders"


@query(
    "r6_values_duplicate_rows",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY p, s) AS i FROM (SELECT lower(trim(s)) AS s, lower(trim(p)) AS p FROM ({_TWINS.format(-1)}))),
 g AS (SELECT *, row_number() OVER (ORDER BY p, s) AS i FROM (SELECT lower(trim(s)) AS s, lower(trim(p)) AS p FROM ({_TWINS.format(0)})))
SELECT * FROM (SELECT 'p' AS "column", 'string' AS kind, CAST(NULL AS DOUBLE) AS max_diff, CAST(NULL AS DOUBLE) AS mean_diff,
 count(*) FILTER (r.p <> g.p) AS rows_affected FROM r JOIN g USING (i)
UNION ALL SELECT 's', 'string', NULL, NULL, count(*) FILTER (r.s <> g.s) FROM r JOIN g USING (i)) WHERE rows_affected > 0""",
)
def _(t):
    return _rounded(R.compare_values(t.sql(_TWINS.format(-1)), t.sql(_TWINS.format(0))))


def _tests_sql(gen, keyed):
    """Test rows of a cascade over orders whose schema and counts agree."""
    nothing = "CAST(NULL AS VARCHAR)"
    return f"""WITH a AS ({_agg_sql(_REF, gen)}), v AS ({_values_sql(gen, keyed)}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders)
SELECT 'schema' AS test, 1 AS level, true AS passed, {nothing} AS "column", 'summary' AS kind, CAST(NULL AS DOUBLE) AS reference,
 CAST(NULL AS DOUBLE) AS generated, CAST(NULL AS DOUBLE) AS difference, CAST(NULL AS BIGINT) AS rows_affected, 'missing: ; extra: ' AS detail
UNION ALL SELECT 'row_count', 2, true, NULL, 'summary', n, n, 0, NULL, NULL FROM n
UNION ALL SELECT 'aggregate_comparison', 5, count(*) = 0, NULL, 'summary', NULL, NULL, NULL, count(*), NULL FROM a WHERE NOT passed
UNION ALL SELECT 'aggregate_comparison', 5, false, "column", aggregate, reference, generated, relative_diff, NULL, NULL FROM a WHERE NOT passed
UNION ALL SELECT 'value_comparison', 4, count(*) = 0, NULL, 'summary', NULL, NULL, NULL, count(*), NULL FROM v
UNION ALL SELECT 'value_comparison', 4, false, "column", kind, NULL, NULL, max_diff, rows_affected, NULL FROM v"""


def _rounded_tests(out):
    return out.withColumns({"reference": F.round("reference", 2), "generated": F.round("generated", 2), "difference": F.round("difference", 9)})


_SAME = _LESS.replace(" WHERE o_orderkey % 2000 <> 7", "")


@query("r7_reconcile", _tests_sql(_HOLES, True))
def _(t):
    return _rounded_tests(R.reconcile(*_sides(t, _HOLES), keys=["o_orderkey"]))


@query("r7_reconcile_pass", _tests_sql(_SAME, False))
def _(t):
    return _rounded_tests(R.reconcile(*_sides(t, _SAME)))


@query(
    "r8_reconcile_all",
    f"""WITH o AS ({_tests_sql(_HOLES, False)}), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer)
SELECT 'ORDERS' AS target_table, 'FAIL' AS overall_status, '' AS message, * FROM o
UNION ALL SELECT 'CUSTOMER', 'PASS', '', 'schema', 1, true, NULL, 'summary', NULL, NULL, NULL, NULL, 'missing: ; extra: '
UNION ALL SELECT 'CUSTOMER', 'PASS', '', 'row_count', 2, true, NULL, 'summary', n, n, 0, NULL, NULL FROM c
UNION ALL SELECT 'CUSTOMER', 'PASS', '', test, level, true, NULL, 'summary', NULL, NULL, NULL, 0, NULL
 FROM (VALUES ('aggregate_comparison', 5), ('value_comparison', 4)) AS t(test, level)
UNION ALL SELECT '(all)', NULL, 'full', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def _(t):
    return _rounded_tests(_reconcile_all(t))


def _reconcile_all(t):
    targets = {"ORDERS": t.sql(_HOLES), "CUSTOMER": t.customer}
    refs = {"orders": t.sql(_REF), "customer": t.customer, "lone": t.region}
    results, summary = R.reconcile_all(
        t.spark, refs, ["lib.ORDERS", "lib.CUSTOMER", "lib.ABSENT"], lambda name: targets[name]
    )
    return stack(results, summary.select(F.lit("(all)").alias("target_table"), F.col("validation_mode").alias("message")))


@query(
    "r8_reconcile_summary",
    """SELECT 'full' AS validation_mode, CAST(1 AS INT) AS total_tables, CAST(count(*) > 0 AS INT) AS passed, CAST(count(*) = 0 AS INT) AS failed,
 CAST(0 AS INT) AS errors, CAST(1 AS DOUBLE) AS pass_rate, 'ABSENT' AS unvalidated_targets, 'LONE' AS unmatched_references FROM customer""",
)
def _(t):
    refs = {"customer": t.customer, "lone": t.region}
    out = R.reconcile_all(t.spark, refs, ["lib.CUSTOMER", "lib.ABSENT"], lambda name: t.customer)[1]
    return out.withColumns({c: F.array_join(c, ",") for c in ("unvalidated_targets", "unmatched_references")})


@query(
    "r10_diagnose_surplus",
    """SELECT CAST(NULL AS VARCHAR) AS "column", 'missing_transform' AS cause, count(*) AS rows_affected, 'surplus_in_b' AS expected FROM orders WHERE o_orderkey % 40 = 1
UNION ALL SELECT NULL, 'missing_transform', count(*), 'missing_in_b' FROM orders WHERE o_orderkey % 50 = 2 AND o_orderkey % 40 <> 1""",
)
def _(t):
    """Some keys come twice in the migrated table and some not at all."""
    ref = t.orders.select("o_orderkey", "o_totalprice")
    gen = ref.filter("o_orderkey % 50 <> 2 OR o_orderkey % 40 = 1").unionByName(ref.filter("o_orderkey % 40 = 1"))
    return R.diagnose(ref, gen, keys=["o_orderkey"]).select("column", "cause", "rows_affected", "expected")


_DIAG = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
 o_totalprice + 0.004 AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 50 <> 3"""


@query(
    "r10_diagnose",
    f"""WITH r AS ({_REF}), g AS ({_DIAG}), j AS (SELECT r.*, g.o_orderstatus AS gs, g.o_orderpriority AS gp FROM r JOIN g USING (o_orderkey))
SELECT 'o_orderstatus' AS "column", 'collation' AS cause, count(*) FILTER (o_orderstatus <> gs) AS rows_affected FROM j
UNION ALL SELECT 'o_totalprice', 'rounding', count(*) FROM j
UNION ALL SELECT 'o_orderpriority', 'null_semantics', count(*) FILTER (gp IS NULL) FROM j
UNION ALL SELECT NULL, 'missing_transform', (SELECT count(*) FROM r WHERE o_orderkey % 50 = 3)""",
)
def _(t):
    return R.diagnose(*_sides(t, _DIAG), keys=["o_orderkey"]).select("column", "cause", "rows_affected")


@query(
    "r11_verify_tables",
    """SELECT 'default.' || lower(r_name) AS qualified_name, 'c' || r_regionkey AS alias, CASE WHEN r_regionkey % 2 = 0 THEN 'target' ELSE 'source' END AS role,
 false AS "exists", CASE WHEN r_regionkey % 2 = 0 THEN 'missing_target' ELSE 'missing_source' END AS problem FROM region""",
)
def _(t):
    conns = t.region.select(
        F.concat(F.lit("c"), "r_regionkey").alias("alias"),
        F.lit("default").alias("schema_name"),
        F.when(F.col("r_regionkey") % 2 == 0, "target").otherwise("source").alias("role"),
        F.array(F.lower("r_name")).alias("tables"),
    )
    return R.verify_tables(t.spark, conns)


# --- profiles --------------------------------------------------------------------------------


def _profile_sql(table, cols):
    rows = []
    for i, (col, dtype, num) in enumerate(cols):
        stat = f"CAST(min({col}) AS VARCHAR), CAST(max({col}) AS VARCHAR), round(avg({col}), 4)" if num else "NULL, NULL, CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT CAST({i} AS INT), '{col}', '{dtype}', count(*), count(*) - count({col}), round((count(*) - count({col})) / count(*), 4),"
            f" round((count(*) - count({col})) * 100.0 / count(*), 2), count(DISTINCT {col}), {stat} FROM {table}"
        )
    body = "\nUNION ALL ".join(rows)
    return f"""SELECT * FROM ({body}) AS p(position, "column", dtype, row_count, null_count, null_share, null_pct, unique_count, min_val, max_val, mean_val)"""


@query(
    "q1_profile",
    _profile_sql(
        "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 1) END AS value FROM events)",
        [("event_id", "bigint", True), ("user_id", "bigint", True), ("event_type", "string", False), ("value", "double", True)],
    ),
)
def _(t):
    return Q.profile(t.events_gap.select("event_id", "user_id", "event_type", F.round("value", 1).alias("value")), exact=True)


@query(
    "q1_profile_sketches",
    """SELECT c AS "column", n AS row_count, n - filled AS null_count, lo AS min_val, hi AS max_val, true AS close FROM (
 SELECT 'o_orderkey' AS c, count(*) AS n, count(o_orderkey) AS filled, CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders
 UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders
 UNION ALL SELECT 'o_orderpriority', count(*), count(o_orderpriority), NULL, NULL FROM orders)""",
)
def _(t):
    """Sketches of periods are stored, one period is loaded again, and the profile is merged from the store."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("period"))
    path = f"{scratch_dir(t.spark)}/sketches-{uuid.uuid4().hex}"
    Q.update_sketches(rows, path, "period")
    Q.update_sketches(rows.filter("period = 1995"), path, "period")
    merged = Q.sketch_profile(t.spark.read.parquet(path))
    exact = Q.profile(rows.drop("period"), exact=True).select("column", F.col("unique_count").alias("exact"))
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.04 * F.col("exact")  # five standard errors
    return merged.join(exact, "column").select("column", "row_count", "null_count", "min_val", "max_val", close.alias("close"))


@query(
    "q2_samples",
    """WITH u AS (SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
 UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT "column", string_agg(value, '|' ORDER BY value) AS sample_values FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rn FROM u)
WHERE rn <= 5 GROUP BY 1""",
)
def _(t):
    out = Q.column_samples(t.orders.select("o_orderstatus", "o_custkey", "o_orderpriority"), 5)
    return out.withColumn("sample_values", F.array_join("sample_values", "|"))


_SENT = """SELECT event_id, CASE CAST(event_id % 50 AS INT) WHEN 1 THEN 'N/A' WHEN 2 THEN 'S/I' WHEN 3 THEN '-999' ELSE event_type END AS event_type,
 CASE WHEN event_id % 60 = 0 THEN '...' ELSE props END AS props, 1 AS ene, 2 AS feb, 3 AS "2024", 4 AS q1 FROM events"""


@query(
    "q3_find_artifacts",
    """SELECT 'sentinel_values' AS artifact_type, 'event_type' AS location, '-999|N/A|S/I' AS found
UNION ALL SELECT 'sentinel_values', 'props', min('...') FROM events WHERE event_id % 60 = 0
UNION ALL SELECT 'pivoted_layout', 'column headers', 'ene|feb|2024|q1'""",
)
def _(t):
    out = Q.find_artifacts(t.sql(_SENT.replace('"2024"', "`2024`")))
    return out.withColumn("found", F.array_join("found", "|"))


def _q5_sql():
    tables = {
        "db:dwh/orders": ("orders", [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False)]),
        "db:dwh/customer": ("customer", [("c_custkey", "bigint", True), ("c_mktsegment", "string", False)]),
    }
    parts = [f"SELECT *, '{source}' AS source, false AS failed FROM ({_profile_sql(table, cols)})" for source, (table, cols) in tables.items()]
    return "\nUNION ALL ".join(parts) + "\nUNION ALL SELECT " + "NULL, " * 11 + "'file:absent', true\nUNION ALL SELECT " + "NULL, " * 11 + "'db:dwh/failing', true"


@query("q5_profile_tables", _q5_sql())
def _(t):
    """Two sources that can be read, one that is absent, one that fails while it is read."""
    tables = {
        "db:dwh/orders": lambda: t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"),
        "db:dwh/customer": lambda: t.customer.select("c_custkey", "c_mktsegment"),
        "file:absent": lambda: t.spark.read.parquet(f"{t.sf_dir}/absent.parquet"),
        "db:dwh/failing": lambda: t.orders.select(F.raise_error(F.concat(F.lit("no "), "o_orderstatus")).cast("bigint").alias("x")),
    }
    out = Q.profile_tables(t.spark, tables, exact=True)
    return out.withColumn("failed", F.col("error").isNotNull()).drop("error")
