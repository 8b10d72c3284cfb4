"""Queries for row steps, joins, summaries and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.functions import scalars as S
from tablesteps.operators import expand as X
from tablesteps.operators import joins as J
from tablesteps.operators import ordered as O
from tablesteps.operators import procs as P
from tablesteps.operators import steps as D
from tablesteps.queries.base import query

# --- row steps -------------------------------------------------------------------------------


@query("p2_keep_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _(t):
    return D.keep_rows(t.orders, "o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query(
    "p3_derive",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * 2 AS doubled, upper(l_returnflag) AS flag FROM lineitem",
)
def _(t):
    out = D.derive(t.lineitem, doubled="l_extendedprice * 2", flag=F.upper("l_returnflag"))
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "doubled", "flag")


@query(
    "p4_if_else",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders""",
)
def _(t):
    band = D.if_else([("o_totalprice > 200000", "high"), ("o_totalprice > 100000", "mid")])
    done = D.if_else([(F.col("o_orderstatus") == "F", 1)], 0)
    return t.orders.select("o_orderkey", band.alias("band"), done.alias("done"))


@query("p5_keep_drop", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return D.drop(D.keep(t.customer, ["c_custkey", "c_acctbal", "c_name"]), ["c_name"])


@query("p6_rename", "SELECT n_nationkey AS id, n_name AS nombre, n_regionkey FROM nation")
def _(t):
    return D.rename(t.nation, {"n_nationkey": "id", "n_name": "nombre"})


@query(
    "p7_missing_low",
    """SELECT event_id, (value IS NULL OR value < 50) AS lt, (value IS NOT NULL AND value >= 50) AS ge,
  (value IS NULL) AS eq_missing, (value IS NOT NULL) AS gt_missing FROM events_gap""",
    uses=("events_gap",),
)
def _(t):
    return t.events_gap.select(
        "event_id",
        D.missing_low("value", "<", 50).alias("lt"),
        D.missing_low("value", ">=", 50).alias("ge"),
        D.missing_low("value", "==", F.lit(None).cast("double")).alias("eq_missing"),
        D.missing_low("value", ">", F.lit(None).cast("double")).alias("gt_missing"),
    )


@query(
    "p8_calculated",
    """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_quantity * 2 + 1 AS q3 FROM lineitem WHERE l_quantity * 2 > 90""",
)
def _(t):
    return D.sql_select(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity * 2 AS q2", "q2 + 1 AS q3"], "q2 > 90")


@query("p10_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return D.distinct(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "p11_split_rows",
    """SELECT 'big' AS target, o_orderkey FROM orders WHERE o_totalprice > 150000
UNION ALL SELECT 'open' AS target, o_orderkey FROM orders WHERE o_orderstatus = 'O'""",
)
def _(t):
    parts = D.split_rows(t.orders, {"big": "o_totalprice > 150000", "open": "o_orderstatus = 'O'"})
    return D.stack(*[d.select(F.lit(n).alias("target"), "o_orderkey") for n, d in parts.items()])


@query(
    "k6_delete_where",
    "SELECT event_id, value FROM events_gap WHERE NOT coalesce(value > 50, false)",
    uses=("events_gap",),
)
def _(t):
    return D.keep_not(t.events_gap, "value > 50").select("event_id", "value")


@query(
    "k7_update_where",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_totalprice > 100000 THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return D.update_where(base, {"o_totalprice": "o_totalprice + 10", "o_orderstatus": "'B'"}, "o_totalprice > 100000")


@query("k8_add_column", "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS extra FROM region")
def _(t):
    return D.add_column(t.region, "extra", "double")


# --- sorts, dedupe, set operations -----------------------------------------------------------


@query(
    "o1_proc_sort",
    """SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey ASC) AS _n_ FROM customer""",
)
def _(t):
    rows = O.row_counter(
        t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"),
        ["c_mktsegment", "c_acctbal", "c_custkey"],
        desc=["c_acctbal"],
    )
    return D.proc_sort(rows, ["_n_"]).select("c_custkey", "_n_")


@query(
    "o2_nodupkey",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    return D.nodupkey(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@query("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(t):
    return D.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 15, ["o_orderkey"])


@query(
    "o4_stack",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return D.stack(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(
    "o5_union_corr",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS DOUBLE) AS n FROM customer
UNION ALL SELECT s_name, s_acctbal FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), "c_name")
    b = t.supplier.select(F.col("s_name").alias("id"), F.col("s_acctbal").alias("n"))
    return D.stack(a, b, corresponding=True)


@query(
    "o6_dedupe",
    """SELECT source, target, pos FROM (SELECT l_orderkey AS source, l_linenumber AS target, l_partkey AS pos,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("target"), F.col("l_partkey").alias("pos")
    )
    return D.dedupe(rows, ["source", "target"], ["pos"])


@query(
    "o7_set_equal",
    """WITH n AS (SELECT DISTINCT id FROM programs), m AS (SELECT DISTINCT id FROM mappings),
 a AS (SELECT id FROM n EXCEPT SELECT id FROM m), b AS (SELECT id FROM m EXCEPT SELECT id FROM n)
SELECT (SELECT count(*) FROM a) = 0 AND (SELECT count(*) FROM b) = 0 AS equal, (SELECT count(*) FROM a) AS only_a,
 (SELECT count(*) FROM b) AS only_b,
 (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM a ORDER BY id LIMIT 10)) AS sample_a,
 (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM b ORDER BY id LIMIT 10)) AS sample_b""",
    uses=("programs", "mappings"),
)
def _(t):
    out = J.set_equal(t.programs, t.mappings, "id")
    return out.withColumns({c: F.concat_ws(",", c) for c in ("sample_a", "sample_b")})


@query("o8_union_ids", "SELECT id FROM ignored UNION SELECT id FROM mappings", uses=("ignored", "mappings"))
def _(t):
    return D.union_ids(t.ignored, t.mappings, "id")


# --- merge family ----------------------------------------------------------------------------

_MERGE = """SELECT coalesce(a.k, b.k) AS k, a.bal AS bal_x, a.seg, b.bal AS bal_y, b.nat, a.m IS NOT NULL AS in_a, b.m IS NOT NULL AS in_b
FROM (SELECT *, 1 AS m FROM left_k) a {how} JOIN (SELECT *, 1 AS m FROM right_k) b ON a.k IS NOT DISTINCT FROM b.k"""


def _merge_query(name, keep, how):
    @query(name, _MERGE.format(how=how), uses=("left_k", "right_k"))
    def _(t):
        return J.merge_by(t.left_k, t.right_k, ["k"], keep=keep, in_=("in_a", "in_b"))


_merge_query("j1_merge_by", "all", "FULL")
_merge_query("j2_merge_both", "both", "INNER")
_merge_query("j3_merge_left", "left", "LEFT")
_merge_query("j3_merge_right", "right", "RIGHT")


@query(
    "j1_merge_overlay",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.m IS NOT NULL THEN b.bal ELSE a.bal END AS bal, a.seg, b.nat
FROM (SELECT *, 1 AS m FROM left_k WHERE k IS NOT NULL) a FULL JOIN (SELECT *, 1 AS m FROM right_k WHERE k IS NOT NULL) b
ON a.k = b.k""",
    uses=("left_k", "right_k"),
)
def _(t):
    return J.merge_by(t.left_k.dropna(subset=["k"]), t.right_k.dropna(subset=["k"]), ["k"], overlay=True)


@query(
    "j4_merge_left_only",
    "SELECT k, bal, seg FROM left_k a WHERE NOT EXISTS (SELECT 1 FROM right_k b WHERE a.k IS NOT DISTINCT FROM b.k)",
    uses=("left_k", "right_k"),
)
def _(t):
    return J.merge_by(t.left_k, t.right_k, ["k"], keep="left_only")


@query(
    "j4_merge_right_only",
    "SELECT k, bal, nat FROM right_k b WHERE NOT EXISTS (SELECT 1 FROM left_k a WHERE a.k IS NOT DISTINCT FROM b.k)",
    uses=("left_k", "right_k"),
)
def _(t):
    return J.merge_by(t.left_k, t.right_k, ["k"], keep="right_only")


@query(
    "j5_sql_join",
    """SELECT o_orderkey, c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2""",
)
def _(t):
    out = J.sql_join(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey") * 2, "left")
    return out.select("o_orderkey", "c_custkey", "c_mktsegment")


@query("j6_cross", "SELECT n_name, r_name FROM nation, region")
def _(t):
    return J.cross(t.nation.select("n_name"), t.region.select("r_name"))


@query(
    "j7_key_diff",
    """SELECT id, 'missing_in_b' AS side FROM (SELECT id FROM programs EXCEPT SELECT id FROM mappings)
UNION ALL SELECT id, 'extra_in_b' FROM (SELECT id FROM mappings EXCEPT SELECT id FROM programs)""",
    uses=("programs", "mappings"),
)
def _(t):
    return J.key_diff(t.programs, t.mappings, "id")


@query(
    "j8_scope",
    """SELECT id, id IN (SELECT id FROM ignored) AS ignored FROM programs""",
    uses=("programs", "ignored"),
)
def _(t):
    p = t.programs.select("id")
    return J.in_scope(p, t.ignored, "id").withColumn("ignored", F.lit(True)).unionByName(
        J.out_of_scope(p, t.ignored, "id").withColumn("ignored", F.lit(False))
    )


@query(
    "j9_match_two_tier",
    """WITH a AS (SELECT DISTINCT dataset AS name_a, upper(dataset) AS f, split_part(upper(dataset), '.', -1) AS s FROM node_outputs),
 b AS (SELECT DISTINCT dataset AS name_b, upper(dataset) AS f, split_part(upper(dataset), '.', -1) AS s FROM node_inputs),
 x AS (SELECT name_a, name_b, 'full' AS tier FROM a JOIN b USING (f)),
 ra AS (SELECT * FROM a WHERE f NOT IN (SELECT f FROM b) QUALIFY row_number() OVER (PARTITION BY s ORDER BY f) = 1),
 rb AS (SELECT * FROM b WHERE f NOT IN (SELECT f FROM a) QUALIFY row_number() OVER (PARTITION BY s ORDER BY f) = 1)
SELECT * FROM x UNION ALL SELECT name_a, name_b, 'short' FROM ra JOIN rb USING (s)""",
    uses=("node_outputs", "node_inputs"),
)
def _(t):
    return J.match_two_tier(t.node_outputs, t.node_inputs, "dataset")


@query(
    "j10_resolve_owner",
    """WITH w AS (SELECT DISTINCT dataset AS table_name FROM node_outputs)
SELECT table_name, CASE WHEN upper(table_name) IN ('GG.R1', 'GG.R3') THEN 'eu' ELSE 'dwh' END AS alias,
 CASE WHEN upper(table_name) IN ('GG.R1', 'GG.R3') THEN 'listed' ELSE 'role' END AS rule FROM w""",
    uses=("node_outputs",),
)
def _(t):
    conns = t.region.select(
        F.col("r_regionkey").alias("position"),
        F.element_at(F.array(*map(F.lit, ["raw", "dwh", "eu", "x3", "x4"])), F.col("r_regionkey") + 1).alias("alias"),
        F.element_at(F.array(*map(F.lit, ["source", "target", "both", "source", "source"])), F.col("r_regionkey") + 1).alias("role"),
        F.when(F.col("r_regionkey") == 2, F.array(F.lit("gg.r1"), F.lit("GG.R3"))).otherwise(F.array().cast("array<string>")).alias("tables"),
    )
    return J.resolve_owner(t.node_outputs.withColumnRenamed("dataset", "table_name"), conns)


@query(
    "j11_prefix_join",
    """SELECT event_id, model, prefix AS matched_prefix, input FROM (SELECT event_id, model, prefix, CAST(input AS DOUBLE) AS input,
 row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC) AS rn
 FROM trace LEFT JOIN prices ON starts_with(model, prefix)) WHERE rn = 1""",
    uses=("trace", "prices"),
)
def _(t):
    prices = t.prices.select("prefix", F.col("input").cast("double").alias("input"))
    return J.prefix_join(t.trace.select("event_id", "model"), prices, "model")


@query(
    "j12_update_by",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(b.bal, a.bal) AS bal, coalesce(b.seg, a.seg) AS seg
FROM (SELECT * FROM left_k WHERE k IS NOT NULL) a FULL JOIN (SELECT k, CASE WHEN k % 2 = 0 THEN bal END AS bal,
 CASE WHEN k % 7 = 0 THEN 'NEW' END AS seg FROM right_k WHERE k IS NOT NULL) b ON a.k = b.k""",
    uses=("left_k", "right_k"),
)
def _(t):
    trans = t.right_k.dropna(subset=["k"]).selectExpr(
        "k", "CASE WHEN k % 2 = 0 THEN bal END AS bal", "CASE WHEN k % 7 = 0 THEN 'NEW' END AS seg"
    )
    return J.update_by(t.left_k.dropna(subset=["k"]), trans, ["k"])


@query(
    "j12_update_repeated",
    """WITH m AS (SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS status FROM customer),
t AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS bal,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS status, o_orderkey AS seq FROM orders),
last AS (SELECT k, arg_max(bal, seq) FILTER (bal IS NOT NULL) AS bal, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, max(seq) AS seq FROM t GROUP BY k)
SELECT coalesce(m.k, last.k) AS k, coalesce(last.bal, m.bal) AS bal, coalesce(last.status, m.status) AS status, seq FROM m FULL JOIN last ON m.k = last.k""",
)
def _(t):
    master = t.sql("SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS STRING) AS status FROM customer")
    trans = t.sql(
        "SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS bal,"
        " CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS status, o_orderkey AS seq FROM orders"
    )
    return J.update_by(master, trans, ["k"], order_by=["seq"])


@query(
    "w8_hourly",
    """WITH c AS (SELECT event_type, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS period, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period FROM c GROUP BY 1)
SELECT event_type, CAST(epoch(g.period) AS BIGINT) AS period, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, period)""",
)
def _(t):
    counted = t.events.withColumn("n", F.lit(1))
    out = P.proc_timeseries(counted, ["event_type"], "ts", interval="hour", acc="sum", var="n", fill="zero")
    return out.select("event_type", F.unix_timestamp("period").alias("period"), "n")


@query(
    "w12_pick_best",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def _(t):
    return J.pick_best(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


# --- summaries -------------------------------------------------------------------------------

_DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def _cents(df, *cols):
    """Money columns as decimals, so that sums do not depend on the order of addition."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


def _plain(df):
    return df.select(*[F.col(c).cast("double") if ty.startswith("decimal") else F.col(c) for c, ty in df.dtypes])


@query(
    "a1_proc_means",
    f"""SELECT l_returnflag, l_linestatus, round({_DEC.format('l_quantity')} / count(l_quantity), 4) AS l_quantity_mean,
 {_DEC.format('l_quantity')} AS l_quantity_sum, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
 count(l_quantity) AS l_quantity_count FROM lineitem GROUP BY ALL""",
)
def _(t):
    out = P.proc_means(_cents(t.lineitem, "l_quantity"), ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return _plain(out).withColumn("l_quantity_mean", F.round("l_quantity_mean", 4))


@query(
    "a2_proc_means_types",
    f"""SELECT l_returnflag, l_linestatus, CAST((CASE WHEN grouping(l_returnflag) = 0 THEN 2 ELSE 0 END) +
 (CASE WHEN grouping(l_linestatus) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS _TYPE_, count(*) AS _FREQ_,
 {_DEC.format('l_extendedprice')} AS l_extendedprice_sum, count(l_extendedprice) AS l_extendedprice_n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def _(t):
    src = _cents(t.lineitem, "l_extendedprice")
    return _plain(P.proc_means(src, ["l_returnflag", "l_linestatus"], ["l_extendedprice"], ["sum", "n"], types=True))


@query(
    "a3_proc_freq",
    "SELECT o_orderpriority, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY 1",
)
def _(t):
    return _plain(P.proc_freq(t.orders, "o_orderpriority"))


@query(
    "a4_crosstab",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
 count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def _(t):
    return P.proc_freq(t.orders, "o_orderpriority", "o_orderstatus", values=["F", "O", "P"])


@query(
    "a5_transpose",
    """SELECT o_custkey, {} FROM orders GROUP BY 1""".format(
        ", ".join(
            f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (substr(o_orderpriority, 1, 1) = '{i}') AS DOUBLE) AS p_{i}"
            for i in range(1, 6)
        )
    ),
)
def _(t):
    cells = (
        t.orders.withColumn("prio", F.substring("o_orderpriority", 1, 1))
        .groupBy("o_custkey", "prio")
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    )
    return P.transpose(cells, ["o_custkey"], "prio", "total", prefix="p_", values=["1", "2", "3", "4", "5"])


@query(
    "a6_sql_summary",
    """SELECT c_mktsegment, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def _(t):
    from tablesteps.sources.readers import read_where

    orders = read_where(t.spark, t.orders, "o_orderstatus = :p", {"p": "F"})
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_extendedprice")
    customers = t.customer.select("c_custkey", "c_mktsegment")
    out = P.sql_summary(
        J.sql_join(lines, orders, ["l_orderkey"]),
        customers,
        ["c_custkey"],
        ["c_mktsegment"],
        {"total": "CAST(l_extendedprice AS DECIMAL(18,2))"},
    )
    return _plain(out)


# --- ordered operators -----------------------------------------------------------------------

_EW = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "w1_first_last",
    f"""SELECT event_id, user_id, row_number() {_EW} = 1 AS first,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last FROM events""",
)
def _(t):
    src = t.events.select("event_id", "user_id", "ts")
    return O.first_last(src, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "first", "last")


@query(
    "w2_last_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def _(t):
    return O.last_per_group(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@query(
    "w3_retain_sum",
    """SELECT event_id, user_id, CAST(sum(coalesce(CAST(value AS DECIMAL(18,4)), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS acum FROM events_gap""",
    uses=("events_gap",),
)
def _(t):
    src = t.events_gap.withColumn("value", F.col("value").cast("decimal(18,4)"))
    out = O.retain_sum(src, ["user_id"], "value", ["ts", "event_id"])
    return out.select("event_id", "user_id", F.col("acum").cast("double").alias("acum"))


@query(
    "w4_retain_last",
    """SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS retained FROM events_gap""",
    uses=("events_gap",),
)
def _(t):
    return O.retain_last(t.events_gap, ["user_id"], "value", ["ts", "event_id"]).select("event_id", "user_id", "retained")


@query(
    "w5_lag_dif",
    f"SELECT event_id, lag(value, 1) {_EW} AS lag1, lag(value, 3) {_EW} AS lag3, value - lag(value, 1) {_EW} AS dif1 FROM events",
)
def _(t):
    out = O.lag_n(t.events, ["user_id"], "value", ["ts", "event_id"])
    out = O.lag_n(out, ["user_id"], "value", ["ts", "event_id"], n=3)
    return O.dif_n(out, ["user_id"], "value", ["ts", "event_id"]).select("event_id", "lag1", "lag3", "dif1")


@query(
    "w6_row_counter",
    f"SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS _n_, row_number() {_EW} AS in_user FROM events",
)
def _(t):
    src = t.events.select("event_id", "user_id", "ts")
    out = O.row_counter(src, ["ts", "event_id"])
    return O.row_counter(out, ["ts", "event_id"], by=["user_id"], name="in_user").select("event_id", "_n_", "in_user")


@query(
    "w7_proc_rank",
    """WITH b AS (SELECT o_orderkey, o_orderpriority, floor(o_totalprice / 1000) AS v FROM orders),
 r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY v) AS lo, count(*) OVER (PARTITION BY o_orderpriority, v) AS n,
 dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY v) AS de, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM b)
SELECT o_orderkey, CAST(lo AS DOUBLE) AS low, lo + (n - 1) / 2 AS mean, CAST(de AS DOUBLE) AS dense,
 CAST(floor((lo + (n - 1) / 2) * 10 / (size + 1)) AS DOUBLE) AS decile FROM r""",
)
def _(t):
    out = t.orders.select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    by = ["o_orderpriority"]
    out = P.proc_rank(out, "v", by, ties="low", name="low")
    out = P.proc_rank(out, "v", by, ties="mean", name="mean")
    out = P.proc_rank(out, "v", by, ties="dense", name="dense")
    return P.proc_rank(out, "v", by, groups=10, name="decile").select("o_orderkey", "low", "mean", "dense", "decile")


@query(
    "w8_proc_timeseries",
    """WITH c AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS period, max(value) AS value FROM events GROUP BY 1, 2),
 g AS (SELECT user_id, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period FROM c GROUP BY 1)
SELECT g.user_id, CAST(g.period AS VARCHAR) AS period, last_value(c.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.period
 ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.period = c.period""",
)
def _(t):
    out = P.proc_timeseries(t.events, ["user_id"], "ts", "day", acc="max", fill="previous")
    return out.withColumn("period", F.col("period").cast("string"))


_GAPS = """WITH c AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS period, max(value) AS value FROM events GROUP BY 1, 2),
 g AS (SELECT user_id, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period FROM c GROUP BY 1),
 k AS (SELECT g.user_id, g.period, epoch(g.period) / 86400 AS x, c.value FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.period = c.period)"""


@query(
    "w8_expand_linear",
    f"""{_GAPS},
 w AS (SELECT *, CASE WHEN value IS NOT NULL THEN x END AS kx, user_id AS u FROM k),
 n AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS y0, last_value(kx IGNORE NULLS) OVER a AS x0,
  first_value(value IGNORE NULLS) OVER b AS y1, first_value(kx IGNORE NULLS) OVER b AS x1 FROM w
  WINDOW a AS (PARTITION BY u ORDER BY x ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY u ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, CAST(period AS VARCHAR) AS period, round(CASE WHEN value IS NOT NULL THEN value ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 6) AS value FROM n""",
)
def _(t):
    out = X.proc_expand(t.events, ["user_id"], "ts", "day", acc="max", method="linear")
    return out.withColumns({"period": F.col("period").cast("string"), "value": F.round("value", 6)})


@query("w8_expand_spline")
def _(t):
    out = X.proc_expand(t.events, ["user_id"], "ts", "day", acc="max", method="spline")
    return out.withColumn("period", F.col("period").cast("string"))


@query(
    "w9_budget_cut",
    """SELECT event_id, spent_before, spent_before < 100000 AS allowed FROM (SELECT event_id, coalesce(CAST(sum(output_tokens)
 OVER (ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent_before FROM trace)""",
    uses=("trace",),
)
def _(t):
    from tablesteps.plans.ledger import budget_cut

    out = budget_cut(t.trace, cap=100000, cost="output_tokens", order_by=["at", "event_id"])
    return out.select("event_id", "spent_before", "allowed")


@query(
    "w10_number_groups",
    """WITH n AS (SELECT pfd_id, count(*) AS nodes FROM programs WHERE id NOT IN (SELECT id FROM ignored) AND pfd_id <> 'PFD-3' GROUP BY 1)
SELECT pfd_id, nodes, 'NB-' || lpad(CAST(row_number() OVER (ORDER BY pfd_id) AS VARCHAR), 2, '0') AS number FROM n""",
    uses=("programs", "ignored"),
)
def _(t):
    from tablesteps.plans.plan import number_groups

    kept = J.out_of_scope(t.programs.filter("pfd_id <> 'PFD-3'"), t.ignored, "id")
    return number_groups(kept.groupBy("pfd_id").agg(F.count(F.lit(1)).alias("nodes")), ["pfd_id"])


@query(
    "w11_next_id",
    """SELECT max(TRY_CAST(regexp_extract(id, '^N([0-9]+)$', 1) AS BIGINT)) + 1 AS n,
 'N' || CAST(max(TRY_CAST(regexp_extract(id, '^N([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR) AS next_id FROM mappings""",
    uses=("mappings",),
)
def _(t):
    from tablesteps.plans.ledger import next_id

    return next_id(t.mappings, "id", "N")


@query(
    "f24_content_hash",
    r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, coalesce(text, '') AS text FROM conversations),
 d AS (SELECT conv_id, sha256(CAST(pos AS VARCHAR) || chr(1) || text) AS h FROM c)
SELECT conv_id, count(*) AS n_cells, sha256(concat_ws('-',
 {})) AS content_hash FROM d GROUP BY 1""".format(
        ", ".join(
            f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4)
        )
    ),
)
def _(t):
    return S.content_hash(t.conversations, "conv_id", ["turn", "text"], "text")
