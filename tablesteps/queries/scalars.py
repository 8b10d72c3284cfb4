"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.functions import scalars as S
from tablesteps.queries.base import query


@query(
    "f1_to_num",
    """SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 5 = 1 THEN ' 12.5 ' ELSE CAST(event_id AS VARCHAR) END) AS DOUBLE) AS num
FROM events""",
)
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 5 == 1, " 12.5 ").otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", S.to_num(raw).alias("num"))


@query(
    "f2_to_dmy",
    """SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS VARCHAR) AS d FROM orders""",
)
def _(t):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "31-02-2020").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return t.orders.select("o_orderkey", S.to_dmy(raw).cast("string").alias("d"))


@query(
    "f3_put",
    """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS z, format('{:,.2f}', o_totalprice) AS comma,
 translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS commax, CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS VARCHAR) AS wd,
 strftime(o_orderdate, '%d/%m/%Y') AS dmy, upper(strftime(o_orderdate, '%d%b%Y')) AS d9, o_orderstatus AS txt FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        S.put("o_custkey", "z8.").alias("z"),
        S.put("o_totalprice", "comma12.2").alias("comma"),
        S.put("o_totalprice", "commax12.2").alias("commax"),
        S.put(F.col("o_totalprice").cast("decimal(18,2)"), "12.1").alias("wd"),
        S.put("o_orderdate", "ddmmyy10.").alias("dmy"),
        S.put("o_orderdate", "date9.").alias("d9"),
        S.put("o_orderstatus", "$1.").alias("txt"),
    )


@query("f4_put_yymm", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS periodo FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.put_yymm("o_orderdate").alias("periodo"))


@query(
    "f5_intnx_month",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS nxt,
 CAST(date_trunc('month', CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH) AS DATE)::VARCHAR AS beg,
 CAST(last_day(CAST(o_orderdate AS DATE) + INTERVAL 13 MONTH) AS DATE)::VARCHAR AS fin FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        S.intnx_month("o_orderdate", 1).cast("string").alias("nxt"),
        S.intnx_month("o_orderdate", -2, "b").cast("string").alias("beg"),
        S.intnx_month("o_orderdate", 13, "e").cast("string").alias("fin"),
    )


@query(
    "f6_intck_month",
    "SELECT l_orderkey, l_linenumber, l_partkey, datediff('month', DATE '1995-06-17', CAST(l_shipdate AS DATE)) AS months FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.intck_month(F.lit("1995-06-17").cast("date"), "l_shipdate").alias("months")
    )


@query(
    "f7_mdy",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(TRY_CAST(printf('%04d-%02d-%02d', 1999, CAST(l_linenumber * 2 AS INT), CAST(l_quantity AS INT)) AS DATE) AS VARCHAR) AS d
FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.mdy(F.col("l_linenumber") * 2, "l_quantity", F.lit(1999)).cast("string").alias("d"),
    )


@query("f8_datepart", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")
def _(t):
    return t.events.select("event_id", S.datepart("ts").cast("string").alias("d"))


@query(
    "f9_day_number",
    """SELECT o_orderkey, datediff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS n,
 CAST(DATE '1960-01-01' + CAST(o_orderkey % 30000 AS INT) AS VARCHAR) AS d FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        S.to_day_number("o_orderdate").alias("n"),
        S.from_day_number(F.col("o_orderkey") % 30000).cast("string").alias("d"),
    )


@query("f10_today", "SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2024-02-29') AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.datediff(S.today("2024-02-29"), F.to_date("o_orderdate")).cast("long").alias("age"))


@query(
    "f11_last_day",
    "SELECT o_orderkey, day(last_day(CAST(o_orderdate AS DATE))) AS last FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", S.last_day(F.year("o_orderdate"), F.month("o_orderdate")).alias("last"))


@query("f12_coalesce", "SELECT event_id, coalesce(value, 0) AS v FROM events_gap", uses=("events_gap",))
def _(t):
    return t.events_gap.select("event_id", F.coalesce("value", F.lit(0.0)).alias("v"))


@query(
    "f13_text",
    """SELECT c_custkey, replace(c_mktsegment || ' x y', ' ', '') AS a, trim('  ' || c_name || ' ') AS b, upper(c_name) AS c, lower(c_name) AS d FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        S.compress(F.concat("c_mktsegment", F.lit(" x y"))).alias("a"),
        S.strip(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("b"),
        S.upcase("c_name").alias("c"),
        S.lowcase("c_name").alias("d"),
    )


@query("f14_substr", "SELECT c_custkey, substr(c_name, 3, 5) AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.substr("c_name", 3, 5).alias("s"))


@query(
    "f15_scan",
    """SELECT o_orderkey, CASE WHEN len(string_split(o_orderpriority, '-')) >= 2 THEN string_split(o_orderpriority, '-')[2] END AS second,
 string_split(o_orderpriority, '-')[-1] AS last, string_split(o_orderpriority, '-')[9] AS none FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        S.scan("o_orderpriority", 2, "-").alias("second"),
        S.scan("o_orderpriority", -1, "-").alias("last"),
        S.scan("o_orderpriority", 9, "-").alias("none"),
    )


@query(
    "f16_catx",
    "SELECT c_custkey, concat_ws('|', nullif(trim(c_name), ''), nullif(trim(' '), ''), CASE WHEN c_nationkey > 10 THEN trim(c_mktsegment) END) AS s FROM customer",
)
def _(t):
    seg = F.when(F.col("c_nationkey") > 10, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", S.catx("|", "c_name", F.lit(" "), seg).alias("s"))


@query(
    "f17_round",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 2, 0) AS half, round(l_quantity / 4, 1) AS quarter FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.round_half_up(F.col("l_quantity") / 2).alias("half"),
        S.round_half_up(F.col("l_quantity") / 4, 1).alias("quarter"),
    )


@query(
    "f18_names",
    """SELECT id, dataset, lower(split_part(dataset, '.', -1)) AS base, upper(split_part(dataset, '.', -1)) AS bare,
 CASE WHEN contains(split_part(dataset, '.', -1), '.') THEN upper(split_part(dataset, '.', -1)) ELSE 'WORK.' || upper(split_part(dataset, '.', -1)) END AS qualified
FROM node_outputs""",
    uses=("node_outputs",),
)
def _(t):
    return t.node_outputs.select(
        "id", "dataset",
        S.base_name("dataset").alias("base"),
        S.base_name("dataset", upper=True).alias("bare"),
        S.qualify(S.base_name("dataset")).alias("qualified"),
    )


@query(
    "f19_slugify",
    r"""WITH s AS (SELECT n_nationkey, concat('  Ñandú & ', n_name, ' Año (', CAST(n_nationkey AS VARCHAR), ')! ') AS label FROM nation)
SELECT n_nationkey, regexp_replace(lower(regexp_replace(strip_accents(label), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS slug FROM s""",
)
def _(t):
    label = F.concat(F.lit("  Ñandú & "), "n_name", F.lit(" Año ("), F.col("n_nationkey").cast("string"), F.lit(")! "))
    return t.nation.select("n_nationkey", S.slugify(label).alias("slug"))


@query(
    "f20_url_host",
    r"""WITH h AS (SELECT page_id, lower(split_part(split_part(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.\-]*://([^/\s?"'']+)', 1), '@', -1), ':', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN regexp_matches(host, '[&%]') THEN '' ELSE host END AS host FROM h""",
)
def _(t):
    return t.pages.select("page_id", S.url_host("url").alias("host"))


@query(
    "f23_credential_name",
    "SELECT event_id, regexp_matches(lower(event_type || CASE WHEN event_id % 3 = 0 THEN '_KEY' ELSE '' END), 'user|pass|pwd|uid|token|secret|key|cred|auth') AS credential FROM events",
)
def _(t):
    name = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_KEY").otherwise(""))
    return t.events.select("event_id", S.is_credential_name(name).alias("credential"))


@query("f24_sha12", "SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", S.sha12("text").alias("h"))


@query(
    "f25_norm_block",
    r"""SELECT id, upper(trim(regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))) AS norm FROM programs""",
    uses=("programs",),
)
def _(t):
    return t.programs.select("id", S.norm_block("code").alias("norm"))
