"""Queries for ledgers, queues and the call trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.functions.scalars import content_hash
from tablesteps.plans import ledger as K
from tablesteps.plans import trace as A
from tablesteps.queries.base import query


@query(
    "a7_trace_summary",
    """SELECT task, count(*) AS calls, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (starts_with(outcome, 'needs_human')) AS needs_human,
 count(*) FILTER (starts_with(outcome, 'error')) AS errors, sum(duration_ms)::BIGINT AS duration_ms, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens,
 sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens FROM trace GROUP BY 1""",
    uses=("trace",),
)
def _(t):
    return A.trace_summary(t.trace)


_COST = """c AS (SELECT t.*, (coalesce(input_tokens, 0) * CAST(p.input AS DOUBLE) + output_tokens * CAST(p.output AS DOUBLE) + cache_read_tokens * CAST(p.cache_read AS DOUBLE)
 + cache_write_tokens * CAST(p.cache_write AS DOUBLE)) / 1000000 AS cost, row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC) AS rn
 FROM trace t LEFT JOIN prices p ON starts_with(model, prefix))"""


@query(
    "a8_trace_totals",
    f"""WITH {_COST}, x AS (SELECT * FROM c WHERE rn = 1), k AS (SELECT task, sum(coalesce(input_tokens, 0) + output_tokens)::BIGINT AS spent FROM x GROUP BY 1)
SELECT round(sum(cost), 4) AS cost_usd, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
 sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, count(cost) AS priced_calls, count(*) - count(cost) AS unpriced_calls,
 (SELECT string_agg(task || '=' || spent, ',' ORDER BY task) FROM k) AS tokens_by_task FROM x""",
    uses=("trace", "prices"),
)
def _(t):
    prices = t.prices.select("prefix", *[F.col(c).cast("double") for c in ("input", "output", "cache_read", "cache_write")])
    out = A.trace_totals(t.trace, prices).withColumn("cost_usd", F.round("cost_usd", 4))
    entries = F.transform(F.map_entries("tokens_by_task"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("tokens_by_task", F.array_join(F.array_sort(entries), ","))


_PREV = "p AS (SELECT id, 'reviewed' AS status, 'seen' AS note FROM programs WHERE pos % 4 = 0)"


def _previous(t):
    return t.programs.filter("pos % 4 = 0").select(
        "id", F.lit("reviewed").alias("status"), F.lit("seen").alias("note"), F.lit("2024-01-01").cast("timestamp").alias("reviewed_at")
    )


@query(
    "u10_ledger_init",
    f"""WITH {_PREV} SELECT id, pfd_id AS batch, coalesce(status, 'pending') AS status, coalesce(note, '') AS note FROM programs LEFT JOIN p USING (id)""",
    uses=("programs",),
)
def _(t):
    return K.ledger_init(t.programs, _previous(t)).select("id", "batch", "status", "note")


def _reviews(t):
    """Review events from the event table: some for unknown ids, some blank, several per id."""
    return t.events.select(
        F.concat(F.lit("N"), (F.col("event_id") % 3000 * 7).cast("string")).alias("id"),
        F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("note"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
    )


_REV = """r AS (SELECT 'N' || (event_id % 3000 * 7) AS id, trim(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type || ' ' || event_id END) AS note, ts, event_id FROM events),
 n AS (SELECT id, note FROM r WHERE note <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)"""


@query(
    "u10_ledger_sync",
    f"""WITH {_PREV}, {_REV} SELECT l.id, pfd_id AS batch, CASE WHEN p.id IS NOT NULL OR l.id IN (SELECT id FROM r) THEN 'reviewed' ELSE 'pending' END AS status,
 coalesce(n.note, p.note, '') AS note FROM programs l LEFT JOIN p ON p.id = l.id LEFT JOIN n ON n.id = l.id""",
    uses=("programs",),
)
def _(t):
    ledger = K.ledger_init(t.programs, _previous(t))
    return K.ledger_sync(ledger, _reviews(t), order=("at", "event_id"))[0].select("id", "batch", "status", "note")


@query(
    "u10_ledger_unknown",
    f"""WITH {_REV} SELECT DISTINCT id FROM r WHERE id NOT IN (SELECT id FROM programs)""",
    uses=("programs",),
)
def _(t):
    return K.ledger_sync(K.ledger_init(t.programs, None), _reviews(t), order=("at", "event_id"))[1]


@query(
    "u10_ledger_status",
    """WITH x AS (SELECT pfd_id AS batch, id, pos % 4 = 0 AS done, row_number() OVER (PARTITION BY pfd_id, pos % 4 = 0 ORDER BY id) AS rn FROM programs)
SELECT batch, count(*) AS total, count(*) FILTER (done) AS reviewed, count(*) FILTER (NOT done) AS pending,
 string_agg(CASE WHEN NOT done AND rn <= 20 THEN id END, ',' ORDER BY id) AS first_pending FROM x GROUP BY 1""",
    uses=("programs",),
)
def _(t):
    out = K.ledger_status(K.ledger_init(t.programs, _previous(t)))
    return out.withColumn("first_pending", F.array_join("first_pending", ","))


def _queue(t):
    return t.orders.filter("o_orderkey % 10 = 0").select(
        F.concat(F.lit("NH-"), F.lpad((F.col("o_orderkey") / 10).cast("long").cast("string"), 5, "0")).alias("id"),
        F.lit(6).alias("phase"), F.lit("translate").alias("task"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("node_id"),
        F.when(F.col("o_orderkey") % 20 == 0, "refusal").alias("reason"), F.lit("old").alias("detail"), F.lit(2).cast("long").alias("attempts"),
        (F.col("o_orderkey") % 30 == 0).alias("resolved"), F.lit(None).cast("string").alias("resolution"),
    )


def _failures(t):
    return t.events.select(
        F.lit(6).alias("phase"), F.lit("translate").alias("task"), F.concat(F.lit("N"), (F.col("event_id") % 900 * 5).cast("string")).alias("node_id"),
        F.when(F.col("event_id") % 900 * 5 % 20 == 0, "refusal").alias("reason"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("detail"),
        (F.col("event_id") % 7).alias("attempts"), F.col("ts").cast("timestamp").alias("at"),
    )


_QUEUE = """q AS (SELECT 'NH-' || lpad(CAST(o_orderkey // 10 AS VARCHAR), 5, '0') AS id, 'N' || o_orderkey AS node_id, CASE WHEN o_orderkey % 20 = 0 THEN 'refusal' END AS reason,
 2 AS attempts, o_orderkey % 30 = 0 AS resolved FROM orders WHERE o_orderkey % 10 = 0),
 f AS (SELECT 'N' || (event_id % 900 * 5) AS node_id, CASE WHEN event_id % 900 * 5 % 20 = 0 THEN 'refusal' END AS reason, max(event_id % 7) AS a,
 max_by(CASE WHEN event_id % 3 <> 0 THEN 'd' || event_id END, CASE WHEN event_id % 3 <> 0 THEN ts END) AS d FROM events GROUP BY ALL)"""


@query(
    "u11_queue_upsert",
    f"""WITH {_QUEUE}, o AS (SELECT * FROM q WHERE NOT resolved),
 u AS (SELECT o.id, o.node_id, o.reason, coalesce(f.d, 'old') AS detail, greatest(attempts, coalesce(f.a, 0)) AS attempts, false AS resolved FROM o LEFT JOIN f ON f.node_id = o.node_id AND f.reason IS NOT DISTINCT FROM o.reason),
 s AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE f.node_id = o.node_id AND f.reason IS NOT DISTINCT FROM o.reason))
SELECT * FROM u UNION ALL SELECT id, node_id, reason, 'old', attempts, resolved FROM q WHERE resolved
UNION ALL SELECT 'NH-' || lpad(n, CAST(greatest(3, length(n)) AS INTEGER), '0'), node_id, reason, coalesce(d, ''), a, false FROM (
 SELECT *, CAST(row_number() OVER (ORDER BY node_id, reason NULLS FIRST) + (SELECT max(CAST(substr(id, 4) AS BIGINT)) FROM q) AS VARCHAR) AS n FROM s)""",
)
def _(t):
    return K.queue_upsert(_queue(t), _failures(t)).select("id", "node_id", "reason", "detail", "attempts", "resolved")


@query(
    "u11_iteration_upsert",
    """SELECT CAST(o_orderkey AS BIGINT) AS cycle, CASE WHEN o_orderkey % 2 = 0 THEN 'in_progress' WHEN o_orderkey % 3 = 0 THEN 'deferred' ELSE 'completed' END AS status FROM orders""",
)
def _(t):
    log = t.orders.select(F.col("o_orderkey").alias("cycle"), F.when(F.col("o_orderkey") % 3 == 0, "in_progress").otherwise("completed").alias("status"))
    return K.iteration_upsert(log, t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("cycle"), F.lit("in_progress").alias("status")))


@query(
    "u12_queue_resolve",
    f"""WITH {_QUEUE} SELECT id, node_id, resolved OR CAST(substr(node_id, 2) AS BIGINT) % 50 = 0 AS resolved,
 CASE WHEN NOT resolved AND CAST(substr(node_id, 2) AS BIGINT) % 50 = 0 THEN 'rerun ok' END AS resolution FROM q""",
)
def _(t):
    fixed = t.orders.filter("o_orderkey % 50 = 0").select(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return K.queue_resolve(_queue(t), fixed, 6, "translate", "rerun ok").select("id", "node_id", "resolved", "resolution")


@query(
    "u13_carry_over",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'fresh' WHEN c_custkey % 2 = 0 THEN 'kept' ELSE '' END AS notes,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS class FROM customer""",
)
def _(t):
    new = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "fresh").otherwise("").alias("notes"))
    old = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("kept").alias("notes"), F.col("c_mktsegment").alias("class"))
    return K.carry_over(new, old, "c_custkey", ["notes", "class"])


@query(
    "u14_changed_only",
    """SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0 OR conv_id % 7 = 0 OR conv_id % 11 = 0""",
)
def _(t):
    now = content_hash(t.conversations, "conv_id", ["turn", "text"], "text").withColumnRenamed("content_hash", "hash")
    edited = t.conversations.withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    before = content_hash(edited.filter("conv_id % 5 <> 0"), "conv_id", ["turn", "text"], "text").select(
        "conv_id", F.col("content_hash").alias("hash"), F.when(F.col("conv_id") % 11 == 0, "FAIL").otherwise("PASS").alias("status")
    )
    return K.changed_only(now, before, "conv_id").select("conv_id")
