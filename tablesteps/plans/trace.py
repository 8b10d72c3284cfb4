"""Roll-ups of the call trace: outcomes per task, run totals with prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.operators.joins import prefix_join

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
PRICE_OF = dict(zip(TOKENS, ("input", "output", "cache_read", "cache_write"), strict=True))


def flatten_usage(trace: DataFrame) -> DataFrame:
    """Trace lines with the nested usage as flat token columns."""
    usage = {
        "input_tokens": "usage.input_tokens",
        "output_tokens": "usage.output_tokens",
        "cache_read_tokens": "usage.cache_read_input_tokens",
        "cache_write_tokens": "usage.cache_creation_input_tokens",
    }
    return trace.withColumns({n: F.col(e) for n, e in usage.items()}).withColumn("has_usage", F.col("usage").isNotNull())


def _sum(name: str) -> Column:
    return F.sum(F.coalesce(name, F.lit(0))).cast("long").alias(name)


def outcome_columns() -> list[Column]:
    """Aggregates shared by the batch and the streaming roll-up."""
    outcome = F.coalesce("outcome", F.lit(""))
    ok, human = outcome == "ok", outcome.startswith("needs_human")
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(ok).alias("ok"),
        F.count_if(human).alias("needs_human"),
        F.count_if(~ok & ~human).alias("errors"),
        _sum("duration_ms"),
        *[_sum(t) for t in TOKENS],
    ]


def trace_summary(trace: DataFrame) -> DataFrame:
    """Per task: calls, ok, needs_human, errors, duration and tokens (missing usage counts 0)."""
    return trace.groupBy(F.coalesce("task", F.lit("?")).alias("task")).agg(*outcome_columns())


def with_cost(trace: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """+ cost: the recorded one, else tokens x the longest matching price (per million); missing if none."""
    rows = trace
    for c in ("cost_usd",):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    if "has_usage" not in rows.columns:
        rows = rows.withColumn("has_usage", F.lit(True))
    priced = prefix_join(rows, prices, "model", overrides=overrides)
    amount = sum((F.coalesce(F.col(t), F.lit(0)) * F.col(p) for t, p in PRICE_OF.items()), F.lit(0.0))
    cost = F.when(F.col("has_usage") & F.col("matched_prefix").isNotNull(), amount / 1_000_000)
    return priced.withColumn("cost", F.coalesce("cost_usd", cost)).drop(*PRICE_OF.values(), "matched_prefix")


def trace_totals(trace: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Run totals in one row; calls with usage but no known price are declared, not hidden."""
    rows = with_cost(trace, prices, overrides)
    by_task = rows.groupBy(F.coalesce("task", F.lit("?")).alias("task")).agg(
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("long").alias("spent")
    )
    entries = by_task.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "spent")))))  # one per task
    return rows.agg(
        F.sum(F.col("cost").cast("decimal(38,9)")).cast("double").alias("cost_usd"),
        *[_sum(t) for t in TOKENS],
        F.count("cost").alias("priced_calls"),
        F.count_if(F.col("cost").isNull() & F.col("has_usage")).alias("unpriced_calls"),
    ).withColumn("tokens_by_task", entries.scalar())
