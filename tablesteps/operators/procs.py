"""Class summaries, frequency tables, transpose, ranks and calendar grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.operators.ordered import retain_last, retain_sum
from tablesteps.session import same_keys

_STATS = {
    "n": F.count,
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


def _stat_columns(var: Sequence[str], stats: Sequence[str]) -> list[Column]:
    return [_STATS[s](v).alias(f"{v}_{s}") for v in var for s in stats]


def proc_means(
    df: DataFrame,
    cls: Sequence[str],
    var: Sequence[str],
    stats: Sequence[str] = ("mean", "sum", "min", "max", "count"),
    types: bool = False,
    missing: bool = False,
) -> DataFrame:
    """``PROC MEANS; CLASS g; VAR v;`` -> one row per class, columns ``<var>_<stat>``.

    Rows with a missing class value are left out unless ``missing``. ``types`` adds the rows of
    every class subset down to the grand total, with ``_TYPE_`` (bit i set = class i used) and
    ``_FREQ_``.
    """
    cls = list(cls)
    if not missing and cls:
        df = df.dropna(subset=cls)
    aggs = _stat_columns(var, stats)
    if not types:
        return df.groupBy(*cls).agg(*aggs)
    full = (1 << len(cls)) - 1
    type_ = (F.lit(full) - F.grouping_id()).cast("long").alias("_TYPE_")
    return df.cube(*cls).agg(type_, F.count(F.lit(1)).alias("_FREQ_"), *aggs)


def proc_freq(df: DataFrame, col: str, other: str | None = None, values: Sequence | None = None) -> DataFrame:
    """``PROC FREQ``: one way -> (value, count, percent) without missing values; two way -> crosstab."""
    if other is not None:
        cells = df.dropna(subset=[col, other]).groupBy(col, other).agg(F.count(F.lit(1)).alias("_n"))
        return cells.groupBy(col).pivot(other, list(values) if values else None).agg(F.sum("_n")).fillna(0)
    counts = df.dropna(subset=[col]).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(col).alias("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 4))


def transpose(
    df: DataFrame, by: Sequence[str], id: str, var: str, prefix: str = "", values: Sequence | None = None
) -> DataFrame:
    """``PROC TRANSPOSE; BY k; ID c; VAR v;``; a repeated (BY, ID) pair fails the query.

    ``values`` saves the extra job that finds the column names.
    """
    by = list(by)
    cell = f"repeated ID value in a BY group: {id}"
    cells = (
        df.groupBy(*by, id)
        .agg(F.first(var).alias("_v"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_v", F.when(F.col("_n") > 1, F.raise_error(F.lit(cell))).otherwise(F.col("_v")))
    )
    wide = cells.groupBy(*by).pivot(id, list(values) if values else None).agg(F.first("_v"))
    if prefix:
        wide = wide.withColumnsRenamed({c: f"{prefix}{c}" for c in wide.columns if c not in by})
    return wide


def sql_summary(
    df: DataFrame, other: DataFrame, on: Sequence[str], group: Sequence[str], sums: dict[str, str], how: str = "inner"
) -> DataFrame:
    """``SELECT g, SUM(x) ... FROM a JOIN b ... GROUP BY g`` (``sums``: output name -> expression)."""
    return df.join(other, list(on), how).groupBy(*group).agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()])


def proc_rank(
    df: DataFrame,
    var: str,
    by: Sequence[str] | None = None,
    ties: str = "mean",
    groups: int | None = None,
    name: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """``PROC RANK``: ``ties`` is mean, low, high or dense; ``groups=k`` gives k bins from 0.

    Rows are counted per distinct value first; the running position is taken over distinct values
    and joined back, so equal values never pile up in one task. Missing values get no rank.
    """
    by = list(by or [])
    keys = [*by, "_v"]
    source = df.withColumn("_v", F.col(var))
    counts = source.filter(F.col("_v").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = dict(order_by=["_v"], desc=["_v"] if descending else [])
    placed = retain_sum(counts, by, "_n", name="_high", **order)
    low = F.col("_high") - F.col("_n") + 1
    if ties == "dense":
        placed = retain_sum(placed, by, F.lit(1), name="_rank", **order)
    else:
        rank = {"low": low, "high": F.col("_high"), "mean": (low + F.col("_high")) / 2}[ties]
        placed = placed.withColumn("_rank", rank)
    if groups is not None:
        if by:
            size = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
            marks = [f"_g{i}" for i in range(len(by))]
            size = size.select(*[F.col(b).alias(m) for b, m in zip(by, marks, strict=True)], "_size")
            on = reduce(lambda a, b: a & b, [placed[b].eqNullSafe(size[m]) for b, m in zip(by, marks, strict=True)])
            placed = placed.join(size, on, "left").drop(*marks)
        else:
            placed = placed.withColumn("_size", counts.agg(F.sum("_n")).scalar())
        placed = placed.withColumn("_rank", F.floor(F.col("_rank") * groups / (F.col("_size") + 1)))
    side = placed.select(*[F.col(k).alias(f"_j_{k}") for k in keys], F.col("_rank").cast("double").alias(name))
    on = reduce(lambda a, b: a & b, [source[k].eqNullSafe(side[f"_j_{k}"]) for k in keys])
    return source.join(side, on, "left").drop("_v", *[f"_j_{k}" for k in keys])


def proc_timeseries(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    interval: str = "day",
    acc: str = "sum",
    var: str = "value",
    fill: str | None = None,
) -> DataFrame:
    """``PROC TIMESERIES``: one row per key and calendar period between the key's first and last.

    ``fill``: None leaves empty periods missing, ``"zero"`` puts 0, ``"previous"`` carries forward.
    Periods of a day or more are dates, shorter ones timestamps; a missing key is a series of its own.
    """
    by = list(by)
    period = F.date_trunc(interval, F.col(ts).cast("timestamp"))
    if interval.lower() not in ("hour", "minute", "second"):
        period = period.cast("date")
    cells = df.groupBy(*by, period.alias("period")).agg(_STATS[acc](var).alias(var))
    step = F.expr(f"interval 1 {interval}")
    grid = (
        cells.groupBy(*by)
        .agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
        .select(*by, F.explode(F.sequence("_lo", "_hi", step)).alias("period"))
    )
    keys = [*by, "period"]
    found = cells.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], var)
    on = same_keys([grid[k] for k in keys], [found[f"_c{i}"] for i in range(len(keys))])  # a missing key is a key
    out = grid.join(found, on, "left").select(*keys, var)
    if fill == "zero":
        return out.withColumn(var, F.coalesce(var, F.lit(0)))
    if fill == "previous":
        return retain_last(out, by, var, ["period"], name="_kept").withColumn(var, F.col("_kept")).drop("_kept")
    return out


