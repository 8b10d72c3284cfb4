"""Operators that depend on row order: FIRST./LAST., RETAIN, LAG, counters.

Every call names its order; ties fall to the other columns, so only identical rows tie. Small groups run as one window per group. When some group is hot (or
there is no group at all) the rows are range-partitioned on (group, order), staged once, scanned
chunk by chunk, and the state at each chunk boundary is carried over from a summary. A range
partition boundary is crossed by at most one group, so that summary has at most two rows per
partition and can always be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteps.session import has_hot_group, same_keys, stage

_CHUNK = "_chunk"


def order_columns(order_by: Sequence[str], desc: Sequence[str] = (), nulls: str = "low") -> list[Column]:
    """Sort columns; missing is the lowest value (``nulls="low"``) or always last (``"last"``)."""
    out = []
    for name in order_by:
        if name in desc:
            out.append(F.desc_nulls_last(name))
        else:
            out.append(F.asc_nulls_first(name) if nulls == "low" else F.asc_nulls_last(name))
    return out


def total_order(df: DataFrame, order_by: Sequence[str], skip: Sequence[str] = ()) -> list[str]:
    """``order_by`` followed by the remaining sortable columns, so that only identical rows tie."""
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in order_by and f.name not in skip and f.dataType.typeName() not in ("map", "variant")
    ]
    return [*order_by, *rest]


def _use_chunks(df: DataFrame, by: Sequence[str]) -> bool:
    return not by or has_hot_group(df, by)


def _chunked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.asc_nulls_first(b) for b in by], *order)
    return stage(ranged.withColumn(_CHUNK, F.spark_partition_id()), "ordered")


def _carry(rows: DataFrame, by: Sequence[str], aggs: Sequence[Column], carries: dict[str, Column]) -> DataFrame:
    """Join what earlier chunks of the same group leave behind onto ``rows``.

    ``aggs`` are named per-chunk aggregates; ``carries`` map output names to window columns over
    the chunks of one group. Only groups that span chunks are kept: at most two rows per chunk.
    """
    span = W.partitionBy(*by)
    keys = [f"_k{i}" for i in range(len(by))]
    summary = (
        rows.groupBy(*by, _CHUNK)
        .agg(*aggs)
        .withColumn("_n_chunks", F.count(F.lit(1)).over(span))
        .filter("_n_chunks > 1")
        .withColumns(carries)
        .select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(_CHUNK).alias("_k"), *carries)
    )
    on = rows[_CHUNK] == summary["_k"]
    if by:
        on = on & same_keys([rows[b] for b in by], [summary[k] for k in keys])
    return rows.join(F.broadcast(summary), on, "left").drop(*keys, "_k")


def _before(by: Sequence[str]) -> W:
    return W.partitionBy(*by).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)


def row_counter(
    df: DataFrame,
    order_by: Sequence[str],
    by: Sequence[str] | None = None,
    name: str = "_n_",
    desc: Sequence[str] = (),
    nulls: str = "low",
) -> DataFrame:
    """``_N_``: row number in ``order_by`` order, per group or over the whole table."""
    by = list(by or [])
    order = order_columns(total_order(df, order_by, skip=by), desc, nulls)
    if not _use_chunks(df, by):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    rows = _chunked(df, by, order)
    local = F.row_number().over(W.partitionBy(*by, _CHUNK).orderBy(*order))
    carried = _carry(rows, by, [F.count(F.lit(1)).alias("_rows")], {"_skip": F.sum("_rows").over(_before(by))})
    return carried.withColumn(name, (local + F.coalesce("_skip", F.lit(0))).cast("long")).drop(_CHUNK, "_skip")


def first_last(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    first: str = "first",
    last: str = "last",
    desc: Sequence[str] = (),
) -> DataFrame:
    """``FIRST.k`` / ``LAST.k`` flags in a stated order within each group."""
    by = list(by)
    names = total_order(df, order_by, skip=by)
    order = order_columns(names, desc)
    if not _use_chunks(df, by):
        w = W.partitionBy(*by).orderBy(*order)
        return df.withColumns({first: F.row_number().over(w) == 1, last: F.lead(F.lit(1)).over(w).isNull()})
    rows = _chunked(df, by, order)
    w = W.partitionBy(*by, _CHUNK).orderBy(*order)
    group = W.partitionBy(*by)
    carried = _carry(
        rows,
        by,
        [F.count(F.lit(1)).alias("_rows")],
        {"_lo": F.min(_CHUNK).over(group), "_hi": F.max(_CHUNK).over(group)},
    )
    return carried.withColumns(
        {
            first: (F.row_number().over(w) == 1) & F.coalesce(F.col("_lo") == F.col(_CHUNK), F.lit(True)),
            last: F.lead(F.lit(1)).over(w).isNull() & F.coalesce(F.col("_hi") == F.col(_CHUNK), F.lit(True)),
        }
    ).drop(_CHUNK, "_lo", "_hi")


def retain_sum(
    df: DataFrame,
    by: Sequence[str] | None,
    var: str | Column,
    order_by: Sequence[str],
    name: str = "acum",
    exclusive: bool = False,
    desc: Sequence[str] = (),
) -> DataFrame:
    """``RETAIN acum; acum + v;`` reset at FIRST.; a missing addend counts as 0.

    ``exclusive`` gives the value before the current row is added.
    """
    by = list(by or [])
    addend = F.coalesce(F.col(var) if isinstance(var, str) else var, F.lit(0))
    order = order_columns(total_order(df, order_by, skip=by), desc)
    end = -1 if exclusive else 0
    if not _use_chunks(df, by):
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(name, F.coalesce(F.sum(addend).over(w), F.lit(0)))
    rows = _chunked(df, by, order)
    w = W.partitionBy(*by, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    carried = _carry(rows, by, [F.sum(addend).alias("_total")], {"_base": F.sum("_total").over(_before(by))})
    return carried.withColumn(
        name, F.coalesce(F.sum(addend).over(w), F.lit(0)) + F.coalesce("_base", F.lit(0))
    ).drop(_CHUNK, "_base")


def retain_last(
    df: DataFrame, by: Sequence[str] | None, var: str, order_by: Sequence[str], name: str = "retained"
) -> DataFrame:
    """``RETAIN`` of the last non-missing value."""
    by = list(by or [])
    order = order_columns(total_order(df, order_by, skip=by))
    if not _use_chunks(df, by):
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.last(var, ignorenulls=True).over(w))
    rows = _chunked(df, by, order)
    ordered = W.partitionBy(*by, _CHUNK).orderBy(*order)
    rows = rows.withColumns(
        {
            name: F.last(var, ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0)),
            "_rn": F.row_number().over(ordered),
        }
    )
    tail = F.max_by(F.col(var), F.when(F.col(var).isNotNull(), F.col("_rn"))).alias("_tail")
    carried = _carry(rows, by, [tail], {"_base": F.last("_tail", ignorenulls=True).over(_before(by))})
    return carried.withColumn(name, F.coalesce(name, "_base")).drop(_CHUNK, "_base", "_rn")


def lag_n(
    df: DataFrame, by: Sequence[str] | None, var: str, order_by: Sequence[str], n: int = 1, name: str | None = None
) -> DataFrame:
    """``LAGn(v)`` within a group (the unconditional form)."""
    by, name = list(by or []), name or f"lag{n}"
    order = order_columns(total_order(df, order_by, skip=by))
    if not _use_chunks(df, by):
        return df.withColumn(name, F.lag(var, n).over(W.partitionBy(*by).orderBy(*order)))
    rows = _chunked(df, by, order)
    w = W.partitionBy(*by, _CHUNK).orderBy(*order)
    size = F.count(F.lit(1)).over(W.partitionBy(*by, _CHUNK))
    rows = rows.withColumns({name: F.lag(var, n).over(w), "_rn": F.row_number().over(w), "_size": size})
    rows = _carry(
        rows,
        by,
        [F.count(F.lit(1)).alias("_rows")],
        {"_skip": F.coalesce(F.sum("_rows").over(_before(by)), F.lit(0))},
    )
    # Sources outside the chunk lie in the last n rows of an earlier chunk of a spanning group:
    # at most 2n rows per range partition; Spark chooses the join by the size it measures.
    keys = [f"_k{i}" for i in range(len(by))]
    tails = rows.filter(F.col("_skip").isNotNull() & (F.col("_size") - F.col("_rn") < n)).select(
        *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)],
        (F.col("_skip") + F.col("_rn") + n).alias("_target"),
        F.col(var).alias("_value"),
    )
    on = (rows["_rn"] <= n) & (rows["_skip"] + rows["_rn"] == tails["_target"])
    if by:
        on = on & same_keys([rows[b] for b in by], [tails[k] for k in keys])
    joined = rows.join(tails, on, "left")
    value = F.when(F.col("_rn") <= n, F.col("_value")).otherwise(F.col(name))
    return joined.withColumn(name, value).drop(_CHUNK, "_rn", "_size", "_skip", "_target", "_value", *keys)


def dif_n(
    df: DataFrame, by: Sequence[str] | None, var: str, order_by: Sequence[str], n: int = 1, name: str | None = None
) -> DataFrame:
    """``DIFn(v)``: the value minus its n-th predecessor."""
    name = name or f"dif{n}"
    return lag_n(df, by, var, order_by, n, name="_lagged").withColumn(name, F.col(var) - F.col("_lagged")).drop("_lagged")


def pick_rows(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], k: int = 1, desc: Sequence[str] = (), nulls: str = "low"
) -> DataFrame:
    """The first ``k`` rows of each group.

    ``row_number() <= k`` lets Spark cut every map-side group to k rows before the shuffle
    (WindowGroupLimit), so a hot group never travels whole.
    """
    names = total_order(df, order_by, skip=by)
    w = W.partitionBy(*by).orderBy(*order_columns(names, desc, nulls))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def last_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[str], keep: str = "last") -> DataFrame:
    """Keep the first or last row of each group in a stated order."""
    if keep == "first":
        return pick_rows(df, by, order_by)
    return pick_rows(df, by, order_by, desc=[c for c in total_order(df, order_by, skip=by)])
