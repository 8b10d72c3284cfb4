"""Row steps: subset, derive, branch, keep/drop/rename, stack, sort, dedupe, update, delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.operators.ordered import order_columns, pick_rows


def _expr(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def keep_rows(df: DataFrame, cond: Column | str) -> DataFrame:
    """Subsetting ``IF cond;`` and ``WHERE=``."""
    return df.filter(_expr(cond))


def derive(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``DATA out; SET in;`` with computed columns."""
    return df.withColumns({name: _expr(e) for name, e in columns.items()})


def if_else(branches: Sequence[tuple[Column | str, object]], default: object = None) -> Column:
    """IF/THEN/ELSE chain: the first true branch wins; without a default the result is missing."""

    def value(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    (cond, then), *rest = branches
    chain = F.when(_expr(cond), value(then))
    for cond, then in rest:
        chain = chain.when(_expr(cond), value(then))
    return chain.otherwise(value(default))


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def missing_low(col: Column | str, op: str, value: object) -> Column:
    """Comparison in which a missing value is lower than everything and equal to itself."""
    c = F.col(col) if isinstance(col, str) else col
    v = value if isinstance(value, Column) else F.lit(value)
    low = c.isNull() & v.isNotNull() | F.coalesce(c < v, F.lit(False))
    same = c.eqNullSafe(v)
    table = {"<": low, "<=": low | same, ">": ~(low | same), ">=": ~low, "==": same, "!=": ~same}
    if op not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return table[op]


def sql_select(df: DataFrame, exprs: Sequence[str], where: str | None = None) -> DataFrame:
    """SELECT list in which later items may use earlier aliases (``CALCULATED``), also in WHERE."""
    out = df.selectExpr(*exprs)
    return out.filter(where) if where else out


def distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def split_rows(df: DataFrame, outputs: Mapping[str, Column | str]) -> dict[str, DataFrame]:
    """``DATA a b;`` with conditional OUTPUT: one DataFrame per target, a row may go to several."""
    return {name: df.filter(_expr(cond)) for name, cond in outputs.items()}


def update_where(df: DataFrame, changes: Mapping[str, Column | str], cond: Column | str) -> DataFrame:
    """``UPDATE t SET c = e WHERE p``: every expression sees the old row."""
    hit = F.coalesce(_expr(cond), F.lit(False))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.when(hit, _expr(changes[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in df.columns
        ]
    )


def keep_not(df: DataFrame, cond: Column | str) -> DataFrame:
    """Rows that ``DELETE FROM t WHERE cond`` leaves (a NULL condition does not delete)."""
    return df.filter(~F.coalesce(_expr(cond), F.lit(False)))


def add_column(df: DataFrame, name: str, type_: str | T.DataType) -> DataFrame:
    """``ALTER TABLE ADD col type``: the new column is missing everywhere."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, F.lit(None).cast(type_))


def proc_sort(df: DataFrame, by: Sequence[str], desc: Sequence[str] = (), nulls: str = "low") -> DataFrame:
    """``PROC SORT`` with mixed directions; missing is lowest unless ``nulls="last"``."""
    return df.orderBy(*order_columns(by, desc, nulls))


def nodupkey(df: DataFrame, by: Sequence[str], order_by: Sequence[str], desc: Sequence[str] = ()) -> DataFrame:
    """``NODUPKEY``: the first row of each key in a stated order."""
    return pick_rows(df, by, order_by, desc=desc)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` largest rows; ties fall to the ``ties`` columns (a top-k, no full sort)."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(k)


def stack(*dfs: DataFrame, corresponding: bool = False) -> DataFrame:
    """``SET a b;`` / ``OUTER UNION CORR``: rows one below the other, columns matched by name.

    A column absent on one side is missing there; numeric types widen; a column that is text on
    one side is text in the result. ``corresponding`` keeps shared columns only.
    """
    if corresponding:
        shared = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
        dfs = tuple(d.select(*shared) for d in dfs)
    text = {
        f.name for d in dfs for f in d.schema.fields if isinstance(f.dataType, T.StringType)
    }
    aligned = [
        d.withColumns(
            {f.name: F.col(f.name).cast("string") for f in d.schema.fields
             if f.name in text and not isinstance(f.dataType, T.StringType)}
        )
        for d in dfs
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop repeated keys, keeping the first by ``order``."""
    return pick_rows(df, key, order)


def union_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two id sets, blanks and missing left out."""
    return (
        a.select(F.trim(key).alias(key))
        .union(b.select(F.trim(key).alias(key)))
        .filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .distinct()
    )
