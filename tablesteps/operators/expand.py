"""``PROC EXPAND``: missing periods of a calendar grid from a curve through the known ones.

Known values are knots. Each grid point gets the knots before and after it by two carries in order, so long
series are scanned in chunks like every ordered operator. A natural cubic spline needs the second derivatives at
the knots, which solve a tridiagonal system over the whole series. Its solution at a knot hardly depends on
far ones: the influence at least halves from knot to knot. So a series is cut into chunks of knots, each solved with
``HALO`` knots of its neighbours on either side, which leaves an error below that of doubles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.operators.ordered import retain_last, row_counter
from tablesteps.operators.procs import proc_timeseries

#: Knots of a chunk, and of each neighbour that it is solved with: 2^-64 of what lies beyond is felt.
CHUNK, HALO = 4096, 64
_X, _Y = "_x", "_y"


def curvatures(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline at its knots, by forward elimination and back substitution."""
    n = len(x)
    m = np.zeros(n)
    if n < 3:
        return m
    h = np.diff(x)
    slope = np.diff(y) / h
    right = 6 * np.diff(slope)
    ratio, part = np.zeros(n), np.zeros(n)
    for k in range(1, n - 1):
        pivot = 2 * (h[k - 1] + h[k]) - h[k - 1] * ratio[k - 1]
        ratio[k] = h[k] / pivot
        part[k] = (right[k - 1] - h[k - 1] * part[k - 1]) / pivot
    for k in range(n - 2, 0, -1):
        m[k] = part[k] - ratio[k] * m[k + 1]
    return m


def _knots(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """The known points with the spline's second derivative ``_m`` at each."""
    known = row_counter(grid.filter(F.col(_Y).isNotNull()).select(*by, _X, _Y), [_X], by=list(by), name="_i")
    at = F.col("_i") - 1
    first = F.floor(F.greatest(at - HALO, F.lit(0)) / CHUNK)
    near = known.withColumn("_chunk", F.explode(F.sequence(first, F.floor((at + HALO) / CHUNK))))
    schema = T.StructType([*[grid.schema[b] for b in by], T.StructField(_X, T.DoubleType()), T.StructField("_m", T.DoubleType())])
    chunk = CHUNK

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        bend = curvatures(*(table.column(c).to_numpy() for c in (_X, _Y)))
        own = (table.column("_i").to_numpy() - 1) // chunk == table.column("_chunk")[0].as_py()
        return table.select([*by, _X]).append_column("_m", pa.array(bend)).filter(pa.array(own))

    return near.groupBy(*by, "_chunk").applyInArrow(solve, schema)


def proc_expand(
    df: DataFrame, by: Sequence[str], ts: str, interval: str = "day", acc: str = "mean", var: str = "value", method: str = "spline"
) -> DataFrame:
    """One row per key and calendar period between the key's first and last; inner gaps of ``var`` filled.

    ``method``: ``"linear"`` joins the known values by lines, ``"spline"`` by a natural cubic spline (a line where
    a key has two). Distances are real time, so months differ in length. Periods before the first
    known value and after the last stay missing; NaN is missing.
    """
    if method not in ("linear", "spline"):
        raise ValueError(f"unknown method {method!r}")
    by = list(by)
    grid = proc_timeseries(df, by, ts, interval, acc, var)
    days = isinstance(grid.schema["period"].dataType, T.DateType)
    x = F.unix_date("period") if days else F.unix_micros("period") / 1e6
    y = F.col(var).cast("double")
    grid = grid.withColumns({_X: x.cast("double"), _Y: F.when(~F.isnan(y), y)})
    bend = F.lit(0.0)
    if method == "spline":
        knots = _knots(grid, by)
        mine = knots.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(_X).alias("_kx"), "_m")
        on = reduce(lambda a, b: a & b, [grid[b].eqNullSafe(mine[f"_b{i}"]) for i, b in enumerate(by)], grid[_X] == mine["_kx"])
        grid = grid.join(mine, on, "left").drop("_kx", *[f"_b{i}" for i in range(len(by))])
        bend = F.col("_m")
    grid = grid.withColumns({"_knot": F.when(F.col(_Y).isNotNull(), F.struct(_X, _Y, bend.alias("m"))), "_back": -F.col(_X)})
    both = retain_last(retain_last(grid, by, "_knot", [_X], name="_p"), by, "_knot", ["_back"], name="_q")
    h = F.col("_q._x") - F.col("_p._x")
    a, b = (F.col("_q._x") - F.col(_X)) / h, (F.col(_X) - F.col("_p._x")) / h
    line = a * F.col("_p._y") + b * F.col("_q._y")
    curve = line + ((a * a * a - a) * F.col("_p.m") + (b * b * b - b) * F.col("_q.m")) * h * h / 6
    value = F.when(F.col(_Y).isNotNull(), F.col(_Y)).when(h > 0, curve)
    return both.select(*by, "period", value.alias(var))
