"""Two sorted tables side by side, by position, through runs of equal rows.

Equal rows are one run with a multiplicity on each side; a run takes an interval of positions on each side.
Runs whose two intervals are the same pair with themselves. Only the others are laid over each other: the
intervals of a side do not overlap, so the overlaps are at most as many as the runs, found by one ordered scan
of blocks of a fixed number of positions. A row that fills a third of a table is one run, cut at the borders of
the blocks; no task gets more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteps.operators.ordered import _CHUNK, _before, _carry, _chunked, order_columns
from tablesteps.session import stage

#: Positions of a block: at most so many run starts of each side meet in one window.
BLOCK = 100_000


def row_runs(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """The distinct rows of both sides, with how often each side holds them: ``_r`` and ``_g``."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = ref.select("*", one.alias("_r"), none.alias("_g")).unionByName(gen.select("*", none.alias("_r"), one.alias("_g")))
    return both.groupBy(*ref.columns).agg(F.sum("_r").alias("_r"), F.sum("_g").alias("_g"))


def placed(runs: DataFrame, order: Sequence[str], nulls: str = "last") -> DataFrame:
    """``runs`` with the positions ``_rs`` and ``_gs`` at which each begins on either side."""
    by = order_columns(order, nulls=nulls)
    rows = _chunked(runs, [], by)
    earlier = W.partitionBy(_CHUNK).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}s": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("_r", "_g")})
    sums = [F.sum(c).alias(f"{c}n") for c in ("_r", "_g")]
    rows = _carry(rows, [], sums, {f"{c}b": F.sum(f"{c}n").over(_before([])) for c in ("_r", "_g")})
    return rows.withColumns({f"{c}s": F.col(f"{c}s") + F.coalesce(f"{c}b", F.lit(0)) for c in ("_r", "_g")}).drop(_CHUNK, "_rb", "_gb")


def _cut(rows: DataFrame, count: str, start: str) -> DataFrame:
    """The runs of one side as (block, at, end, row), cut at the borders of the blocks."""
    end = F.col(start) + F.col(count)
    block = F.lit(BLOCK).cast("long")
    floor = lambda c: F.floor(c / block)
    rows = rows.filter(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(floor(F.col(start)), floor(end - 1))))
    lowest = F.col("_block") * block
    return rows.select("_block", F.greatest(start, lowest).alias("_at"), F.least(end, lowest + block).alias("_end"), "_row")


def overlaps(moved: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_w`` positions at which a row ``r_<c>`` faces a row ``g_<c>``, for the runs of ``placed`` that do not face themselves."""
    rows = moved.withColumn("_row", F.struct(*cols))
    sides = {}
    for side, other in (("r", "g"), ("g", "r")):
        held = F.struct("_end", "_row").alias(f"_{side}")
        sides[side] = _cut(rows, f"_{side}", f"_{side}s").select("_block", "_at", held, F.lit(None).alias(f"_{other}"))
    events = sides["r"].unionByName(sides["g"])
    order = W.partitionBy("_block").orderBy("_at")
    last = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(c)
    # events of one position leave a span of no length until the last of them
    spans = events.select("_at", F.lead("_at").over(order).alias("_next"), last("_r"), last("_g"))
    spans = spans.withColumn("_w", F.least("_next", "_r._end", "_g._end") - F.col("_at"))
    spans = spans.filter((F.col("_w") > 0) & F.col("_r").isNotNull() & F.col("_g").isNotNull())
    return spans.select("_w", *[F.col(f"_{s}._row").getField(c).alias(f"{s}_{c}") for s in "rg" for c in cols])


def face_to_face(ref: DataFrame, gen: DataFrame, order: Sequence[str]) -> DataFrame | None:
    """Weighted pairs of both sides: ``_w``, ``_both``, ``r_<c>`` and ``g_<c>``; None if both hold the same rows equally often.

    Rows are sorted on ``order``, which must name all columns, missing values last. Where ``_both`` is false,
    ``_w`` tells by how many rows one side exceeds the other.
    """
    cols = ref.columns
    runs = stage(row_runs(ref, gen), "runs")
    if runs.filter("_r <> _g").isEmpty():
        return None
    rows = stage(placed(runs, order), "placed")
    still = (F.col("_r") == F.col("_g")) & (F.col("_rs") == F.col("_gs"))
    alike = rows.filter(still).select(F.col("_r").alias("_w"), *[F.col(c).alias(f"{s}_{c}") for s in "rg" for c in cols])
    pairs = overlaps(rows.filter(~still), cols).unionByName(alike).withColumn("_both", F.lit(True))
    beyond = rows.agg(F.abs(F.sum("_r") - F.sum("_g")).alias("_w"), F.lit(False).alias("_both"))
    return pairs.unionByName(beyond, allowMissingColumns=True)
