"""Column profiles, layout findings and profile reports over many tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.operators.ordered import pick_rows
from tablesteps.session import stage

# Placeholder texts for "no value", and period-like column names.
SENTINELS = ("-999", "N/A", "ND", "S/I", "#N/A", "...", "-", "n/a", "NA")
PERIOD_NAME = re.compile(
    r"(?i)(Ene|Feb|Mar|Abr|May|Jun|Jul|Ago|Sep|Oct|Nov|Dic|Jan|Apr|Aug|Dec|Q[1-4]|\d{4})"
)
PERIOD_COLUMNS = 3  # more than this many make a pivoted layout

_PROFILE = (
    "position", "column", "dtype", "row_count", "null_count", "null_share", "null_pct", "unique_count", "min_val", "max_val", "mean_val",
)
#: 2^14 registers: the estimate's relative standard error is about 0.8 %.
SKETCH_BITS = 14
_SKETCH_WIDTH = 64  # columns per aggregate
_NUMBER = "struct<a: double, b: decimal(38,10), text: string>"
_SKETCHES = {
    "position": "int", "column": "string", "dtype": "string", "row_count": "bigint", "filled": "bigint", "distinct": "binary",
    "lo": _NUMBER, "hi": _NUMBER, "sum": "double",
}
_WIDTH = 12  # columns per aggregate: exact distinct counts expand each row once per column


def _profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]


def column_sketches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Facts of each column, per group of ``by``, that can be merged: one aggregate, nothing is expanded.

    Counts, a HyperLogLog sketch of the distinct values, least and greatest number, and the numbers' sum. Facts of
    further files or periods can be put beside them and merged by ``sketch_profile``.
    """
    fields = [f for f in _profiled(df) if f.name not in by]
    parts = []
    for lo in range(0, len(fields), _SKETCH_WIDTH):
        aggs, entries = [F.count(F.lit(1)).alias("_rows")], []
        for i, f in enumerate(fields[lo : lo + _SKETCH_WIDTH]):
            c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                c = F.when(~F.isnan(c), c + F.lit(0.0))  # one zero
            aggs += [F.count(c).alias(f"{i}_n"), F.hll_sketch_agg(c.cast("string"), F.lit(SKETCH_BITS)).alias(f"{i}_d")]
            if number:
                # doubles first, then exactly: whole numbers and decimals may be longer than a double
                key = F.when(c.isNotNull(), F.struct(c.cast("double").alias("a"), c.try_cast("decimal(38,10)").alias("b"), c.cast("string").alias("text")))
                aggs += [F.min(key).alias(f"{i}_lo"), F.max(key).alias(f"{i}_hi"), F.sum(c.cast("double")).alias(f"{i}_sum")]
            part = lambda name, kind, i=i, number=number: (F.col(f"{i}_{name}") if number else F.lit(None)).cast(kind).alias(name)
            entries.append(
                F.struct(
                    F.lit(lo + i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.col("_rows").alias("row_count"), F.col(f"{i}_n").alias("filled"), F.col(f"{i}_d").alias("distinct"),
                    part("lo", _NUMBER), part("hi", _NUMBER), part("sum", "double"),
                )
            )
        parts.append(df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*entries))))
    if not parts:
        return df.select(*by).limit(0).select("*", *[F.lit(None).cast(k).alias(n) for n, k in _SKETCHES.items()])
    return reduce(lambda a, b: a.unionByName(b), parts)


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """The profile of everything that ``sketches`` were made from."""
    merged = sketches.groupBy("position", "column", "dtype").agg(
        F.sum("row_count").alias("row_count"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct").alias("distinct"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"),
    )
    nulls = F.col("row_count") - F.col("filled")
    share = F.when(F.col("row_count") > 0, nulls / F.col("row_count")).otherwise(0.0)
    return merged.select(
        "position", "column", "dtype", "row_count", nulls.alias("null_count"), F.round(share, 4).alias("null_share"), F.round(share * 100, 2).alias("null_pct"),
        F.when(F.col("filled") > 0, F.least(F.hll_sketch_estimate("distinct"), F.col("filled"))).otherwise(0).cast("long").alias("unique_count"),
        F.col("lo.text").alias("min_val"), F.col("hi.text").alias("max_val"),
        F.round(F.when(F.col("filled") > 0, F.col("sum") / F.col("filled")), 4).alias("mean_val"),
    )


def update_sketches(df: DataFrame, path: str, period: str) -> None:
    """Keep the sketches of the periods in ``df`` below ``path``; those of other periods stay, nothing of them is read."""
    made = column_sketches(df, [period])
    made.write.partitionBy(period).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def profile(df: DataFrame, samples: int = 0, exact: bool | Sequence[str] = ()) -> DataFrame:
    """One row per column: type, missing count and share, distinct values, min/max text, mean.

    Min, max and mean are for numbers. ``null_share`` is a fraction (4 digits), ``null_pct`` a
    percentage. NaN is a missing value. All rows are read. Distinct values are counted by a sketch with a relative
    standard error of 0.8 %, and exactly for the columns named in ``exact`` (True: all).
    ``samples`` adds that many distinct values per column, smallest text first.
    """
    out = sketch_profile(column_sketches(df))
    fields = [f for f in _profiled(df) if exact is True or (exact is not False and f.name in exact)]
    counted = []
    for lo in range(0, len(fields), _WIDTH):
        some = fields[lo : lo + _WIDTH]
        columns = [F.col(f"`{f.name}`") for f in some]
        columns = [F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c for f, c in zip(some, columns)]
        entries = [F.struct(F.lit(f.name).alias("column"), F.col(f"{i}_d").alias("_exact")) for i, f in enumerate(some)]
        counted.append(df.agg(*[F.count_distinct(c).alias(f"{i}_d") for i, c in enumerate(columns)]).select(F.inline(F.array(*entries))))
    if counted:
        out = out.join(reduce(lambda a, b: a.unionByName(b), counted), "column", "left")
        out = out.withColumn("unique_count", F.coalesce("_exact", "unique_count")).select(*_PROFILE)
    return out.join(column_samples(df, samples), "column", "left") if samples else out


def _unpivot(df: DataFrame, names: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]
    return df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL")


def column_samples(df: DataFrame, n: int = 5) -> DataFrame:
    """(column, sample_values): the ``n`` smallest distinct texts of each column.

    Distinct values fold map-side and each task hands on at most ``n`` per column.
    """
    values = _unpivot(df, [f.name for f in _profiled(df)]).distinct()
    return (
        pick_rows(values, ["column"], ["value"], k=n)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )


def find_artifacts(df: DataFrame) -> DataFrame:
    """Findings -> (artifact_type, location, found): sentinel texts per column, pivoted layout.

    All nine sentinels are tested on raw text, so no reader option can hide one.
    """
    spark = df.sparkSession
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    schema = "artifact_type STRING, location STRING, found ARRAY<STRING>"
    period = [c for c in df.columns if PERIOD_NAME.match(c)]
    layout = [("pivoted_layout", "column headers", period)] if len(period) > PERIOD_COLUMNS else []
    out = spark.createDataFrame(layout, schema)
    if text:
        hits = _unpivot(df, text).filter(F.col("value").isin(*SENTINELS)).groupBy("column")
        out = out.unionByName(
            hits.agg(F.sort_array(F.collect_set("value")).alias("found")).select(  # at most nine values
                F.lit("sentinel_values").alias("artifact_type"), F.col("column").alias("location"), "found"
            )
        )
    return out


def profile_tables(
    spark: SparkSession,
    tables: Mapping[str, Callable[[], DataFrame]],
    prior: DataFrame | None = None,
    samples: int = 0,
    exact: bool | Sequence[str] = (),
) -> DataFrame:
    """Profiles of many sources -> profile columns + (source, error); a failed source is an error row.

    All sources run as one plan, so small tables share the cluster. Where that fails, each half runs on its own,
    down to the sources that fail. Earlier rows whose source starts with ``db:`` are replaced, rows of files are kept.
    """
    parts, frames = [], []

    def failed(source: str, exc: Exception) -> DataFrame:
        return spark.createDataFrame([(source, str(exc))], "source STRING, error STRING")

    for source, read in tables.items():
        try:
            rows = profile(read(), samples, exact)
            frames.append((source, rows.withColumns({"source": F.lit(source), "error": F.lit(None).cast("string")})))
        except Exception as exc:  # noqa: BLE001  one source must not stop the others
            parts.append(failed(source, exc))

    def run(some: list[tuple[str, DataFrame]]) -> list[DataFrame]:
        if not some:
            return []
        try:
            # a profile has a row per column; writing it here turns a failure while reading into an error row
            return [stage(reduce(lambda a, b: a.unionByName(b), [rows for _, rows in some]), "profile")]
        except Exception as exc:  # noqa: BLE001
            if len(some) == 1:
                return [failed(some[0][0], exc)]
            half = len(some) // 2
            return run(some[:half]) + run(some[half:])

    parts += run(frames)
    if prior is not None:
        parts.append(prior.filter(~F.col("source").startswith("db:")))
    if not parts:
        return spark.createDataFrame([], "source STRING, error STRING")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
