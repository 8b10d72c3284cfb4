"""Writers with the write semantics of the old steps: export, replace, append, create, period reload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesteps.operators.steps import keep_not, update_where
from tablesteps.session import stage
from tablesteps.sources.rewrite import rewrite_where, rewrites_files


def export_csv(df: DataFrame, path: str, bom: bool = False, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Folder of CSV parts with a header each, replaced on every run.

    ``bom`` puts a byte-order mark in front of the first header name, for spreadsheet programs. Blanks at the ends
    of a cell stay. An empty text is a pair of quotes, a missing one is nothing.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _aligned(df: DataFrame, table: str) -> DataFrame:
    """Columns in the table's order; absent ones are missing, unknown ones are an error."""
    target = df.sparkSession.table(table).schema
    have = {c.lower(): c for c in df.columns}
    unknown = sorted(set(have) - {f.name.lower() for f in target.fields})
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(unknown)}")
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def write_replace(df: DataFrame, table: str, reads_target: bool = False, jdbc: Mapping[str, str] | None = None) -> None:
    """Replace all rows and keep the table's definition (never drop it).

    ``reads_target``: ``df`` is computed from the table itself, so it is staged first.
    """
    if jdbc:
        df.write.format("jdbc").options(dbtable=table, truncate="true", **jdbc).mode("overwrite").save()
        return
    out = _aligned(df, table)
    if reads_target:
        out = stage(out, "replace")
    out.write.insertInto(table, overwrite=True)


def write_append(df: DataFrame, table: str, jdbc: Mapping[str, str] | None = None) -> None:
    """``PROC APPEND`` / ``INSERT INTO``: a second run adds the rows again, as the source did."""
    if jdbc:
        df.write.format("jdbc").options(dbtable=table, **jdbc).mode("append").save()
        return
    _aligned(df, table).write.insertInto(table)


def create_as(df: DataFrame, table: str, path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """``CREATE TABLE AS``: fails when the table exists."""
    writer = df.write.mode("errorifexists").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def write_period(df: DataFrame, table: str, period_col: str, periods: Sequence[object] | None = None) -> None:
    """Reload whole periods: the partitions present in ``df`` are replaced, the others stay.

    ``periods`` names the periods being reloaded; one of them without rows ends up empty, and rows of any
    other period (or none) are an error before anything is written. Running twice gives the same table.
    """
    spark = df.sparkSession
    if period_col not in df.columns:
        raise ValueError(f"the data has no period column {period_col!r}")
    parts = {c.name for c in spark.catalog.listColumns(table) if c.isPartition}
    if period_col not in parts:
        raise ValueError(f"{table} is not partitioned by {period_col!r}")
    out = _aligned(df, table)
    if periods is not None:
        out = stage(out, "period")
        listed = F.col(period_col).isin(*periods)
        other = [r[0] for r in out.filter(~F.coalesce(listed, F.lit(False))).select(period_col).distinct().limit(10).collect()]
        if other:
            raise ValueError(f"the data has rows of periods that are not being reloaded: {other}")
    conf = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        out.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(conf, before)
    if periods is not None:
        # the new rows are in place; only listed periods without rows are left to empty
        filled = {r[0] for r in out.select(period_col).distinct().collect()}
        for p in periods:
            if p not in filled:
                literal = "'" + p.replace("'", "''") + "'" if isinstance(p, str) else str(p)
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({period_col} = {literal})")


def delete_where(spark: SparkSession, table: str, cond: str, params: Mapping[str, object] | None = None) -> None:
    """``DELETE FROM t WHERE cond`` on a table without row deletes.

    Parquet and ORC tables are rewritten file by file, only where rows go; others keep the rest and are replaced.
    """
    if rewrites_files(spark, table):
        rewrite_where(spark, table, cond, lambda rows, flag: rows.filter(f"NOT {flag}"), params)
        return
    source = spark.table(table)
    if params:
        flagged = spark.sql(f"SELECT *, coalesce({cond}, false) AS _gone FROM {{source}}", args=dict(params), source=source)
        kept = flagged.filter("NOT _gone").drop("_gone")
    else:
        kept = keep_not(source, cond)
    write_replace(kept, table, reads_target=True)


def update_table(spark: SparkSession, table: str, changes: Mapping[str, Column | str], cond: str, params: Mapping[str, object] | None = None) -> None:
    """``UPDATE t SET c = e WHERE cond``: every expression sees the old row; untouched files stay."""
    if rewrites_files(spark, table):
        rewrite_where(spark, table, cond, lambda rows, flag: update_where(rows, changes, flag), params)
        return
    flagged = spark.sql(f"SELECT *, coalesce({cond}, false) AS _hit FROM {{source}}", args=dict(params or {}), source=spark.table(table))
    write_replace(update_where(flagged, changes, "_hit").drop("_hit"), table, reads_target=True)


def observe_step(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    """Count rows and columns of a step while it is written; no extra job.

    After the write ``observation.get`` holds ``n_rows`` and ``n_columns``.
    """
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.max(F.lit(len(df.columns))).alias("n_columns")), seen


def check_written(seen: Observation, written: DataFrame, label: str) -> DataFrame:
    """One row (label, n_rows, n_columns, written_rows, passed): does the target hold what was sent."""
    rows = int(seen.get["n_rows"])
    return written.agg(F.count(F.lit(1)).alias("written_rows")).select(
        F.lit(label).alias("label"),
        F.lit(rows).cast("long").alias("n_rows"),
        F.lit(int(seen.get["n_columns"] or 0)).cast("long").alias("n_columns"),
        "written_rows",
        (F.col("written_rows") == rows).alias("passed"),
    )
