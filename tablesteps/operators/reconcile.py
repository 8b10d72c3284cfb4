"""Reconciliation of a migrated table with its reference: schema, counts, aggregates, values, causes.

Reports are DataFrames. A value comparison pairs rows either by position after a sort (parity mode)
or by key. When counts differ inside the tolerance, the rows that one side has beyond the other are
reported as ``surplus_rows``. Whole numbers and decimals are compared exactly, never through doubles, and
NaN is a missing value everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.functions.scalars import fold_accents, repair_text, to_num
from tablesteps.operators.hashtree import differing_rows
from tablesteps.operators.joins import key_diff
from tablesteps.operators.ordered import row_counter
from tablesteps.operators.runs import face_to_face
from tablesteps.session import same_keys, stage

# Default tolerances and the distinct-count edge for sort keys.
ROW_TOLERANCE = 0.001
VALUE_TOLERANCE = 1e-6
KEY_DISTINCT_LIMIT = 1000

NULL_TEXT = "<null>"
#: Tables that are compared at the same time.
TABLES_AT_ONCE = 8
_EMPTY_TESTS = (
    "test STRING, level INT, passed BOOLEAN, column STRING, kind STRING, reference DOUBLE, generated DOUBLE, "
    "difference DOUBLE, rows_affected BIGINT, detail STRING"
)


# --- level 1: schema -------------------------------------------------------------------------

def repair_name(name: str) -> str:
    """A column name without byte-order mark, trimmed, and with latin-1 mojibake put right."""
    name = name.replace("﻿", "").replace("ï»¿", "").strip()
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def repair_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[repair_name(c) for c in df.columns])


def compare_schema(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """Missing columns fail; extra ones are only listed."""
    have, want = {repair_name(c) for c in gen.columns}, {repair_name(c) for c in ref.columns}
    missing, extra = sorted(want - have), sorted(have - want)
    return ref.sparkSession.createDataFrame(
        [("schema", 1, not missing, missing, extra)],
        "test STRING, level INT, passed BOOLEAN, missing_columns ARRAY<STRING>, extra_columns ARRAY<STRING>",
    )


def hollow_columns(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """Shared columns that hold values in the reference and none at all in the migrated table -> (column, reference_values).

    Such a column passes a comparison of names. One aggregate per side; NaN is missing.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    cols = _shared(ref, gen)

    def filled(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count(_present(df, c)).alias(f"{i}_n") for i, c in enumerate(cols)])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}_n").alias(name)) for i, c in enumerate(cols)])))

    if not cols:
        return ref.sparkSession.createDataFrame([], "column STRING, reference_values BIGINT")
    both = filled(ref, "reference_values").join(filled(gen, "_g"), "column")
    return both.filter("reference_values > 0 AND _g = 0").select("column", "reference_values")


# --- level 2: counts -------------------------------------------------------------------------

def compare_counts(ref: DataFrame, gen: DataFrame, tol: float = ROW_TOLERANCE) -> DataFrame:
    """``abs(difference) <= floor(reference rows * tol)``."""
    n = F.count(F.lit(1))
    counts = ref.agg(n.alias("reference_rows")).withColumn("generated_rows", gen.agg(n).scalar())
    diff = F.abs(F.col("reference_rows") - F.col("generated_rows"))
    return counts.select(
        F.lit("row_count").alias("test"),
        F.lit(2).alias("level"),
        (diff <= F.floor(F.col("reference_rows") * F.lit(max(tol, 0.0)))).alias("passed"),
        "reference_rows",
        "generated_rows",
        diff.alias("difference"),
    )


# --- level 5: aggregates ---------------------------------------------------------------------

def _numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}


def _shared(ref: DataFrame, gen: DataFrame) -> list[str]:
    return sorted(set(ref.columns) & set(gen.columns))


def _is_float(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.FloatType, T.DoubleType))


def _present(df: DataFrame, c: str) -> Column:
    """A numeric column with NaN as missing."""
    col = F.col(c)
    return F.when(~F.isnan(col), col) if _is_float(df.schema[c]) else col


def _long_aggregates(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    def total(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            return F.sum(F.col(c).cast("decimal(38,0)"))  # a sum of BIGINT may not fit a BIGINT
        if isinstance(kind, T.DecimalType):
            return F.sum(F.col(c).cast(T.DecimalType(38, kind.scale)))
        return F.sum(_present(df, c))

    fns = {"sum": total, "mean": lambda c: F.avg(_present(df, c)), "min": lambda c: F.min(_present(df, c)), "max": lambda c: F.max(_present(df, c))}
    aggs = [fn(c).cast("double").alias(f"{i}_{n}") for i, c in enumerate(cols) for n, fn in fns.items()]
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("aggregate"), F.col(f"{i}_{n}").alias(value))
        for i, c in enumerate(cols)
        for n in fns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def compare_aggregates(ref: DataFrame, gen: DataFrame, tol: float = VALUE_TOLERANCE) -> DataFrame:
    """Sum, mean, min and max of every shared numeric column -> one row each.

    The difference is relative to ``max(abs(reference), 1e-15)``; a side without values is skipped.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    cols = [c for c in _shared(ref, gen) if c in _numeric(ref) and c in _numeric(gen)]
    if not cols:
        return ref.sparkSession.createDataFrame(
            [], "column STRING, aggregate STRING, reference DOUBLE, generated DOUBLE, relative_diff DOUBLE, passed BOOLEAN"
        )
    both = _long_aggregates(ref, cols, "reference").join(_long_aggregates(gen, cols, "generated"), ["column", "aggregate"])
    rel = F.abs(F.col("reference") - F.col("generated")) / F.greatest(F.abs("reference"), F.lit(1e-15))
    return both.withColumn("relative_diff", rel).withColumn("passed", F.coalesce(F.col("relative_diff") <= tol, F.lit(True)))


# --- level 4: values -------------------------------------------------------------------------

def _type_facts(df: DataFrame, cols: Sequence[str], side: str) -> DataFrame:
    numeric = _numeric(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        # what is a number by schema is one whatever its values; only text is parsed
        number = _present(df, c) if c in numeric else to_num(F.col(c).cast("string"))
        filled = _present(df, c) if c in numeric else F.col(c)
        aggs += [F.count(filled).alias(f"{i}_filled"), F.count(number).alias(f"{i}_numbers")]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias(f"{side}_rows"),
            F.col(f"{i}_filled").alias(f"{side}_filled"),
            F.col(f"{i}_numbers").alias(f"{side}_numbers"),
            F.lit(c in numeric).alias(f"{side}_schema"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def classify_columns(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """Is each shared column numeric or text on both sides -> (column, is_numeric, lost cells).

    Numeric if both sides say so in their schema, if every value present parses on both sides, or if more
    than half of the rows do; in the last case the cells that do not parse are counted as lost, and a
    value comparison compares them as text.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    cols = _shared(ref, gen)
    facts = _type_facts(ref, cols, "ref").join(_type_facts(gen, cols, "gen"), "column")
    every = (F.col("ref_filled") == F.col("ref_numbers")) & (F.col("gen_filled") == F.col("gen_numbers"))
    some = (F.col("ref_numbers") > 0) | (F.col("gen_numbers") > 0)
    most = (F.col("ref_numbers") > 0.5 * F.col("ref_rows")) & (F.col("gen_numbers") > 0.5 * F.col("gen_rows"))
    numeric = (F.col("ref_schema") & F.col("gen_schema")) | (every & some) | most
    lost = {s: F.when(numeric, F.col(f"{s}_filled") - F.col(f"{s}_numbers")).otherwise(0) for s in ("ref", "gen")}
    return facts.select(
        "column", numeric.alias("is_numeric"), lost["ref"].alias("lost_in_ref"), lost["gen"].alias("lost_in_gen")
    )


def _numeric_flags(ref: DataFrame, gen: DataFrame) -> dict[str, bool]:
    """The classification as a small driver value: one entry per column name.

    Columns that are numbers on both sides by schema need no look at the data.
    """
    both = _numeric(ref) & _numeric(gen)
    rest = [c for c in _shared(ref, gen) if c not in both]
    flags = {c: True for c in both}
    if rest:
        flags |= {r["column"]: r["is_numeric"] for r in classify_columns(ref.select(*rest), gen.select(*rest)).collect()}
    return flags


def sort_keys(ref: DataFrame, types: Mapping[str, bool], limit: int = KEY_DISTINCT_LIMIT) -> list[str]:
    """Text columns plus numeric columns with fewer than ``limit`` distinct values; else all.

    A report for people who choose an order; no comparison depends on it.
    """
    cols = sorted(types)
    numeric = [c for c in cols if types[c]]
    few: set[str] = set()
    if numeric:
        exact = ref.agg(*[F.count_distinct(c).alias(c) for c in numeric]).first()
        few = {c for c in numeric if exact[c] < limit}
    chosen = [c for c in cols if not types[c] or c in few]
    return chosen or cols


def _lost(c: str) -> str:
    return f"{c}\u0001text"


def _normal_columns(df: DataFrame, types: Mapping[str, bool], exact: Mapping[str, int], mixed: set[str]) -> dict[str, Column]:
    """Comparable values: exact decimals, doubles without NaN, folded text, and the text of lost cells."""
    cols = {}
    for c in sorted(types):
        folded = F.lower(F.trim(F.col(c).cast("string")))
        if not types[c]:
            cols[c] = F.coalesce(folded, F.lit(NULL_TEXT))
            continue
        number = _present(df, c) if c in _numeric(df) else to_num(F.col(c).cast("string"))
        cols[c] = F.col(c).cast(T.DecimalType(38, exact[c])) if c in exact else number.cast("double")
        if c in mixed:
            cols[_lost(c)] = F.lit(None).cast("string") if c in _numeric(df) else F.when(number.isNull(), folded)
    return cols


def _normal(df: DataFrame, types: Mapping[str, bool], exact: Mapping[str, int], mixed: set[str]) -> DataFrame:
    return df.select(*[col.alias(c) for c, col in _normal_columns(df, types, exact, mixed).items()])


def _exact_scales(ref: DataFrame, gen: DataFrame, types: Mapping[str, bool]) -> dict[str, int]:
    """Scale of each column that is a whole number or a decimal on both sides."""
    scales = {}
    for c in types:
        kinds = [d.schema[c].dataType for d in (ref, gen)]
        if all(isinstance(k, (T.IntegralType, T.DecimalType)) for k in kinds):
            scales[c] = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in kinds)
    return scales


def _paired(ref: DataFrame, gen: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of both sides next to each other: ``_i``, ``_j`` and the columns ``r_<c>`` and ``g_<c>``.

    The rows of one key are numbered in the order of the other columns.
    """
    cols = ref.columns
    rest = [c for c in cols if c not in keys] or list(keys)
    left = row_counter(ref, rest, by=list(keys), name="_i", nulls="last")
    right = row_counter(gen, rest, by=list(keys), name="_i", nulls="last")
    left = left.select("_i", *[F.col(c).alias(f"r_{c}") for c in cols])
    right = right.select(F.col("_i").alias("_j"), *[F.col(c).alias(f"g_{c}") for c in cols])
    on = (left["_i"] == right["_j"]) & same_keys([left[f"r_{k}"] for k in keys], [right[f"g_{k}"] for k in keys])
    return left.join(right, on, how)


def _cell_tests(types: Mapping[str, bool], tol: float, keys: Sequence[str], mixed: set[str]) -> tuple[list[Column], list[Column]]:
    """Aggregates and report entries over pairs; without ``keys`` a pair stands for ``_w`` rows."""
    aggs: list[Column] = []
    entries: list[Column] = []
    pair = F.col("_i").isNotNull() & F.col("_j").isNotNull() if keys else F.col("_both")
    weight = F.lit(1) if keys else F.col("_w")

    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))

    def entry(c: str | None, kind: str, rows: Column, worst: Column, mean: Column) -> Column:
        return F.struct(
            F.lit(c).cast("string").alias("column"),
            F.lit(kind).alias("kind"),
            worst.cast("double").alias("max_diff"),
            mean.cast("double").alias("mean_diff"),
            rows.cast("long").alias("rows_affected"),
        )

    none = F.lit(None)
    for i, c in enumerate(sorted(types)):
        if c in keys:
            continue
        r, g = F.col(f"r_{c}"), F.col(f"g_{c}")
        if types[c]:
            diff = F.when(pair, F.abs(r - g))
            aggs += [
                F.max(diff).alias(f"{i}_max"),
                (F.sum(diff.cast("double") * weight) / F.sum(F.when(diff.isNotNull(), weight))).alias(f"{i}_mean"),
                rows_where(diff > tol).alias(f"{i}_rows"),
                rows_where(pair & (r.isNull() != g.isNull())).alias(f"{i}_null"),
            ]
            entries.append(entry(c, "numeric", F.col(f"{i}_rows"), F.col(f"{i}_max"), F.col(f"{i}_mean")))
            entries.append(entry(c, "null_pattern", F.col(f"{i}_null"), none, none))
            if c in mixed:
                rt, gt = F.col(f"r_{_lost(c)}"), F.col(f"g_{_lost(c)}")
                aggs.append(rows_where(pair & ~rt.eqNullSafe(gt)).alias(f"{i}_lost"))
                entries.append(entry(c, "lost_cells", F.col(f"{i}_lost"), none, none))
        else:
            aggs.append(rows_where(pair & (r != g)).alias(f"{i}_rows"))
            entries.append(entry(c, "string", F.col(f"{i}_rows"), none, none))
    if keys:
        alone = {"missing_keys": F.col("_j").isNull(), "extra_keys": F.col("_i").isNull()}
    else:
        alone = {"surplus_rows": ~pair}
    for kind, what in alone.items():
        aggs.append(rows_where(what).alias(kind))
        entries.append(entry(None, kind, F.col(kind), none, none))
    if not set(types) - set(keys):
        entries.append(entry(None, "no_shared_columns", F.lit(1), none, none))
    return aggs, entries


def compare_values(
    ref: DataFrame,
    gen: DataFrame,
    tol: float = VALUE_TOLERANCE,
    keys: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Cell by cell -> one row per column and kind of difference; no rows when all cells agree.

    Kinds: ``numeric``, ``null_pattern``, ``string``, ``lost_cells`` (cells of a mostly numeric text column
    that are no numbers and differ as text), ``missing_keys`` and ``extra_keys`` with ``keys``, without them
    ``surplus_rows``, and ``no_shared_columns`` when there is nothing to compare. Text is compared
    trimmed and lower-cased. Without ``keys`` rows pair by position after a sort on ``order``
    (default: text columns, then numbers), ties broken by the other columns.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    types = _numeric_flags(ref, gen)
    keys = list(keys or ())
    schema = "column STRING, kind STRING, max_diff DOUBLE, mean_diff DOUBLE, rows_affected BIGINT"
    if not types:
        return ref.sparkSession.createDataFrame([(None, "no_shared_columns", None, None, 1)], schema)
    exact = _exact_scales(ref, gen, types)
    mixed = {c for c in types if types[c] and c not in keys and not {c} <= _numeric(ref) & _numeric(gen)}
    sides = [_normal(d, types, exact, mixed) for d in (ref, gen)]
    aggs, entries = _cell_tests(types, tol, keys, mixed)
    if keys:
        paired = _paired(*sides, keys, "full")
    else:
        first = list(order) if order else [c for c in sides[0].columns if not types.get(c, False)]
        paired = face_to_face(*sides, [*first, *[c for c in sides[0].columns if c not in first]])
        if paired is None:
            return ref.sparkSession.createDataFrame([], schema)
    return paired.agg(*aggs).select(F.inline(F.array(*entries))).filter("rows_affected > 0")


def proc_compare(base: DataFrame, compare: DataFrame, id: Sequence[str], tol: float = VALUE_TOLERANCE) -> DataFrame:
    """``PROC COMPARE ... ID``: the keyed value comparison."""
    return compare_values(base, compare, tol, keys=id)


# --- cascade ---------------------------------------------------------------------------------

def _test_rows(df: DataFrame, **cols: Column) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(_EMPTY_TESTS).fields]
    types = {f.name: f.dataType for f in T.StructType.fromDDL(_EMPTY_TESTS).fields}
    return df.select(*[cols.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])


def reconcile(
    ref: DataFrame,
    gen: DataFrame,
    row_tol: float = ROW_TOLERANCE,
    value_tol: float = VALUE_TOLERANCE,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Schema and counts gate; aggregates and values both run after them -> test rows.

    Every test has one row of kind ``summary``; the differences found follow as their own rows.
    """
    schema = compare_schema(ref, gen)
    lacking, extra = F.array_join("missing_columns", ", "), F.array_join("extra_columns", ", ")
    out = _test_rows(
        schema, test=F.col("test"), level=F.col("level"), passed=F.col("passed"), kind=F.lit("summary"),
        detail=F.concat(F.lit("missing: "), lacking, F.lit("; extra: "), extra),
    )
    if not schema.first()["passed"]:
        return out
    counts = compare_counts(ref, gen, row_tol)
    gate = counts.first()
    counts = ref.sparkSession.createDataFrame([gate], counts.schema)
    out = out.unionByName(
        _test_rows(
            counts, test=F.col("test"), level=F.col("level"), passed=F.col("passed"), kind=F.lit("summary"),
            reference=F.col("reference_rows"), generated=F.col("generated_rows"), difference=F.col("difference"),
        )
    )
    if not gate["passed"]:
        return out
    # each report has a row per column and kind at most; it is made once and read for summary and detail
    aggregates = stage(compare_aggregates(ref, gen, value_tol), "aggregates")
    values = stage(compare_values(ref, gen, value_tol, keys), "values")
    for test, level, report, bad in (
        ("aggregate_comparison", 5, aggregates, ~F.col("passed")),
        ("value_comparison", 4, values, F.lit(True)),
    ):
        failed = report.filter(bad)
        # surplus rows lie within the count tolerance, which has passed: they are shown, but do not fail
        fails = failed if test == "aggregate_comparison" else failed.filter("kind <> 'surplus_rows'")
        n = F.count(F.lit(1))
        out = out.unionByName(
            _test_rows(
                fails.agg(n.alias("n")), test=F.lit(test), level=F.lit(level), passed=F.col("n") == 0,
                kind=F.lit("summary"), rows_affected=F.col("n"),
            )
        )
        detail = {"test": F.lit(test), "level": F.lit(level), "passed": F.lit(False), "column": F.col("column")}
        if test == "aggregate_comparison":
            detail |= {
                "kind": F.col("aggregate"), "reference": F.col("reference"), "generated": F.col("generated"),
                "difference": F.col("relative_diff"),
            }
        else:
            detail |= {
                "kind": F.col("kind"), "difference": F.col("max_diff"), "rows_affected": F.col("rows_affected"),
                "passed": F.col("kind") == "surplus_rows",
            }
        out = out.unionByName(_test_rows(failed, **detail))
    return out


def reconcile_periods(ref: DataFrame, gen: DataFrame, period: str, keys: Sequence[str], tol: float = VALUE_TOLERANCE) -> DataFrame:
    """(period, status) of all periods in one keyed comparison: FAIL on any differing cell, missing or extra key.

    Ranges of keys whose summed digests agree are equal; only the rows of the other ranges are joined. A missing
    period is a period of its own.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    types = _numeric_flags(ref, gen)
    exact = _exact_scales(ref, gen, types)
    types[period] = False
    exact.pop(period, None)
    every = [period, *[k for k in keys if k != period]]
    mixed = {c for c in types if types[c] and c not in every and not {c} <= _numeric(ref) & _numeric(gen)}
    folded = F.coalesce(F.lower(F.trim(F.col(period).cast("string"))), F.lit(NULL_TEXT))
    names = ref.select(F.col(period).cast("string").alias(period)).union(gen.select(F.col(period).cast("string"))).distinct()
    values = [_normal_columns(d, types, exact, mixed) for d in (ref, gen)]
    rest = differing_rows(ref, gen, folded, every[1:] or every, values)
    paired = _paired(*[_normal(d, types, exact, mixed) for d in rest], every, how="full")
    bad = F.col("_i").isNull() | F.col("_j").isNull()
    for c in sorted(types):
        if c in every:
            continue
        r, g = F.col(f"r_{c}"), F.col(f"g_{c}")
        bad = bad | (F.coalesce(F.abs(r - g) > tol, F.lit(False)) | (r.isNull() != g.isNull()) if types[c] else ~r.eqNullSafe(g))
        if c in mixed:
            bad = bad | ~F.col(f"r_{_lost(c)}").eqNullSafe(F.col(f"g_{_lost(c)}"))
    at = F.coalesce(f"r_{period}", f"g_{period}")
    status = paired.groupBy(at.alias("_folded")).agg(F.when(F.bool_or(bad), "FAIL").otherwise("PASS").alias("status"))
    return names.join(status, folded == F.col("_folded"), "left").select(period, F.coalesce("status", F.lit("PASS")).alias("status"))


def overall_status(tests: DataFrame) -> DataFrame:
    """One row: PASS when every test passed."""
    return tests.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("overall_status"))


def reconcile_all(
    spark: SparkSession,
    refs: Mapping[str, DataFrame],
    targets: Sequence[str],
    read_target: Callable[[str], DataFrame],
    where: str | None = None,
    params: Mapping[str, object] | None = None,
    row_tol: float = ROW_TOLERANCE,
    value_tol: float = VALUE_TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """Cascade over many tables -> (results, summary).

    Names match upper-cased without library. ``where``/``params`` filter the targets only, with
    bound values. No references: mode ``not_applicable``; unreachable targets for every table:
    ``blocked``; else ``full``. An error in one table becomes its row and the others still run.
    """
    from tablesteps.sources.readers import read_where

    wanted = sorted({t.split(".")[-1].upper() for t in targets})
    have = {n.upper(): d for n, d in refs.items()}
    matched = [t for t in wanted if t in have]
    readers = {}
    states, unreachable = [], 0
    for table in matched:
        try:
            readers[table] = read_target(table)
        except Exception as exc:  # noqa: BLE001  one table must not stop the others
            unreachable += 1
            states.append((table, "ERROR", str(exc)))

    def compare(table: str) -> tuple[list, tuple[str, str, str]]:
        try:
            gen = read_where(spark, readers[table], where, params or {}) if where else readers[table]
            rows = reconcile(have[table], gen, row_tol, value_tol).collect()  # one row per test or differing column
            return rows, (table, "PASS" if all(r["passed"] for r in rows) else "FAIL", "")
        except Exception as exc:  # noqa: BLE001
            return [], (table, "ERROR", str(exc))

    # jobs of several tables share the cluster: a small table does not wait for a large one
    with ThreadPoolExecutor(max_workers=TABLES_AT_ONCE) as pool:
        # wrapped once per table: each run gets local properties of its own
        done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(compare), table) for table in readers]]
    states += [state for _, state in done]
    results = [spark.createDataFrame(rows, _EMPTY_TESTS).withColumn("target_table", F.lit(state[0])) for rows, state in done if rows]
    mode = "not_applicable" if not have else "blocked" if matched and unreachable == len(matched) else "full"
    by = {s: sum(1 for x in states if x[1] == s) for s in ("PASS", "FAIL", "ERROR")}
    summary = spark.createDataFrame(
        [
            (
                mode, len(matched), by["PASS"], by["FAIL"], by["ERROR"], round(by["PASS"] / max(len(matched), 1), 3),
                sorted(set(wanted) - set(matched)), sorted(set(have) - set(wanted)),
            )
        ],
        "validation_mode STRING, total_tables INT, passed INT, failed INT, errors INT, pass_rate DOUBLE, "
        "unvalidated_targets ARRAY<STRING>, unmatched_references ARRAY<STRING>",
    )
    status = spark.createDataFrame(states, "target_table STRING, overall_status STRING, message STRING")
    details = (
        reduce(lambda a, b: a.unionByName(b), results)
        if results
        else spark.createDataFrame([], _EMPTY_TESTS + ", target_table STRING")
    )
    return status.join(details, "target_table", "left"), summary


# --- causes ----------------------------------------------------------------------------------

def diagnose(
    ref: DataFrame, gen: DataFrame, keys: Sequence[str], tol: float = VALUE_TOLERANCE
) -> DataFrame:
    """Probable cause per differing column -> (column, cause, rows_affected, expected, actual).

    Rules, first hit wins: missing rows or columns, and rows of a key that one side holds more often
    -> missing_transform; same values in another
    order -> row_order; only the NULL pattern differs -> null_semantics; small numeric differences
    -> rounding; texts equal as numbers -> type_coercion, after mojibake repair -> encoding, after
    case and accent folding -> collation; else unknown. Text is compared as stored.
    """
    ref, gen = repair_names(ref), repair_names(gen)
    types = _numeric_flags(ref, gen)
    cols = [c for c in sorted(types) if c not in keys]
    plain = {c: types[c] and c in _numeric(ref) and c in _numeric(gen) for c in types}
    exact = _exact_scales(ref, gen, types)

    def cell(d: DataFrame, c: str) -> Column:
        if c in exact:
            return F.col(c).cast(T.DecimalType(38, exact[c]))
        return _present(d, c).cast("double") if plain[c] else F.col(c).cast("string")

    ref_n, gen_n = [d.select(*[cell(d, c).alias(c) for c in sorted(types)]) for d in (ref, gen)]
    paired = _paired(ref_n, gen_n, keys)
    aggs, entries = [], []
    for i, c in enumerate(cols):
        r, g = F.col(f"r_{c}"), F.col(f"g_{c}")
        null = r.isNull() != g.isNull()
        differs = F.coalesce(F.abs(r - g) > tol, F.lit(False)) if plain[c] else F.coalesce(r != g, F.lit(False))
        bad = null | differs
        aggs += [
            F.count_if(bad).alias(f"{i}_bad"),
            F.count_if(null).alias(f"{i}_null"),
            (F.sum(F.xxhash64(r).cast("decimal(20,0)")) == F.sum(F.xxhash64(g).cast("decimal(20,0)"))).alias(f"{i}_same"),
            F.min(F.when(bad, F.struct(r.cast("string").alias("e"), g.cast("string").alias("a")))).alias(f"{i}_ex"),
        ]
        n, k, same = F.col(f"{i}_bad"), F.col(f"{i}_null"), F.col(f"{i}_same")
        cause = F.when(same, "row_order").when(n == k, "null_semantics")
        if plain[c]:
            aggs.append(F.max(F.abs(r - g)).alias(f"{i}_max"))
            cause = cause.when(F.col(f"{i}_max") < 1e-2, "rounding")
        else:
            tests = {
                "type_coercion": F.coalesce(F.abs(to_num(r) - to_num(g)) <= tol, F.lit(False)),
                "encoding": repair_text(r) == repair_text(g),
                "collation": F.lower(fold_accents(F.trim(r))) == F.lower(fold_accents(F.trim(g))),
            }
            for name, ok in tests.items():
                aggs.append(F.bool_and(F.when(differs, ok)).alias(f"{i}_{name}"))
                cause = cause.when(F.col(f"{i}_{name}"), name)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                cause.otherwise("unknown").alias("cause"),
                n.alias("rows_affected"),
                F.col(f"{i}_ex.e").alias("expected"),
                F.col(f"{i}_ex.a").alias("actual"),
            )
        )
    out = paired.agg(*aggs).select(F.inline(F.array(*entries))).filter("rows_affected > 0")
    absent = key_diff(ref_n.select(*keys), gen_n.select(*keys), list(keys)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    out = out.unionByName(
        absent.select(
            none.alias("column"), F.lit("missing_transform").alias("cause"), F.col("n").alias("rows_affected"),
            F.col("side").alias("expected"), none.alias("actual"),
        )
    )
    # rows of a key that one side holds more often: no partner, so no cell tells a cause
    sides = ref_n.select(*keys, F.lit(1).alias("_r"), F.lit(0).alias("_g")).unionByName(gen_n.select(*keys, F.lit(0).alias("_r"), F.lit(1).alias("_g")))
    held = sides.groupBy(*keys).agg(F.sum("_r").alias("_r"), F.sum("_g").alias("_g")).filter("_r > 0 AND _g > 0 AND _r <> _g")
    surplus = held.groupBy(F.when(F.col("_r") > F.col("_g"), "surplus_in_a").otherwise("surplus_in_b").alias("side")).agg(F.sum(F.abs(F.col("_r") - F.col("_g"))).alias("n"))
    out = out.unionByName(
        surplus.select(
            none.alias("column"), F.lit("missing_transform").alias("cause"), F.col("n").alias("rows_affected"), F.col("side").alias("expected"), none.alias("actual")
        )
    )
    lacking = sorted(set(ref.columns) - set(gen.columns))
    if lacking:
        names = ref.sparkSession.createDataFrame([(c,) for c in lacking], "column STRING")
        out = out.unionByName(
            names.select(
                "column", F.lit("missing_transform").alias("cause"), F.lit(0).cast("long").alias("rows_affected"),
                F.lit("column").alias("expected"), none.alias("actual"),
            )
        )
    return out


def verify_tables(spark: SparkSession, conns: DataFrame) -> DataFrame:
    """Do declared tables exist -> (qualified_name, alias, role, exists, problem).

    ``conns(alias, schema_name, role, tables array)``. A missing target blocks, a missing source
    warns.
    """
    declared = conns.select("alias", F.lower("schema_name").alias("schema_name"), "role", F.explode("tables").alias("table_name"))
    schemas = [r[0] for r in conns.select(F.lower("schema_name")).distinct().collect()]  # configuration rows
    known = {r.namespace.lower() for r in spark.sql("SHOW DATABASES").collect()}
    listed = [
        spark.sql(f"SHOW TABLES IN `{s}`").select(F.lower("namespace").alias("_s"), F.lower("tableName").alias("_t"))
        for s in schemas
        if s in known
    ]
    empty = spark.createDataFrame([], "_s STRING, _t STRING")
    found = reduce(lambda a, b: a.union(b), listed, empty).withColumn("_hit", F.lit(True))
    on = (F.lower("table_name") == found["_t"]) & (F.col("schema_name") == found["_s"])
    exists = F.col("_hit").isNotNull()
    return declared.join(found, on, "left").select(
        F.concat_ws(".", "schema_name", "table_name").alias("qualified_name"),
        "alias",
        "role",
        exists.alias("exists"),
        F.when(exists, "")
        .when(F.col("role").isin("target", "both"), "missing_target")
        .otherwise("missing_source")
        .alias("problem"),
    )


def verify_status(report: DataFrame) -> DataFrame:
    """Status word of a table check: blocked_missing_targets, missing_sources or ok."""
    return report.agg(
        F.when(F.count_if(F.col("problem") == "missing_target") > 0, "blocked_missing_targets")
        .when(F.count_if(F.col("problem") == "missing_source") > 0, "missing_sources")
        .otherwise("ok")
        .alias("status")
    )
