"""MERGE with presence flags, SQL joins, key-set comparison and prioritised lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteps.operators.ordered import pick_rows
from tablesteps.session import has_hot_group, same_keys

_KEEP = ("all", "both", "left", "right", "left_only", "right_only")


def merge_by(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    keep: str = "all",
    in_: tuple[str, str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    overlay: bool = False,
) -> DataFrame:
    """``MERGE a(in=x) b(in=y); BY k;`` with missing keys matching each other.

    ``keep``: all rows, ``both`` (if x and y), ``left`` (if x), ``right`` (if y), ``left_only``
    (if x and not y), ``right_only``. ``in_`` names the presence flags. Clashing columns get
    ``suffixes``, or with ``overlay`` the right side wins where it has a row. Repeated keys on
    both sides give all pairs, as in a relational merge.
    """
    if keep not in _KEEP:
        raise ValueError(f"unknown keep {keep!r}")
    by = list(by)
    if keep in ("left_only", "right_only"):
        left, right = (a, b) if keep == "left_only" else (b, a)
        out = _anti(left, right, by)
        if in_:
            out = out.withColumns({in_[0]: F.lit(keep == "left_only"), in_[1]: F.lit(keep == "right_only")})
        return out

    rest_a, rest_b = [c for c in a.columns if c not in by], [c for c in b.columns if c not in by]
    clash = set(rest_a) & set(rest_b)
    left = a.select(*by, *[F.col(c).alias(f"_a_{c}") for c in rest_a], F.lit(True).alias("_in_a"))
    right = b.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], *[F.col(c).alias(f"_b_{c}") for c in rest_b], F.lit(True).alias("_in_b")
    )
    how = {"all": "full", "both": "inner", "left": "left", "right": "right"}[keep]
    joined = _join(left, right, by, how)

    in_a, in_b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    keys = [F.when(in_a, F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in by]
    cols: list[Column] = []
    for c in rest_a:
        if c not in clash:
            cols.append(F.col(f"_a_{c}").alias(c))
        elif overlay:
            cols.append(F.when(in_b, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c))
        else:
            cols.append(F.col(f"_a_{c}").alias(c + suffixes[0]))
    for c in rest_b:
        if c not in clash:
            cols.append(F.col(f"_b_{c}").alias(c))
        elif not overlay:
            cols.append(F.col(f"_b_{c}").alias(c + suffixes[1]))
    flags = [in_a.alias(in_[0]), in_b.alias(in_[1])] if in_ else []
    return joined.select(*keys, *cols, *flags)


def _on(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return same_keys([left[k] for k in by], [right[f"_k_{k}"] for k in by])


def _join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join on NULL-safe keys.

    A full outer sort-merge join keeps all pairs of one key in memory until the key is done; a left one hands
    them on. A full join is therefore a left join and the unmatched rows of the right side. Adaptive execution can split a
    hot key of both sides in an inner join and of the kept side in an anti join. With a hot key an outer join is
    put together from an inner join and the unmatched rows of each kept side.
    """
    if how == "inner":
        return left.join(right, _on(left, right, by), "inner")
    right_keys = right.select(*[F.col(f"_k_{k}").alias(k) for k in by])
    hot = has_hot_group(left, by) or has_hot_group(right_keys, by)
    if how == "right" and not hot:
        return left.join(right, _on(left, right, by), "right")
    out = left.join(right, _on(left, right, by), "inner" if hot else "left")
    if hot and how in ("full", "left"):
        lone = left.join(
            right.select(*[f"_k_{k}" for k in by]).distinct(), _on(left, right, by), "left_anti"
        )
        out = out.unionByName(lone, allowMissingColumns=True)
    if how in ("full", "right"):
        lone = right.join(left.select(*by).distinct(), _on(left, right, by), "left_anti")
        out = out.unionByName(lone, allowMissingColumns=True)
    return out


def _anti(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = right.select(*[F.col(k).alias(f"_k_{k}") for k in by]).distinct()
    return left.join(keys, same_keys([left[k] for k in by], [keys[f"_k_{k}"] for k in by]), "left_anti")


def sql_join(a: DataFrame, b: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """SQL INNER / LEFT / RIGHT / FULL JOIN: missing keys match nothing."""
    return a.join(b, list(on) if not isinstance(on, Column) else on, how)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """``FROM a, b``: the comma join of the source language. Its output is rows(a) x rows(b)."""
    return a.crossJoin(b)


def update_by(master: DataFrame, trans: DataFrame, by: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """``UPDATE master trans; BY k;``: values present in the transaction win, missing ones do not.

    Transactions of one key apply in the order of ``order_by``: of each column the last value present counts.
    Without ``order_by`` a repeated transaction key is an error. Keys absent from the master are added.
    """
    values = [c for c in trans.columns if c not in by]
    if order_by:
        at = F.struct(*[F.col(c) for c in [*order_by, *[c for c in values if c not in order_by]]])
        trans = trans.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in values])
    else:
        once = trans.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
        repeated = F.raise_error(F.lit("a transaction key is repeated: order_by must say which comes last")).cast("bigint")
        trans = once.filter(F.when(F.col("_n") > 1, repeated).otherwise(F.col("_n")) > 0).drop("_n")
    both = merge_by(master, trans, by, suffixes=("__m", "__t"))
    cols = [F.col(k) for k in by]
    for c in [c for c in master.columns if c not in by]:
        cols.append(F.coalesce(f"{c}__t", f"{c}__m").alias(c) if c in trans.columns else F.col(c))
    cols += [F.col(c) for c in trans.columns if c not in by and c not in master.columns]
    return both.select(*cols)


def key_diff(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys of one side only -> (key..., side) with ``missing_in_b`` or ``extra_in_b``.

    One union and one aggregate: repeated keys fold map-side, so no key can grow a task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sides = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return (
        sides.groupBy(*keys)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .filter("_a <> _b")
        .select(*keys, F.when(F.col("_a") == 1, "missing_in_b").otherwise("extra_in_b").alias("side"))
    )


def set_equal(a: DataFrame, b: DataFrame, key: str, samples: int = 10) -> DataFrame:
    """One row: are two key sets equal, how many differ on each side, and the first few of them."""
    diff = key_diff(a, b, key).withColumn("_text", F.col(key).cast("string"))
    counts = diff.agg(
        F.count_if(F.col("side") == "missing_in_b").alias("only_a"),
        F.count_if(F.col("side") == "extra_in_b").alias("only_b"),
    )
    first = {}
    for side in ("missing_in_b", "extra_in_b"):
        head = diff.filter(F.col("side") == side).orderBy("_text").limit(samples)
        first[side] = head.agg(F.sort_array(F.collect_list("_text")).alias("s"))
    return counts.select(
        ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"),
        "only_a",
        "only_b",
        first["missing_in_b"].scalar().alias("sample_a"),
        first["extra_in_b"].scalar().alias("sample_b"),
    )


def in_scope(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def out_of_scope(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def match_two_tier(
    a: DataFrame, b: DataFrame, full: str, short: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Match names on the full form; only what is left over matches on the last dotted part.

    -> (by..., name_a, name_b, tier). Among leftovers with one short name the first by name wins.
    """
    by = list(by)

    def side(df: DataFrame, tag: str) -> DataFrame:
        name = F.upper(F.col(full))
        last = F.upper(F.col(short)) if short else F.element_at(F.split(name, "[.]"), -1)
        return df.select(*by, name.alias("_full"), last.alias("_short"), F.col(full).alias(f"name_{tag}"))

    left, right = side(a, "a"), side(b, "b")
    left, right = pick_rows(left, [*by, "_full"], ["name_a"]), pick_rows(right, [*by, "_full"], ["name_b"])
    exact = left.drop("_short").join(right.drop("_short"), [*by, "_full"], "inner")
    key = [*by, "_full"]
    rest_a = pick_rows(left.join(right.select(*key), key, "left_anti"), [*by, "_short"], ["_full"])
    rest_b = pick_rows(right.join(left.select(*key), key, "left_anti"), [*by, "_short"], ["_full"])
    loose = rest_a.drop("_full").join(rest_b.drop("_full"), [*by, "_short"], "inner")
    cols = [*by, "name_a", "name_b"]
    return exact.select(*cols, F.lit("full").alias("tier")).unionByName(
        loose.select(*cols, F.lit("short").alias("tier"))
    )


def resolve_owner(tables: DataFrame, conns: DataFrame, table: str = "table_name") -> DataFrame:
    """Owner of each table: the connection that lists it, else the first target, else the first.

    ``conns(position, alias, role, tables array)`` -> (table, alias, rule).
    """
    wanted = tables.select(table).distinct().withColumn("_t", F.upper(table))
    listed = conns.select("position", "alias", F.explode("tables").alias("_t")).withColumn("_t", F.upper("_t"))
    owner = listed.groupBy("_t").agg(F.min_by("alias", "position").alias("_listed"))
    fallback = conns.agg(
        F.min_by("alias", F.when(F.col("role").isin("target", "both"), F.col("position"))).alias("by_role"),
        F.min_by("alias", "position").alias("by_order"),
    )
    return wanted.join(owner, "_t", "left").select(
        table,
        F.coalesce(
            "_listed", fallback.select("by_role").scalar(), fallback.select("by_order").scalar()
        ).alias("alias"),
        F.when(F.col("_listed").isNotNull(), "listed")
        .when(fallback.select("by_role").scalar().isNotNull(), "role")
        .when(fallback.select("by_order").scalar().isNotNull(), "first")
        .alias("rule"),
    )


def prefix_join(
    df: DataFrame, prices: DataFrame, key: str, prefix: str = "prefix", overrides: DataFrame | None = None
) -> DataFrame:
    """Each row gets the columns of the longest ``prefix`` its key starts with (missing if none).

    Rows meet the price table by equality on each prefix length that occurs, so neither side is
    broadcast blindly; only distinct keys are matched, then joined back.
    """
    table = prices
    if overrides is not None:
        table = prices.join(overrides.select(prefix), prefix, "left_anti").unionByName(overrides)
    lengths = table.select(F.length(prefix).alias("_len")).distinct().agg(F.collect_set("_len").alias("_lens"))
    names = df.select(F.col(key).alias("_key")).distinct()
    pieces = (
        names.withColumn("_len", F.explode(lengths.scalar()))
        .filter(F.length("_key") >= F.col("_len"))
        .withColumn(prefix, F.substring(F.col("_key"), F.lit(1), F.col("_len")))
    )
    best = pick_rows(pieces.join(table, prefix, "inner"), ["_key"], ["_len"], desc=["_len"]).drop("_len")
    best = best.withColumnRenamed(prefix, f"matched_{prefix}")
    return df.join(best, df[key] == best["_key"], "left").drop("_key")


def pick_best(df: DataFrame, key: Sequence[str], score: Column | str, ties: Sequence[str], largest: bool = True) -> DataFrame:
    """The best variant per key: largest (or smallest) score, ties to the first by ``ties``."""
    scored = df.withColumn("_score", F.expr(score) if isinstance(score, str) else score)
    w = W.partitionBy(*key).orderBy(
        F.desc_nulls_last("_score") if largest else F.asc_nulls_last("_score"), *[F.asc(t) for t in ties]
    )
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_score")
