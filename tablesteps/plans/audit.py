"""Audit joins between source programs and migrated code, quality gates, row contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.operators.joins import key_diff
from tablesteps.operators.ordered import pick_rows
from tablesteps.plans.corpus import PROC_HTTP, http_calls

SEVERITIES = ("high", "medium", "low")

# Feature-pair rules (rule, severity, category, condition over s_* and t_* flags).
PAIR_RULES = (
    ("append_to_delete", "high", "semantic", "s_db_append AND NOT s_db_delete AND t_delete_from"),
    (
        "replace_to_append", "medium", "semantic",
        "s_sql_create_table AND NOT s_db_append AND t_append_write AND NOT t_delete_from AND NOT t_select_into",
    ),
    ("http_missing", "high", "semantic", "s_proc_http AND NOT t_requests_like"),
    ("credential_handling", "medium", "security", "s_macro_user_pass AND NOT t_env_secret"),
    ("import_missing", "medium", "semantic", "s_proc_import AND NOT t_read_file"),
    ("plot_missing", "medium", "semantic", "(s_proc_gplot OR s_proc_gchart) AND NOT t_plot_like"),
    ("compare_missing", "medium", "semantic", "s_proc_compare AND NOT t_compare_like"),
)

# Place rules (rule, severity, condition over placement and low-cased code).
PLACE_RULES = (
    (
        "full_read_heavy_client", "high",
        "placement = 'sql_pushdown' AND _low LIKE '%read_sql%' AND _low NOT LIKE '%where%' AND (_text LIKE '%.groupby(%' OR _text LIKE '%.merge(%')",
    ),
    (
        "dynamic_sql", "high",
        "placement = 'pandas' AND _low LIKE '%read_sql%' AND (contains(_text, 'f\"') OR contains(_text, 'f\\'') OR contains(_text, '.format('))",
    ),
    ("extract_without_where", "medium", "placement = 'hybrid' AND _low LIKE '%read_sql%' AND _low NOT LIKE '%where%'"),
    ("utility_with_io", "low", "placement = 'utility' AND _low RLIKE 'read_sql|read_csv|read_excel|to_sql'"),
)

# Tables a program writes for others to read; tables target code reads.
DEST_TABLE = (
    r"(?iU)\bPROC\s+APPEND\b[\s\S]{0,200}?\bBASE\s*=\s*([A-Za-z_][\w.]*)",
    r"(?iU)\bINSERT\s+INTO\s+([A-Za-z_][\w.]*)",
    r"(?iU)\bCREATE\s+TABLE\s+([A-Za-z_][\w.]*)",
)
FROM_TABLE = r"""(?iU)\bfrom\s+["'`\[]?(?:\w+["'`\]]?\.["'`\[]?)?(\w+)\b"""


def audit_coverage(nodes: DataFrame, maps: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Nodes without a mapping (high) and mappings without a node (medium) -> issue rows.

    Ignored nodes need no mapping.
    """
    diff = key_diff(nodes, maps, "id")
    if ignored is not None:
        skip = ignored.select("id").distinct().withColumn("_skip", F.lit(True))
        diff = diff.join(skip, "id", "left").filter((F.col("side") == "extra_in_b") | F.col("_skip").isNull()).drop("_skip")
    missing = F.col("side") == "missing_in_b"
    return diff.select(
        "id",
        F.when(missing, "missing_mapping").otherwise("extra_mapping").alias("rule"),
        F.when(missing, "high").otherwise("medium").alias("severity"),
        F.lit("coverage").alias("category"),
    )


def audit_pairs(feat_src: DataFrame, feat_dst: DataFrame, rules: Sequence[tuple[str, str, str, str]] = PAIR_RULES) -> DataFrame:
    """A rule fires when the source has a feature and the target lacks (or adds) one -> issue rows."""
    src = feat_src.toDF(*[c if c == "id" else f"s_{c}" for c in feat_src.columns])
    dst = feat_dst.toDF(*[c if c == "id" else f"t_{c}" for c in feat_dst.columns])
    return _fire(src.join(dst, "id"), rules)


def audit_place(targets: DataFrame, rules: Sequence[tuple[str, str, str]] = PLACE_RULES) -> DataFrame:
    """Does the migrated code respect where the step runs: ``targets(id, placement, text)``."""
    rows = targets.select("id", "placement", F.col("text").alias("_text"), F.lower("text").alias("_low"))
    return _fire(rows, [(r, s, "placement", c) for r, s, c in rules])


def _fire(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    found = [
        F.when(F.expr(cond), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("category")))
        for r, s, c, cond in rules
    ]
    return rows.select("id", F.inline(F.array_compact(F.array(*found))))


def dest_tables(programs: DataFrame) -> DataFrame:
    """Persistent tables a program fills -> (id, table), lower case."""
    names = F.concat(*[F.regexp_extract_all("code", F.lit(p), F.lit(1)) for p in DEST_TABLE])
    clean = F.transform(names, lambda n: F.lower(F.regexp_replace(n, r"^\.+|\.+$", "")))
    kept = F.filter(clean, lambda n: (n != "") & (n != "work") & ~n.startswith("work."))
    return programs.select("id", F.explode(F.array_distinct(kept)).alias("table"))


def audit_origin(programs: DataFrame, targets: DataFrame) -> DataFrame:
    """Source drift -> issue rows (all high).

    ``endpoint_changed``: the target makes HTTP calls but names none of the source's hosts.
    ``http_replaced_by_read``: the source calls HTTP, the target does not, and reads a table the
    HTTP programs of the project fill. ``targets(id, text)``.
    """
    low = F.lower("text")
    http = low.rlike(r"requests\.|httpx\.|urllib")
    code = targets.select("id", low.alias("_low"), http.alias("_http"))
    hosts = http_calls(programs).filter("host <> ''").select("id", "host").distinct()
    changed = (
        hosts.join(code.filter("_http"), "id")
        .groupBy("id")
        .agg(F.bool_or(F.contains(F.col("_low"), F.col("host"))).alias("_named"))
        .filter("NOT _named")
        .select("id", F.lit("endpoint_changed").alias("rule"))
    )
    callers = programs.filter(F.col("code").rlike(PROC_HTTP))
    filled = dest_tables(callers).select(F.substring_index("table", ".", -1).alias("table")).distinct()
    reads = (
        code.filter("NOT _http")
        .join(callers.select("id"), "id", "left_semi")
        .select("id", F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit(FROM_TABLE), F.lit(1)))).alias("table"))
    )
    replaced = reads.join(filled, "table", "left_semi").select("id").distinct()
    replaced = replaced.select("id", F.lit("http_replaced_by_read").alias("rule"))
    return changed.unionByName(replaced).select(
        "id", "rule", F.lit("high").alias("severity"), F.lit("semantic").alias("category")
    )


def review_issues(reviews: DataFrame, shown: int = 3) -> DataFrame:
    """Reviewer verdicts ``revise`` -> issue rows; the first issues joined by ``; ``.

    ``reviews(id, verdict, issues array<string>)``.
    """
    detail = F.array_join(F.slice("issues", 1, shown), "; ")
    return reviews.filter("verdict = 'revise'").select(
        "id",
        F.lit("review_flagged").alias("rule"),
        F.lit("medium").alias("severity"),
        F.lit("verification").alias("category"),
        F.when(detail == "", "no detail").otherwise(detail).alias("detail"),
    )


def degraded_issues(maps: DataFrame) -> DataFrame:
    """Mappings marked degraded -> issue rows; ``maps(id, degraded, degraded_reason)``."""
    return maps.filter("degraded").select(
        "id",
        F.lit("degraded").alias("rule"),
        F.lit("high").alias("severity"),
        F.lit("degraded").alias("category"),
        F.coalesce("degraded_reason", F.lit("no reason recorded")).alias("detail"),
    )


def audit_issues(*parts: DataFrame) -> DataFrame:
    """All issue tables as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def audit_summary(
    issues: DataFrame, nodes: DataFrame, maps: DataFrame, ignored: DataFrame, severities: Sequence[str] = SEVERITIES
) -> DataFrame:
    """One row: totals, scope, issues per severity (zero shown), missing and extra mappings."""
    n = F.count(F.lit(1))
    skipped = nodes.select("id").join(ignored.select("id").distinct(), "id", "left_semi").agg(n).scalar()
    total = nodes.agg(F.count_distinct("id")).scalar()
    return issues.agg(
        n.alias("issues_total"),
        *[F.count_if(F.col("severity") == s).alias(f"issues_{s}") for s in severities],
        F.count_if(F.col("rule") == "missing_mapping").alias("missing_mapping"),
        F.count_if(F.col("rule") == "extra_mapping").alias("extra_mapping"),
    ).select(
        total.alias("nodes_total"),
        (total - skipped).alias("nodes_in_scope"),
        skipped.alias("ignored"),
        maps.agg(F.count_distinct("id")).scalar().alias("mappings_total"),
        "*",
    )


# --- gates -----------------------------------------------------------------------------------

def gate_none(df: DataFrame, gate: str, bad: Column | str, key: str, samples: int = 5) -> DataFrame:
    """Passes when no row is ``bad`` -> (gate, passed, n_bad, error with the first keys)."""
    rows = df.filter(F.expr(bad) if isinstance(bad, str) else bad).select(F.col(key).cast("string").alias("_k"))
    first = rows.orderBy("_k").limit(samples).agg(F.array_join(F.sort_array(F.collect_list("_k")), ", ").alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(gate).alias("gate"),
        (F.col("n_bad") == 0).alias("passed"),
        "n_bad",
        F.when(F.col("n_bad") == 0, "").otherwise(F.concat(F.lit("e.g. "), first.scalar())).alias("error"),
    )


def gate_same_keys(a: DataFrame, b: DataFrame, gate: str, key: str = "id", samples: int = 10) -> DataFrame:
    """Passes when two key sets are equal."""
    return gate_none(key_diff(a, b, key), gate, F.lit(True), key, samples)


def gate_distinct_notes(reviews: DataFrame, gate: str, note: str = "note", threshold: float = 0.5) -> DataFrame:
    """Fails when review notes are one text repeated: distinct / total below ``threshold``."""
    from tablesteps.plans.corpus import distinct_ratio

    row = distinct_ratio(reviews, note, threshold)
    return row.select(
        F.lit(gate).alias("gate"),
        "passed",
        F.when(F.col("passed"), 0).otherwise(F.col("total") - F.col("distinct_texts")).cast("long").alias("n_bad"),
        F.when(F.col("passed"), "")
        .otherwise(F.concat(F.col("distinct_texts").cast("string"), F.lit(" distinct of "), F.col("total").cast("string")))
        .alias("error"),
    )


def gate_contradictions(verdicts: DataFrame, findings: DataFrame, cards: DataFrame, gate: str) -> DataFrame:
    """Fails when a category is declared clean although findings exist and no card covers it.

    ``verdicts(category, verdict)``, ``findings(category)``, ``cards(category)``.
    """
    cat = F.lower(F.trim("category")).alias("category")
    clean = verdicts.filter(F.lower("verdict").contains("no improvements")).select(cat).distinct()
    bad = clean.join(findings.select(cat).distinct(), "category", "left_semi").join(
        cards.select(cat).distinct(), "category", "left_anti"
    )
    return gate_none(bad, gate, F.lit(True), "category")


def check_gates(*gates: DataFrame) -> DataFrame:
    """All expectations as one report -> (gate, passed, n_bad, error)."""
    return reduce(lambda a, b: a.unionByName(b), gates)


# --- row contract ----------------------------------------------------------------------------

def validate_rows(df: DataFrame, contract: Mapping[str, Mapping[str, object]], key: str, shown: int = 20) -> DataFrame:
    """Check every row against a contract -> (n_checked, n_errors, errors first ``shown``).

    Per column: ``required``, ``type`` (a cast that must succeed), ``enum``, ``max_items``. A column
    the table lacks breaks every required rule on it.
    """
    tests = []
    for name, rule in contract.items():
        if name not in df.columns:
            if rule.get("required"):
                tests.append((F.lit(True), f"{name}: missing"))
            continue
        c = F.col(name)
        if rule.get("required"):
            tests.append((c.isNull(), f"{name}: missing"))
        if "type" in rule:
            tests.append((c.isNotNull() & c.cast("string").try_cast(str(rule["type"])).isNull(), f"{name}: not {rule['type']}"))
        if "enum" in rule:
            tests.append((c.isNotNull() & ~c.isin(*rule["enum"]), f"{name}: outside the domain"))
        if "max_items" in rule:
            tests.append((F.coalesce(F.size(c), F.lit(0)) > rule["max_items"], f"{name}: too many items"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for bad, msg in tests]))
    rows = df.select(F.col(key).cast("string").alias("_k"), found.alias("_e"))
    errors = rows.filter(F.size("_e") > 0).select("_k", F.explode("_e").alias("_m"))
    first = errors.orderBy("_k", "_m").limit(shown)
    lines = first.agg(F.sort_array(F.collect_list(F.concat_ws(" ", F.concat(F.lit("["), "_k", F.lit("]")), "_m")))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n_checked"), F.coalesce(F.sum(F.size("_e")), F.lit(0)).alias("n_errors")).withColumn(
        "errors", lines
    )


def issues_per_node(issues: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` rules of each node as one text -> (id, n_issues, rules)."""
    counts = issues.groupBy("id").agg(F.count(F.lit(1)).alias("n_issues"))
    first = pick_rows(issues.select("id", "rule").distinct(), ["id"], ["rule"], k=k)
    text = first.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("rule")), "; ").alias("rules"))
    return counts.join(text, "id", "left")
