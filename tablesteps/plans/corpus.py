"""Analytics over program texts: libraries, table access, rules, repetition, features, coverage.

Patterns are matched inside each row; only the (small) hits travel. Lists of ids per term are cut to
the first ``MAX_IDS`` by a per-task limit before they are collected; the full membership is a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.scalars import base_name, norm_block, url_host
from tablesteps.operators.ordered import pick_rows, row_counter
from tablesteps.plans.programs import DB_ENGINES

MAX_IDS = 20

# Endings that are files, words that cannot be a SQL alias.
FILE_EXTENSIONS = ("XLSX", "XLS", "CSV", "TXT", "PDF", "HTML", "SAS7BDAT")
SQL_KEYWORDS = ("ON", "WHERE", "GROUP", "ORDER", "LEFT", "RIGHT", "INNER", "OUTER", "FULL", "JOIN", "AS", "USING")

# Patterns of library names, table references, writes.
LIBNAME = r"(?U)\bLIBNAME\s+([A-Z][A-Z0-9_]{0,7})\s+(\w+)?"
QUALIFIED = r"(?U)\b([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b"
ALIAS = r"(?U)\b(?:FROM|JOIN)\s+[\w.&]+\s+(?:AS\s+)?([A-Z][A-Z0-9_]{0,7})\b"
WRITES = (
    r"(?iU)\b(?:CREATE\s+TABLE|INSERT\s+INTO|DELETE\s+FROM|UPDATE|APPEND\s+BASE\s*=|DATA)"
    r"\s+([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b"
)
APPEND_WRITE = r"(?iU)\b(?:APPEND\s+BASE\s*=)\s*([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b"
NUMBER_LITERAL = r"(?U)(?<![\w.])(\d{3,})(?![\w.])"
PARAMETER = r"(?U)&(\w+)"
CASE_EXPR = r"(?isU)CASE\s+WHEN\b.{10,200}?\bEND\b"
PRODUCT_EXPR = r"(?U)\b\w+\s*\*\s*\w+\s*/\s*\d+\b"

# Rule id, severity, category, pattern.
SMELL_RULES = (
    ("hardcoded_path", "error", "maintainability", r"""(?isU)[A-Z]:[\\\/][^\s"']+|\/sasdata\/[^\s"']+|\\\\[^\s"']+"""),
    ("date_hardcoded", "warning", "reproducibility", r"(?isU)\b(19|20)\d{2}[01]\d[0-3]\d\b|'[0-9]{4}-[0-9]{2}-[0-9]{2}'"),
    ("proc_sql_cartesian", "error", "performance", r"(?isU)FROM\s+\w+\s*,\s*\w+(?!\s+WHERE)"),
    ("credential_leak", "error", "security", r"""(?isU)(password|passwd|pwd)\s*=\s*["']?\S+"""),
    ("select_star", "info", "quality", r"(?isU)SELECT\s+\*"),
    ("implicit_missing", "warning", "quality", r"(?isU)\bIF\b[^;]+\bTHEN\s+\w+\s*=[^;]+;\s*(?!/\*)"),
    ("no_proc_quit", "info", "quality", r"(?isU)PROC\s+SQL\b(?!.*QUIT)"),
)

# Features of source programs and of target code.
SOURCE_FEATURES = {
    "proc_http": r"(?iU)\bPROC\s+HTTP\b",
    "macro_user_pass": r"(?iU)&(user|password)\b",
    "proc_import": r"(?iU)\bPROC\s+IMPORT\b",
    "db_append": r"(?iU)\bPROC\s+APPEND\b|\bAPPEND\s+BASE\s*=|\bINSERT\s+INTO\b",
    "db_delete": r"(?iU)\bDELETE\s+FROM\b",
    "sql_create_table": r"(?iU)\bCREATE\s+TABLE\b",
    "proc_compare": r"(?iU)\bPROC\s+COMPARE\b",
    "proc_gplot": r"(?iU)\bPROC\s+GPLOT\b",
    "proc_gchart": r"(?iU)\bPROC\s+GCHART\b",
    "proc_template": r"(?iU)\bPROC\s+TEMPLATE\b",
}
TARGET_FEATURES = {
    "requests_like": r"(?i)requests\.|httpx\.|urllib",
    "env_secret": r"(?i)os\.environ|getenv|dotenv|keyring",
    "read_file": r"(?i)read_excel\(|read_csv\(",
    "delete_from": r"(?i)delete from",
    "append_write": r"""(?i)if_exists=["']append["']|insert into""",
    "select_into": r"(?isU)\bselect\b.*\binto\s+[\w.\[\]]+",
    "compare_like": r"(?i)compare|assert|mismatch|diff|brecha",
    "plot_like": r"(?i)matplotlib|plt\.|plot\(|bar\(|lineplot|scatter",
    "homolog_marker": r"(?i)homologo",
}

# Text rule packs (rule id, pattern).
RULE_PACKS = {
    "secrets": (
        ("password_literal", r"""(?iU)\b(?:password|passwd|pwd)\s*=\s*['"][^'"]{3,}['"]"""),
        ("vendor_key", r"sk-[a-z]{3,}-[A-Za-z0-9_-]{8,}"),
        ("cloud_key", r"AKIA[0-9A-Z]{16}"),
        ("bearer", r"(?iU)\bbearer\s+[A-Za-z0-9._\-]{16,}"),
    ),
    "secrets_wide": (  # an addition of this library
        ("named_token", r"""(?iU)\b(?:token|api_key|apikey|secret)["']?\s*[:=]\s*["']?[A-Za-z0-9._\-]{8,}"""),
    ),
    "placeholders": (
        ("placeholder", r"(?iU)\b(?:placeholder|marcador de posici[oó]n|por ahora se deja|se completar[ií]a)\b"),
    ),
    "lone_where": (("where_noop", r"(?isU)\bwhere\s+1\s*=\s*1\b(?!.*?\b(?:and|or)\b)"),),
}
# Starts of an absolute path in a quoted text (drive, network share, unix).
ABSOLUTE_PATH = r"^(?:[A-Za-z]:[\\/]|\\{1,2}(?U:[\w.$-]+)\\|/(?U:(?:[\w.-]+/)+[\w.-]+))"
LITERAL = r""""([^"\n]*)"|'([^'\n]*)'"""


def _pairs(text: Column, pattern: str) -> Column:
    """Array of (libref, table) structs from the two groups of ``pattern``."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)),
        lambda a, b: F.struct(F.upper(a).alias("libref"), F.upper(b).alias("table")),
    )


# --- counts ----------------------------------------------------------------------------------

def count_by(df: DataFrame, col: str, domain: Sequence[str] | None = None) -> DataFrame:
    """Rows per value -> (value, n); with ``domain`` values that do not occur count 0."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if domain is None:
        return counts
    wanted = df.sparkSession.createDataFrame([(d,) for d in domain], "value STRING")
    return wanted.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distinct_ratio(df: DataFrame, col: str, threshold: float = 0.5) -> DataFrame:
    """Boilerplate check over non-blank texts: distinct / total below ``threshold`` fails."""
    said = df.select(F.trim(col).alias("_t")).filter("_t <> ''")
    digest = F.count_distinct(F.xxhash64("_t"), F.xxhash64(F.lit(1), "_t"))  # 128 bits move, not the texts
    return said.agg(F.count(F.lit(1)).alias("total"), digest.alias("distinct_texts")).withColumn(
        "passed", F.coalesce(F.col("distinct_texts") / F.nullif("total", F.lit(0)) >= threshold, F.lit(True))
    )


def term_fan_in(
    df: DataFrame, term: str, id: str = "id", min_ids: int = 1, top: int | None = None, max_ids: int = MAX_IDS
) -> DataFrame:
    """Terms by the number of distinct ids they occur in -> (term, n_ids, ids).

    ``ids`` lists the first ``max_ids`` in order; ``top`` keeps the most frequent terms (ties by term).
    """
    pairs = df.select(F.col(term).alias("term"), F.col(id).alias("_id")).distinct()
    counts = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_ids")).filter(F.col("n_ids") >= min_ids)
    if top is not None:
        counts = counts.orderBy(F.desc("n_ids"), "term").limit(top)
    kept = pairs.join(counts.select("term"), "term", "left_semi")
    return counts.join(_first_ids(kept, ["term"], "_id", max_ids), "term", "left")


def term_members(df: DataFrame, term: str, id: str = "id", min_ids: int = 1) -> DataFrame:
    """Every (term, id) of terms that occur in at least ``min_ids`` ids: the uncut form of the lists."""
    pairs = df.select(F.col(term).alias("term"), F.col(id).alias("id")).distinct()
    often = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_ids)
    return pairs.join(often.select("term"), "term", "left_semi")


def _first_ids(pairs: DataFrame, by: Sequence[str], id: str, k: int, name: str = "ids") -> DataFrame:
    first = pick_rows(pairs.select(*by, id).distinct(), by, [id], k=k)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(id)).alias(name))


# --- libraries and tables --------------------------------------------------------------------

def librefs(programs: DataFrame, extra: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """Library declarations -> (id, libref, engine, is_db); path libraries have an empty engine."""
    engines = sorted({*DB_ENGINES, *[e.upper() for e in extra]} - {e.upper() for e in ignore})
    found = programs.select("id", F.inline(F.array_distinct(_pairs(F.upper("code"), LIBNAME))))
    return found.select("id", "libref", F.col("table").alias("engine"), F.col("table").isin(engines).alias("is_db"))


def project_db_libs(declared: DataFrame) -> DataFrame:
    return declared.filter("is_db").groupBy("libref").agg(F.max("engine").alias("engine"))


def _reference_array(code: Column) -> Column:
    upper = F.upper(code)
    aliases = F.array_except(
        F.regexp_extract_all(upper, F.lit(ALIAS), F.lit(1)), F.array(*[F.lit(k) for k in SQL_KEYWORDS])
    )
    return F.filter(
        F.array_distinct(_pairs(upper, QUALIFIED)),
        lambda r: (r["libref"] != "WORK")
        & ~F.array_contains(aliases, r["libref"])
        & ~r["libref"].isin(*FILE_EXTENSIONS)
        & ~r["table"].isin(*FILE_EXTENSIONS)
        & ~r["table"].rlike("^[0-9]+$"),
    )


def qualified_refs(programs: DataFrame) -> DataFrame:
    """``LIB.TABLE`` names -> (id, libref, table); WORK, SQL aliases, formats and file names left out.

    Aliases are those of the same program, so everything happens inside its row.
    """
    return programs.select("id", F.inline(_reference_array(F.col("code"))))


def _write_array(code: Column) -> Column:
    every = F.array_distinct(F.concat(_pairs(code, WRITES), _pairs(code, APPEND_WRITE)))
    return F.filter(every, lambda w: w["libref"] != "WORK")


def write_refs(programs: DataFrame) -> DataFrame:
    """Persistent tables a program writes -> (id, libref, table)."""
    return programs.select("id", F.inline(_write_array(F.col("code"))))


def table_programs(programs: DataFrame) -> DataFrame:
    """Every program of every table -> (id, libref, table, writes): what ``table_access`` counts and shortens."""
    refs = programs.select("id", _reference_array(F.col("code")).alias("_r"), _write_array(F.col("code")).alias("_w"))
    marked = F.transform("_r", lambda r: F.struct(r["libref"], r["table"], F.array_contains("_w", r).alias("writes")))
    return refs.select("id", F.inline(marked)).toDF("id", "libref", "table", "writes")


def table_access(programs: DataFrame, max_ids: int = MAX_IDS) -> DataFrame:
    """Access per table -> (libref, table, access, n_ids, ids).

    Written only: write; written and elsewhere read: both; else read. The verdict does not depend
    on the order in which programs are read. ``ids`` holds the first ``max_ids``; ``table_programs`` has all.
    """
    rows = table_programs(programs)
    access = rows.groupBy("libref", "table").agg(
        F.when(F.bool_or("writes") & F.bool_or(~F.col("writes")), "both")
        .when(F.bool_or("writes"), "write")
        .otherwise("read")
        .alias("access"),
        F.count(F.lit(1)).alias("n_ids"),
    )
    return access.join(_first_ids(rows, ["libref", "table"], "id", max_ids), ["libref", "table"])


def db_evidence(programs: DataFrame, inventory: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Evidence per library -> (libref, source, engine_hint, n_ids, n_tables, writes, unverified).

    ``source``: libname_statement, else flow_summary_library (``inventory(libref)``), else
    qualified_reference. Undeclared with at most two programs is unverified.
    """
    rows = table_programs(programs)
    # each reference counts for its program and for its table, so that the texts are read only once for both
    both = F.array(
        F.struct(F.lit(True).alias("_of_id"), F.col("id").alias("_id"), F.lit(None).cast("string").alias("_table"), "writes"),
        F.struct(F.lit(False).alias("_of_id"), F.lit(None).cast(rows.schema["id"].dataType).alias("_id"), F.col("table").alias("_table"), "writes"),
    )
    once = rows.select("libref", F.inline(both)).groupBy("libref", "_of_id", "_id", "_table").agg(F.bool_or("writes").alias("writes"))
    per_lib = once.groupBy("libref").agg(
        F.count_if("_of_id").alias("n_ids"), F.bool_or("writes").alias("writes"), F.count_if(~F.col("_of_id")).alias("n_tables")
    )
    engines = project_db_libs(declared if declared is not None else librefs(programs))
    known = (
        inventory.select(F.upper("libref").alias("libref")).distinct()
        if inventory is not None
        else programs.sparkSession.createDataFrame([], "libref STRING")
    ).withColumn("_listed", F.lit(True))
    out = per_lib.join(engines, "libref", "left").join(known, "libref", "left")
    source = (
        F.when(F.col("engine").isNotNull(), "libname_statement")
        .when(F.col("_listed").isNotNull(), "flow_summary_library")
        .otherwise("qualified_reference")
    )
    return out.select(
        "libref",
        source.alias("source"),
        F.coalesce("engine", F.lit("")).alias("engine_hint"),
        "n_ids",
        "n_tables",
        "writes",
        ((source == "qualified_reference") & (F.col("n_ids") <= 2)).alias("unverified"),
    )


def open_causes(evidence: DataFrame) -> DataFrame:
    """Libraries to confirm -> (prefix, source, n_ids, n_tables, writes), declared ones left out."""
    return evidence.filter("source <> 'libname_statement'").select(
        F.col("libref").alias("prefix"),
        F.when(F.col("unverified"), "unverified").otherwise(F.col("source")).alias("source"),
        "n_ids",
        "n_tables",
        (F.col("writes") & ~F.col("unverified")).alias("writes"),
    )


# --- classification --------------------------------------------------------------------------

def classify_code(code: Column | str) -> Column:
    """Type of a program by its leading construct (eleven types)."""
    c = F.col(code) if isinstance(code, str) else code
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"(?s)/\*.*?\*/", ""), r"\*[^;]*;", "")
    text = F.upper(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))
    lead = (
        (r"PROC\s+SQL\b", "PROC_SQL"), (r"PROC\s+SORT\b", "PROC_SORT"), (r"PROC\s+FREQ\b", "PROC_FREQ"),
        (r"PROC\s+MEANS\b", "PROC_MEANS"), (r"PROC\s+TRANSPOSE\b", "PROC_TRANSPOSE"), (r"PROC\s+EXPORT\b", "EXPORT"),
        (r"PROC\s+IMPORT\b", "IMPORT"), (r"PROC\s+", "PROC_OTHER"), (r"DATA\s+", "DATA_STEP"), (r"%MACRO\b", "MACRO"),
    )
    anywhere = (
        (r"\bPROC\s+SQL\b", "PROC_SQL"), (r"\bPROC\s+IMPORT\b", "IMPORT"), (r"\bDATA\s+\w", "DATA_STEP"),
        (r"\bPROC\s+", "PROC_OTHER"),
    )
    rules = [(rf"(?U)^{p}", n) for p, n in lead] + [(rf"(?U){p}", n) for p, n in anywhere]
    (first, name), *rest = rules
    chain = F.when(text.rlike(first), name)
    for pattern, name in rest:
        chain = chain.when(text.rlike(pattern), name)
    return chain.otherwise("OTHER")


def constructs(code: Column | str) -> Column:
    """All constructs of a program in order of first appearance, as an array."""
    c = F.col(code) if isinstance(code, str) else code
    bare = F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"(?s)/\*.*?\*/", "")
    hits = F.regexp_extract_all(bare, F.lit(r"(?imU)^\s*(PROC\s+\w+|DATA\s+\w|%MACRO\b)"), F.lit(1))
    names = F.transform(
        F.transform(hits, lambda h: F.upper(h)),
        lambda h: F.when(h.startswith("PROC"), F.regexp_replace(h, r"(?U)\s+", " ")).when(h.startswith("DATA"), "DATA").otherwise("%MACRO"),
    )
    return F.array_distinct(names)


def classify_step(programs: DataFrame) -> DataFrame:
    """+ classification: extract, load, macro, transform, validate or utility."""
    code, label, kind = F.upper("code"), F.upper(F.coalesce("label", F.lit(""))), F.col("node_type")

    def named(words: Sequence[str]) -> Column:
        return label.rlike("|".join(words))

    cls = (
        F.when((kind == "IMPORT") | code.contains("PROC IMPORT"), "extract")
        .when((kind == "EXPORT") | code.contains("PROC EXPORT"), "load")
        .when((kind == "MACRO") | code.contains("%MACRO"), "macro")
        .when(kind == "QUERY", "transform")
        .when(named(("CHECK", "VERIF", "VALID", "TEST")), "validate")
        .when(named(("SALIDA", "OUTPUT", "CARGA", "LOAD", "WRITE")), "load")
        .when(kind.isin("DATA_STEP", "PROC_SQL", "PROC_SORT", "PROC_MEANS", "PROC_FREQ", "PROC_TRANSPOSE"), "transform")
        .otherwise("utility")
    )
    return programs.withColumn("classification", cls)


def complexity(programs: DataFrame) -> DataFrame:
    """+ (score, complexity) from inputs, outputs, length, joins, cases and parameters."""
    code = F.col("code")
    n_in, n_out = F.coalesce(F.size("inputs"), F.lit(0)), F.coalesce(F.size("outputs"), F.lit(0))
    joins = F.regexp_count(code, F.lit(r"(?iU)\bJOIN\b"))
    cases = F.regexp_count(code, F.lit(r"(?iU)\bCASE\b"))

    def steps(value: Column, *edges: tuple[int, int]) -> Column:
        chain = F.lit(0)
        for above, points in sorted(edges):
            chain = F.when(value > above, points).otherwise(chain)
        return chain

    score = (
        steps(n_in, (5, 2), (2, 1))
        + steps(n_out, (3, 1))
        + steps(F.length(code), (3000, 2), (1000, 1))
        + steps(joins, (3, 2), (1, 1))
        + steps(cases, (3, 1))
        + F.when(code.rlike(r"(?U)&\w+"), 1).otherwise(0)
    )
    level = F.when(F.col("score") >= 5, "high").when(F.col("score") >= 2, "medium").otherwise("low")
    return programs.withColumn("score", score.cast("long")).withColumn("complexity", level)


def priority(programs: DataFrame, edges: DataFrame) -> DataFrame:
    """+ migration_priority from sinks, database dependence and complexity.

    ``programs`` carries classification, complexity, inputs, outputs, label.
    """
    busy = edges.select(F.col("source").alias("id")).filter("id IS NOT NULL").distinct().withColumn("_busy", F.lit(True))

    def persistent(names: str) -> Column:
        return F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.contains(".") & ~F.upper(x).startswith("WORK."))

    has_db = (F.size(_reference_array(F.col("code"))) > 0) | persistent("inputs")
    writes = persistent("outputs") | F.col("code").rlike(r"(?iU)\b(CREATE\s+TABLE|INSERT\s+INTO|APPEND\s+BASE=)\s*[A-Z][A-Z0-9_]*\.")
    label = F.upper(F.coalesce("label", F.lit("")))
    setup = label.contains("AUTOEXEC")
    rows = programs.join(busy, "id", "left")
    final = F.col("_busy").isNull() | writes | (F.col("classification") == "load")
    high = F.col("complexity") == "high"
    level = (
        F.when(setup | (final & high), "critical")
        .when(final | (high & has_db), "high")
        .when((F.col("complexity") == "medium") | has_db, "medium")
        .otherwise("low")
    )
    return rows.withColumn("migration_priority", level).drop("_busy")


# --- rules and repetition --------------------------------------------------------------------

def _first_hit(code: Column, pattern: str) -> tuple[Column, Column]:
    """(is there a hit, its surroundings: 30 characters on both sides, one line, at most 120)."""
    at = F.regexp_instr(code, F.lit(pattern))
    size = F.length(F.regexp_extract(code, pattern, 0))
    begin = F.greatest(at - 31, F.lit(0))
    text = F.substring(code, begin + 1, at - 1 + size + 30 - begin)
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n", " ")
    return at > 0, F.substring(text, 1, 120)


def scan_rules(programs: DataFrame, rules: Sequence[tuple[str, str, str, str]] = SMELL_RULES, min_ids: int = 3) -> DataFrame:
    """Findings -> (smell_id, id, rule, severity, category, line_hint).

    First hit per rule and program, then the numbers repeated in ``min_ids`` programs and the
    parameters a program uses. Ids run in (id, rule) order.
    """
    found = []
    for n, (rule, severity, category, pattern) in enumerate(rules):
        hit, hint = _first_hit(F.col("code"), pattern)
        found.append(
            F.when(
                hit,
                F.struct(
                    F.lit(n).alias("_n"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                    F.lit(category).alias("category"), hint.alias("line_hint"),
                ),
            )
        )
    params = F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(PARAMETER), F.lit(1))))
    found.append(
        F.when(
            F.size(params) > 0,
            F.struct(
                F.lit(len(rules) + 1).alias("_n"), F.lit("macro_variables").alias("rule"), F.lit("warning").alias("severity"),
                F.lit("reproducibility").alias("category"), F.concat(F.lit("&"), F.get(params, F.lit(0))).alias("line_hint"),
            ),
        )
    )
    rows = programs.select("id", F.inline(F.array_compact(F.array(*found))))
    magic = number_literals(programs)
    common = magic.groupBy("number").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= min_ids).select("number")
    numbers = magic.join(common, "number", "left_semi").groupBy("id").agg(F.min("number").alias("line_hint"))
    rows = rows.unionByName(
        numbers.select(
            "id", F.lit(len(rules)).alias("_n"), F.lit("magic_numbers").alias("rule"), F.lit("warning").alias("severity"),
            F.lit("maintainability").alias("category"), "line_hint",
        )
    )
    numbered = row_counter(rows, ["id", "_n"], name="_k")
    key = F.col("_k").cast("string")
    smell = F.concat(F.lit("CS-"), F.when(F.length(key) >= 4, key).otherwise(F.lpad(key, 4, "0")))
    return numbered.select(smell.alias("smell_id"), "id", "rule", "severity", "category", "line_hint")


def found_categories(
    programs: DataFrame, rules: Sequence[tuple[str, str, str, str]] = SMELL_RULES, min_ids: int = 3
) -> DataFrame:
    """Distinct categories of the findings of ``scan_rules`` -> (category).

    One aggregate over the texts and one over their numbers: no finding is shown, numbered or sorted.
    """
    tests: dict[str, list[Column]] = {"reproducibility": [F.col("code").rlike(PARAMETER)]}
    for _, _, category, pattern in rules:
        tests.setdefault(category, []).append(F.col("code").rlike(pattern))
    found = programs.agg(*[F.bool_or(reduce(lambda a, b: a | b, t)).alias(c) for c, t in tests.items()])
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in tests]))
    common = number_literals(programs).groupBy("number").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= min_ids)
    magic = common.limit(1).select(F.lit("maintainability").alias("category"))
    return found.select(F.explode(names).alias("category")).unionByName(magic).distinct()


def scan_cartesian(df: DataFrame, text: str = "code", id: str = "id") -> DataFrame:
    """Comma joins -> (id, hint)."""
    hit, hint = _first_hit(F.col(text), SMELL_RULES[2][3])
    return df.filter(hit).select(id, hint.alias("hint"))


def number_literals(df: DataFrame, text: str = "code", id: str = "id") -> DataFrame:
    """Distinct numbers of three digits or more per text, year- and date-like ones left out."""
    numbers = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(NUMBER_LITERAL), F.lit(1)))
    kept = F.filter(numbers, lambda n: ~(n.rlike("^(19|20)") & F.length(n).isin(4, 8)))
    return df.select(F.col(id).alias("id"), F.explode(kept).alias("number"))


def repeated_numbers(df: DataFrame, min_ids: int = 3, text: str = "code", id: str = "id", top: int | None = None) -> DataFrame:
    return term_fan_in(number_literals(df, text, id), "number", "id", min_ids, top)


def duplicate_blocks(
    df: DataFrame, min_len: int = 60, min_ids: int = 3, top: int | None = None, text: str = "code", id: str = "id", sep: str = ";"
) -> DataFrame:
    """Statements (pieces between ``sep``) whose normal form repeats -> (term, n_ids, ids, fragment).

    The whole normal form is compared; only the shown fragment is cut to 200 characters.
    """
    parts = F.filter(F.transform(F.split(F.col(text), sep), norm_block), lambda p: F.length(p) >= min_len)
    rows = df.select(F.col(id).alias("id"), F.explode(F.array_distinct(parts)).alias("piece"))
    out = term_fan_in(rows, "piece", "id", min_ids, top)
    return out.withColumn("fragment", F.substring("term", 1, 200))


def repeated_exprs(df: DataFrame, min_ids: int = 5, top: int | None = None, text: str = "code", id: str = "id") -> DataFrame:
    """Repeated CASE expressions and products -> (term, n_ids, ids)."""
    c = F.col(text)
    every = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (CASE_EXPR, PRODUCT_EXPR)])
    rows = df.select(F.col(id).alias("id"), F.explode(F.array_distinct(F.transform(every, norm_block))).alias("expr"))
    return term_fan_in(rows, "expr", "id", min_ids, top)


def param_usage(df: DataFrame, top: int | None = None, text: str = "code", id: str = "id") -> DataFrame:
    """Parameters ``&x`` by the number of programs that use them -> (term, n_ids, ids)."""
    names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PARAMETER), F.lit(1)))
    return term_fan_in(df.select(F.col(id).alias("id"), F.explode(names).alias("var")), "var", "id", 1, top)


# --- HTTP ------------------------------------------------------------------------------------

# Where a program names a URL, a method, a mechanism.
URL_ARGUMENT = r"""(?iU)\burl\s*=?\s*(["'])(.+?)\1"""
METHOD_ARGUMENT = r"""(?iU)\bmethod\s*=\s*(["']?)(\w+)\1"""
PROC_HTTP = r"(?iU)\bPROC\s+HTTP\b"
FILENAME_URL = r"(?iU)\bFILENAME\s+\w+\s+URL\b"


def http_calls(programs: DataFrame) -> DataFrame:
    """URLs in program texts -> (id, url, host); an empty host means parameters build the URL."""
    urls = F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(URL_ARGUMENT), F.lit(2)), lambda u: F.trim(u)))
    return programs.select("id", F.explode(urls).alias("url")).withColumn("host", url_host("url"))


def http_evidence(programs: DataFrame, max_ids: int = MAX_IDS, samples: int = 3) -> DataFrame:
    """Evidence per host -> (host, n_ids, ids, methods, sources, sample_urls); host '' = dynamic URLs.

    ``ids`` holds the first ``max_ids``; ``http_calls`` has all of them.
    """
    urls = F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(URL_ARGUMENT), F.lit(2)), lambda u: F.trim(u)))
    methods = F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(METHOD_ARGUMENT), F.lit(2)), lambda m: F.upper(m)))
    sources = F.array_compact(
        F.array(F.when(F.col("code").rlike(PROC_HTTP), "proc_http"), F.when(F.col("code").rlike(FILENAME_URL), "filename_url"))
    )
    calls = programs.select("id", methods.alias("_m"), sources.alias("_s"), F.explode(urls).alias("url")).withColumn("host", url_host("url"))

    per_id = calls.groupBy("host", "id").agg(F.first("_m").alias("_m"), F.first("_s").alias("_s"))
    named = {n: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(n) for c, n in (("_m", "methods"), ("_s", "sources"))}
    out = per_id.groupBy("host").agg(F.count(F.lit(1)).alias("n_ids"), *named.values())
    out = out.select("host", "n_ids", *[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in named])
    out = out.join(_first_ids(calls, ["host"], "id", max_ids), "host", "left")
    return out.join(_first_ids(calls, ["host"], "url", samples, "sample_urls"), "host", "left").select(
        "host", "n_ids", "ids", "methods", "sources", "sample_urls"
    )


# --- features, coverage, packs ---------------------------------------------------------------

def features(df: DataFrame, rules: Mapping[str, str], text: str = "code", id: str = "id") -> DataFrame:
    """One boolean column per feature rule."""
    return df.select(F.col(id).alias("id"), *[F.coalesce(F.col(text).rlike(p), F.lit(False)).alias(n) for n, p in rules.items()])


def name_coverage(
    expected: DataFrame, texts: DataFrame, id: str = "id", name: str = "name", text: str = "text",
    min_names: int = 5, min_share: float = 0.70, listed: int | None = None,
) -> DataFrame:
    """Share of expected names that occur as whole identifiers in the texts of their id.

    -> (id, n_names, n_found, coverage, passed, missing). The gate speaks from ``min_names`` names
    on. ``missing`` holds all names that were not found, or the first ``listed``.
    """
    names = expected.select(F.col(id).alias("id"), base_name(name).alias("_name")).filter("_name <> ''")
    # the names one id expects, met inside the row by the words of each of its texts: no word leaves its row
    wanted = names.groupBy("id").agg(F.sort_array(F.collect_set("_name")).alias("_names"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), F.lit(0)))
    said = texts.select(F.col(id).alias("_id"), words.alias("_words"))
    met = said.join(wanted, F.col("_id") == F.col("id")).select("id", F.array_intersect("_names", "_words").alias("_met"))
    # a name that many texts of an id hold folds map-side; the set is no longer than the id's names
    found = met.select("id", F.explode("_met").alias("_one")).groupBy("id").agg(F.collect_set("_one").alias("_found"))
    both = wanted.join(found, "id", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    lacking = F.array_except("_names", "_found")
    both = both.select("id", F.size("_names").cast("long").alias("n_names"), F.size("_found").cast("long").alias("n_found"), lacking.alias("_lacking"))
    share = F.col("n_found") / F.col("n_names")
    return both.select(
        "id",
        "n_names",
        "n_found",
        share.alias("coverage"),
        ((F.col("n_names") < min_names) | (share >= min_share)).alias("passed"),
        (F.col("_lacking") if listed is None else F.slice("_lacking", 1, listed)).alias("missing"),
    )


def scan_pack(df: DataFrame, text: str, pack: str | Sequence[tuple[str, str]], id: str = "id", cut: int = 30) -> DataFrame:
    """Every hit of a rule pack in a text column -> (id, rule, hit, number, length).

    ``hit`` shows the first ``cut`` characters; ``number`` counts a rule's hits in the text and ``length`` is
    the whole hit's, so that hits that look alike stay apart.
    """
    rules = RULE_PACKS[pack] if isinstance(pack, str) else pack

    def hits(rule: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
            lambda h, i: F.struct(F.lit(rule).alias("rule"), F.substring(h, 1, cut).alias("hit"), i.alias("number"), F.length(h).alias("length")),
        )

    found = [hits(rule, pattern) for rule, pattern in rules]
    return df.select(F.col(id).alias("id"), F.inline(reduce(lambda a, b: F.concat(a, b), found)))


def absolute_paths(df: DataFrame, text: str, id: str = "id") -> DataFrame:
    """Quoted texts that start like an absolute path; anything with ``://`` is not a disk path."""
    c = F.col(text)
    literals = F.concat(*[F.regexp_extract_all(c, F.lit(LITERAL), F.lit(g)) for g in (1, 2)])
    paths = F.filter(literals, lambda p: p.rlike(ABSOLUTE_PATH) & ~p.contains("://"))
    return df.select(F.col(id).alias("id"), F.explode(F.array_distinct(paths)).alias("path"))


def longest_programs(programs: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` programs with most lines -> (id, loc)."""
    loc = (F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return programs.select("id", loc.alias("loc")).orderBy(F.desc("loc"), "id").limit(k)
