"""Queries over program texts, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.plans import corpus as C
from tablesteps.plans import programs as P
from tablesteps.plans.lineage import program_io
from tablesteps.queries.base import query
from tablesteps.session import stage

# Statement cut in SQL: comments out, ';' in strings kept, comment statements dropped.
_STMTS = r"""toks AS (SELECT id, regexp_extract_all(code, '"[^"]*"?|''[^'']*''?|/\*(?s:.*?)(?:\*/|\z)|;|[^;"''/]+|/', 0) AS t FROM programs),
 joined AS (SELECT id, array_to_string(list_transform(t, lambda x: CASE WHEN x = ';' THEN chr(1) WHEN starts_with(x, '/*') THEN ' ' ELSE x END), '') AS s FROM toks),
 parts AS (SELECT id, list_filter(list_transform(string_split(s, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^%?\*')) AS p FROM joined),
 stmts AS (SELECT id, unnest(range(len(p))) AS pos, unnest(p) AS stmt FROM parts)"""


@query("c1_statements", f"WITH {_STMTS} SELECT id, CAST(pos AS INT) AS pos, stmt FROM stmts", uses=("programs",))
def _(t):
    return P.statements(t.programs)


@query(
    "c1_statements_documents",
    "WITH "
    + _STMTS.replace("SELECT id, regexp_extract_all(code", "SELECT doc_id AS id, regexp_extract_all(text").replace("FROM programs", "FROM documents")
    + " SELECT id AS doc_id, count(*) AS n_statements FROM stmts GROUP BY 1",
)
def _(t):
    return P.statements(t.documents, keys=["doc_id"], code="text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_statements"))


# What each of the eight program families refers to, spelled out.
_REFS = """SELECT id, direction, libref, "table", kind, pos FROM (
 SELECT id, o, unnest(CASE o % 8
 WHEN 0 THEN [('out', 'WORK', 'T' || o, 'data', 1), ('in', 'GG', 'BASE', 'set', 2)]
 WHEN 1 THEN [('out', 'GG', 'R' || (o % 50), 'sql_create', 1), ('in', 'WORK', 'T' || (o - 1), 'sql_from', 1), ('in', 'GG', 'SUCURSALES', 'sql_join', 1)]
 WHEN 2 THEN [('in', 'GG', 'R' || ((o - 1) % 50), 'proc_sort_data', 0), ('out', 'WORK', 'S' || o, 'proc_sort_out', 0)]
 WHEN 3 THEN [('out', 'WORK', 'U' || o, 'data', 0), ('in', 'WORK', 'S' || (o - 1), 'set', 1)]
 WHEN 4 THEN [('in', 'WORK', 'U' || (o - 1), 'proc_export_data', 0)]
 WHEN 5 THEN [('out', 'GG', 'HIST', 'append_base', 1), ('in', 'WORK', 'DELTA', 'append_data', 1)]
 WHEN 6 THEN [('out', 'WORK', 'RESP', 'proc_http_out', 1)]
 ELSE [('in', 'WORK', 'A', 'sql_from', 1), ('out', 'WORK', 'OUT1', 'data', 3), ('in', 'GG', 'BASE', 'set', 4)] END) AS r
 FROM (SELECT id, pos AS o FROM programs)) AS x, LATERAL (SELECT r[1] AS direction, r[2] AS libref, r[3] AS "table", r[4] AS kind, CAST(r[5] AS INT) AS pos)"""


@query("c2_dataset_refs", _REFS, uses=("programs",))
def _(t):
    return P.dataset_refs(t.programs).select("id", "direction", "libref", "table", "kind", "pos")


@query(
    "c2_file_refs",
    "SELECT id, 'write' AS mode, 'C:/out/u;v.csv' AS path, CAST(0 AS INT) AS pos FROM programs WHERE pos % 8 = 4",
    uses=("programs",),
)
def _(t):
    return P.file_refs(t.programs)


@query(
    "c2_passthrough",
    """SELECT id, CAST(1 AS INT) AS pos, 'DW' AS alias FROM programs UNION ALL SELECT id, 2, '' FROM programs WHERE pos % 2 = 0""",
    uses=("programs",),
)
def _(t):
    wrapped = t.programs.withColumn(
        "code", F.concat(F.lit("PROC SQL; CONNECT TO ODBC AS DW (DSN=X); "), F.when(F.col("pos") % 2 == 0, F.lit("EXECUTE (DROP TABLE T) BY DW; ")).otherwise(F.lit("")), F.lit("QUIT; "), "code")
    )
    return P.passthrough(wrapped)


@query(
    "c3_blocks",
    r"""WITH m AS (SELECT id, code, pos % 8 AS f FROM programs)
SELECT id, CAST(0 AS INT) AS block, CAST(0 AS INT) AS "offset", CASE f WHEN 0 THEN 'preambulo' WHEN 1 THEN 'proc sql' WHEN 2 THEN 'proc sort' WHEN 3 THEN 'data'
 WHEN 4 THEN 'proc export' WHEN 5 THEN 'proc datasets' WHEN 6 THEN 'preambulo' ELSE 'proc sql' END AS kind,
 CASE WHEN f IN (0, 7) THEN substr(code, 1, strpos(code, chr(10) || 'DATA')) ELSE code END AS code FROM m
UNION ALL SELECT id, 1, CAST(strpos(code, chr(10) || 'DATA') AS INT), 'data', substr(code, strpos(code, chr(10) || 'DATA') + 1) FROM m WHERE f IN (0, 7)""",
    uses=("programs",),
)
def _(t):
    return P.blocks(t.programs)


_LIB = r"""regexp_extract_all(upper(code), '\bLIBNAME\s+([A-Z][A-Z0-9_]{0,7})\s+(\w+)?', """


@query(
    "c4_librefs",
    f"""SELECT DISTINCT id, libref, engine, engine = 'ODBC' AS is_db FROM (SELECT id, unnest({_LIB}1)) AS libref, unnest({_LIB}2)) AS engine FROM programs)""",
    uses=("programs",),
)
def _(t):
    return C.librefs(t.programs, extra=("custom",), ignore=("spark",))


@query(
    "c4_project_libs",
    f"""SELECT libref, max(engine) AS engine FROM (SELECT unnest({_LIB}1)) AS libref, unnest({_LIB}2)) AS engine FROM programs) GROUP BY 1""",
    uses=("programs",),
)
def _(t):
    return C.project_db_libs(C.librefs(t.programs))


_QUAL = r"""al AS (SELECT id, upper(code) AS u, regexp_extract_all(upper(code), '\b(?:FROM|JOIN)\s+[\w.&]+\s+(?:AS\s+)?([A-Z][A-Z0-9_]{0,7})\b', 1) AS a FROM programs),
 rf AS (SELECT DISTINCT id, a, unnest(regexp_extract_all(u, '\b([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b', 1)) AS libref,
  unnest(regexp_extract_all(u, '\b([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b', 2)) AS "table" FROM al),
 kw AS (SELECT ['ON','WHERE','GROUP','ORDER','LEFT','RIGHT','INNER','OUTER','FULL','JOIN','AS','USING'] AS k, ['XLSX','XLS','CSV','TXT','PDF','HTML','SAS7BDAT'] AS e),
 q AS (SELECT id, libref, "table" FROM rf, kw WHERE libref <> 'WORK' AND NOT (list_contains(a, libref) AND NOT list_contains(k, libref))
  AND NOT list_contains(e, libref) AND NOT list_contains(e, "table") AND NOT regexp_matches("table", '^[0-9]+$'))"""
_WRIT = r"""w AS (SELECT DISTINCT id, upper(unnest(regexp_extract_all(code, '(?i)\b(?:CREATE\s+TABLE|INSERT\s+INTO|DELETE\s+FROM|UPDATE|APPEND\s+BASE\s*=|DATA)\s*([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b', 1))) AS libref,
 upper(unnest(regexp_extract_all(code, '(?i)\b(?:CREATE\s+TABLE|INSERT\s+INTO|DELETE\s+FROM|UPDATE|APPEND\s+BASE\s*=|DATA)\s*([A-Z][A-Z0-9_]{1,7})\.([A-Z0-9_]+)\b', 2))) AS "table" FROM programs)"""


@query("c5_qualified_refs", f"WITH {_QUAL} SELECT * FROM q", uses=("programs",))
def _(t):
    return C.qualified_refs(t.programs)


@query("c6_write_refs", f"""WITH {_WRIT} SELECT * FROM w WHERE libref <> 'WORK'""", uses=("programs",))
def _(t):
    return C.write_refs(t.programs)


_ACCESS = f"""WITH {_QUAL}, {_WRIT}, x AS (SELECT q.*, w.id IS NOT NULL AS writes FROM q LEFT JOIN w USING (id, libref, "table"))"""


@query(
    "c6_table_access",
    f"""{_ACCESS} SELECT libref, "table", CASE WHEN bool_or(writes) AND bool_or(NOT writes) THEN 'both' WHEN bool_or(writes) THEN 'write' ELSE 'read' END AS access,
 count(*) AS n_ids, array_to_string(list_slice(list(id ORDER BY id), 1, 20), ',') AS ids FROM x GROUP BY 1, 2""",
    uses=("programs",),
)
def _(t):
    return C.table_access(t.programs).withColumn("ids", F.array_join("ids", ","))


@query("c6_table_programs", f'''{_ACCESS} SELECT id, libref, "table", writes FROM x''', uses=("programs",))
def _(t):
    return C.table_programs(t.programs)


_EVID = f"""{_ACCESS}, e AS (SELECT libref, CASE WHEN libref = 'GG' THEN 'libname_statement' ELSE 'qualified_reference' END AS source,
 CASE WHEN libref = 'GG' THEN 'ODBC' ELSE '' END AS engine_hint, count(DISTINCT id) AS n_ids, count(DISTINCT "table") AS n_tables, bool_or(writes) AS writes,
 libref <> 'GG' AND count(DISTINCT id) <= 2 AS unverified FROM x GROUP BY 1)"""


@query("c7_db_evidence", f"{_EVID} SELECT * FROM e", uses=("programs",))
def _(t):
    return C.db_evidence(t.programs)


@query(
    "c7_open_causes",
    f"""{_EVID} SELECT libref AS prefix, CASE WHEN unverified THEN 'unverified' ELSE source END AS source, n_ids, n_tables, writes AND NOT unverified AS writes
FROM e WHERE source <> 'libname_statement'""",
    uses=("programs",),
)
def _(t):
    return C.open_causes(C.db_evidence(t.programs))


@query(
    "c9_classify_code",
    """SELECT id, CASE pos % 8 WHEN 0 THEN 'DATA_STEP' WHEN 1 THEN 'PROC_SQL' WHEN 2 THEN 'PROC_SORT' WHEN 3 THEN 'DATA_STEP' WHEN 4 THEN 'EXPORT'
 WHEN 5 THEN 'PROC_OTHER' WHEN 6 THEN 'PROC_OTHER' ELSE 'PROC_SQL' END AS type,
 CASE pos % 8 WHEN 0 THEN 'DATA' WHEN 1 THEN 'PROC SQL' WHEN 2 THEN 'PROC SORT' WHEN 3 THEN 'DATA' WHEN 4 THEN 'PROC EXPORT' WHEN 5 THEN 'PROC DATASETS'
 WHEN 6 THEN '' ELSE 'PROC SQL,DATA' END AS constructs FROM programs""",
    uses=("programs",),
)
def _(t):
    return t.programs.select("id", C.classify_code("code").alias("type"), F.array_join(C.constructs("code"), ",").alias("constructs"))


@query(
    "c10_classify_step",
    """SELECT id, CASE WHEN node_type = 'EXPORT' THEN 'load' WHEN node_type = 'QUERY' THEN 'transform' WHEN label LIKE 'Check%' THEN 'validate'
 WHEN label LIKE 'Carga%' THEN 'load' WHEN node_type IN ('DATA_STEP', 'PROC_SQL', 'PROC_SORT') THEN 'transform' ELSE 'utility' END AS classification FROM programs""",
    uses=("programs",),
)
def _(t):
    return C.classify_step(t.programs).select("id", "classification")


_CPLX = r"""n AS (SELECT id, code, node_type, label, pos, CASE WHEN pos % 8 IN (1, 7) THEN 2 WHEN pos % 8 = 6 THEN 0 ELSE 1 END AS n_in, length(code) AS len,
 len(regexp_extract_all(code, '(?i)\bJOIN\b')) AS joins, len(regexp_extract_all(code, '(?i)\bCASE\b')) AS cases FROM programs),
 s AS (SELECT *, CASE WHEN n_in > 5 THEN 2 WHEN n_in > 2 THEN 1 ELSE 0 END + CASE WHEN len > 3000 THEN 2 WHEN len > 1000 THEN 1 ELSE 0 END
 + CASE WHEN joins > 3 THEN 2 WHEN joins > 1 THEN 1 ELSE 0 END + CASE WHEN cases > 3 THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(code, '&\w+') THEN 1 ELSE 0 END AS score FROM n)"""


@query(
    "c11_complexity",
    f"WITH {_CPLX} SELECT id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM s",
    uses=("programs",),
)
def _(t):
    return C.complexity(program_io(t.programs)).select("id", "score", "complexity")


@query(
    "c12_priority",
    f"""WITH {_CPLX} SELECT id, CASE WHEN id NOT IN (SELECT source FROM edges) OR pos % 8 IN (1, 5) OR pos % 8 = 4
 OR (pos % 8 <> 7 AND label LIKE 'Carga%') THEN 'high' WHEN score >= 2 OR pos % 8 IN (0, 1, 2, 3, 5, 7) THEN 'medium' ELSE 'low' END AS migration_priority FROM s""",
    uses=("programs", "edges"),
)
def _(t):
    rows = C.complexity(C.classify_step(program_io(t.programs)))
    return C.priority(rows, t.edges).select("id", "migration_priority")


# Rules in RE2 form (no lookaround); the texts of the fixture need none of the excluded cases.
_RULES = [
    ("hardcoded_path", "error", "maintainability", r"""[A-Z]:[\\/][^\s"'']+|/sasdata/[^\s"'']+|\\\\[^\s"'']+"""),
    ("date_hardcoded", "warning", "reproducibility", r"\b(19|20)\d{2}[01]\d[0-3]\d\b|''[0-9]{4}-[0-9]{2}-[0-9]{2}''"),
    ("proc_sql_cartesian", "error", "performance", r"FROM\s+\w+\s*,\s*\w+"),
    ("credential_leak", "error", "security", r"""(password|passwd|pwd)\s*=\s*["'']?\S+"""),
    ("select_star", "info", "quality", r"SELECT\s+\*"),
    ("implicit_missing", "warning", "quality", r"\bIF\b[^;]+\bTHEN\s+\w+\s*=[^;]+;\s*"),
]


def _smell_sql():
    parts = []
    for i, (rule, sev, cat, pat) in enumerate(_RULES):
        parts.append(
            f"SELECT id, {i} AS n, '{rule}' AS rule, '{sev}' AS severity, '{cat}' AS category, code, regexp_extract(code, '(?is){pat}', 0) AS hit"
            f" FROM programs WHERE regexp_matches(code, '(?is){pat}')"
        )
    body = "\nUNION ALL ".join(parts)
    return rf"""WITH h AS ({body}),
 f AS (SELECT id, n, rule, severity, category, substr(replace(trim(substr(code, greatest(strpos(code, hit) - 31, 0) + 1,
  strpos(code, hit) - 1 + length(hit) + 30 - greatest(strpos(code, hit) - 31, 0)), ' ' || chr(10)), chr(10), ' '), 1, 120) AS line_hint FROM h),
 p AS (SELECT id, 8 AS n, 'macro_variables', 'warning', 'reproducibility', '&' || list_sort(regexp_extract_all(code, '&(\w+)', 1))[1] FROM programs WHERE regexp_matches(code, '&\w+')),
 d AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(code, '([^\w.])', '\1\1', 'g'), '(?:^|[^\w.])(\d{{3,}})(?:$|[^\w.])', 1)) AS num FROM programs),
 g AS (SELECT id, num FROM d WHERE NOT (regexp_matches(num, '^(19|20)') AND length(num) IN (4, 8))),
 c AS (SELECT num FROM g GROUP BY 1 HAVING count(*) >= 3),
 m AS (SELECT id, 7 AS n, 'magic_numbers', 'warning', 'maintainability', min(num) FROM g WHERE num IN (SELECT num FROM c) GROUP BY id),
 u AS (SELECT * FROM f UNION ALL SELECT * FROM p UNION ALL SELECT * FROM m)
SELECT 'CS-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS smell_id, id, rule, severity, category, line_hint
FROM (SELECT *, row_number() OVER (ORDER BY id, n) AS k FROM u)"""


@query("c13_scan_rules", _smell_sql(), uses=("programs",))
def _(t):
    return C.scan_rules(t.programs)


@query(
    "c13_severities",
    """SELECT * FROM (SELECT 'error' AS value, 3 * count(*) FILTER (pos % 8 = 7) + count(*) FILTER (pos % 8 = 4) AS n FROM programs
UNION ALL SELECT 'fatal', 0)""",
    uses=("programs",),
)
def _(t):
    rules = [r for r in C.SMELL_RULES if r[1] == "error"]
    return C.count_by(C.scan_rules(t.programs, rules, min_ids=10**9).filter("rule <> 'macro_variables'"), "severity", ["error", "fatal"])


@query(
    "j6_scan_cartesian",
    "SELECT id, replace(substr(code, 1, 57), chr(10), ' ') AS hint FROM (SELECT id, substr(code, 1, strpos(code, 'FROM A, B') + 8 + 30) AS code FROM programs WHERE contains(code, 'FROM A, B'))",
    uses=("programs",),
)
def _(t):
    out = C.scan_cartesian(t.programs)
    return out.withColumn("hint", F.substring("hint", 1, 57))


def _fan_in(source, min_ids, top, ids=True):
    limit = f"ORDER BY n_ids DESC, term LIMIT {top}" if top else ""
    listed = ", array_to_string(list_slice(list(id ORDER BY id), 1, 20), ',') AS ids" if ids else ""
    return f"""SELECT term, count(*) AS n_ids{listed} FROM (SELECT DISTINCT term, id FROM ({source})) GROUP BY 1 HAVING count(*) >= {min_ids} {limit}"""


_NUM = r"""WITH d AS (SELECT id, unnest(regexp_extract_all(regexp_replace({c}, '([^\pL\pM\pN_.])', '\1\1', 'g'), '(?:^|[^\pL\pM\pN_.])([0-9]{{3,}})(?:$|[^\pL\pM\pN_.])', 1)) AS term FROM {t})
"""


@query(
    "c14_repeated_numbers",
    _NUM.format(c="code", t="programs")
    + _fan_in("SELECT * FROM d WHERE NOT (regexp_matches(term, '^(19|20)') AND length(term) IN (4, 8))", 3, None),
    uses=("programs",),
)
def _(t):
    return C.repeated_numbers(t.programs, 3).withColumn("ids", F.array_join("ids", ","))


@query(
    "c14_numbers_documents",
    _NUM.format(c="text", t="(SELECT text, doc_id AS id FROM documents)")
    + _fan_in("SELECT * FROM d WHERE NOT (regexp_matches(term, '^(19|20)') AND length(term) IN (4, 8))", 3, None, False),
)
def _(t):
    return C.repeated_numbers(t.documents, 3, text="text", id="doc_id").select("term", "n_ids")


@query(
    "c15_duplicate_blocks",
    r"""WITH s AS (SELECT id, unnest(string_split(code, ';')) AS p FROM programs),
 n AS (SELECT id, upper(trim(regexp_replace(regexp_replace(p, '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))) AS term FROM s)
"""
    + _fan_in("SELECT * FROM n WHERE length(term) >= 40", 3, 25),
    uses=("programs",),
)
def _(t):
    return C.duplicate_blocks(t.programs, min_len=40, top=25).withColumn("ids", F.array_join("ids", ",")).drop("fragment")


@query(
    "c15_duplicate_lines",
    r"""WITH s AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS p FROM documents),
 n AS (SELECT id, trim(regexp_replace(regexp_replace(p, '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g')) AS term FROM s)
SELECT max(n) AS most, sum(n)::BIGINT AS memberships, count(*) AS lines FROM (SELECT upper(term), count(DISTINCT id) AS n FROM n WHERE length(term) >= 60 GROUP BY 1 HAVING n >= 3)""",
)
def _(t):
    out = C.duplicate_blocks(t.documents, 60, 3, None, text="text", id="doc_id", sep="\n")
    return out.agg(F.max("n_ids").alias("most"), F.sum("n_ids").alias("memberships"), F.count(F.lit(1)).alias("lines"))


@query(
    "c15_members",
    """SELECT node_type AS term, id FROM programs WHERE node_type IN (SELECT node_type FROM programs GROUP BY 1 HAVING count(DISTINCT id) >= 3)""",
    uses=("programs",),
)
def _(t):
    return C.term_members(t.programs, "node_type", "id", 3)


@query(
    "c16_repeated_exprs",
    r"""WITH s AS (SELECT id, unnest(regexp_extract_all(code, '(?is)CASE\s+WHEN\b.{10,200}?\bEND\b')) AS p FROM programs
 UNION ALL SELECT id, unnest(regexp_extract_all(code, '\b\w+\s*\*\s*\w+\s*/\s*\d+\b')) FROM programs),
 n AS (SELECT id, upper(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS term FROM s)
"""
    + _fan_in("SELECT * FROM n", 5, 25),
    uses=("programs",),
)
def _(t):
    return C.repeated_exprs(t.programs, top=25).withColumn("ids", F.array_join("ids", ","))


@query(
    "c17_param_usage",
    r"""WITH n AS (SELECT id, unnest(regexp_extract_all(code, '&(\w+)', 1)) AS term FROM programs)
"""
    + _fan_in("SELECT * FROM n", 1, 20),
    uses=("programs",),
)
def _(t):
    return C.param_usage(t.programs, top=20).withColumn("ids", F.array_join("ids", ","))


@query(
    "a9_term_fan_in",
    _fan_in("SELECT l_partkey AS term, l_orderkey AS id FROM lineitem", 5, 30),
)
def _(t):
    return C.term_fan_in(t.lineitem, "l_partkey", "l_orderkey", 5, 30).withColumn("ids", F.array_join("ids", ","))


@query("a10_count_by", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'X', 0")
def _(t):
    return C.count_by(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@query(
    "a12_distinct_ratio",
    """SELECT count(*) AS total, count(DISTINCT t) AS distinct_texts, count(DISTINCT t) / count(*) >= 0.5 AS passed
FROM (SELECT trim(text) AS t FROM conversations) WHERE t <> ''""",
)
def _(t):
    return C.distinct_ratio(t.conversations, "text")


_URLS = r"""u AS (SELECT DISTINCT id, trim(unnest(regexp_extract_all(code, '(?i)\burl\s*=?\s*"(.+?)"', 1))) AS url FROM programs),
 h AS (SELECT id, url, lower(split_part(split_part(regexp_extract(url, '(?i)^[a-z][a-z0-9+.\-]*://([^/\s?"'']+)', 1), '@', -1), ':', 1)) AS h FROM u),
 c AS (SELECT id, url, CASE WHEN regexp_matches(h, '[&%]') THEN '' ELSE h END AS host FROM h)"""


@query("c18_http_calls", f"WITH {_URLS} SELECT * FROM c", uses=("programs",))
def _(t):
    return C.http_calls(t.programs)


@query(
    "c18_http_evidence",
    f"""WITH {_URLS} SELECT host, count(DISTINCT id) AS n_ids, array_to_string(list_slice(list_sort(list_distinct(list(id))), 1, 20), ',') AS ids, 'GET' AS methods,
 'proc_http' AS sources, array_to_string(list_slice(list_sort(list_distinct(list(url))), 1, 3), ' ') AS sample_urls FROM c GROUP BY 1""",
    uses=("programs",),
)
def _(t):
    out = C.http_evidence(t.programs)
    return out.withColumns({"ids": F.array_join("ids", ","), "methods": F.array_join("methods", ","), "sources": F.array_join("sources", ","), "sample_urls": F.array_join("sample_urls", " ")})


def _feature_sql(rules, table, text, key):
    cols = ", ".join(f"regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') AS {n}" for n, p in rules.items())
    return f"SELECT {key} AS id, {cols} FROM {table}"


def _re2(rules):
    return {n: p.replace("(?iU)", "(?i)").replace("(?isU)", "(?is)").replace("(?U)", "") for n, p in rules.items()}


@query("c20_features_source", _feature_sql(_re2(C.SOURCE_FEATURES), "programs", "code", "id"), uses=("programs",))
def _(t):
    return C.features(t.programs, C.SOURCE_FEATURES)


@query("c20_features_target", _feature_sql(_re2(C.TARGET_FEATURES), "documents", "text", "doc_id"))
def _(t):
    return C.features(t.documents, C.TARGET_FEATURES, text="text", id="doc_id")


@query(
    "c21_name_coverage",
    r"""WITH e AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(b.text), '[a-z]+')) AS name FROM (SELECT text, CAST(regexp_extract(item_id::VARCHAR, '[0-9]+$') AS BIGINT) AS k FROM benchmark) b
 JOIN documents d ON b.k = d.doc_id % (SELECT count(*) FROM benchmark)), w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\pL\pM\pN_]+')) AS ws FROM documents),
 x AS (SELECT e.id, name, list_contains(ws, name) AS hit FROM e JOIN w USING (id))
SELECT id, count(*) AS n_names, count(*) FILTER (hit) AS n_found, round(count(*) FILTER (hit) / count(*), 6) AS coverage,
 count(*) < 5 OR count(*) FILTER (hit) / count(*) >= 0.7 AS passed, coalesce(array_to_string(list_slice(list(name ORDER BY name) FILTER (NOT hit), 1, 15), ','), '') AS missing FROM x GROUP BY 1""",
)
def _(t):
    b = t.benchmark.select("text", F.regexp_extract(F.col("item_id").cast("string"), "[0-9]+$", 0).cast("long").alias("k"))
    d = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % t.benchmark.count()).alias("k"))
    names = d.join(b, "k").select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    out = C.name_coverage(names, texts, listed=15)
    return out.withColumns({"coverage": F.round("coverage", 6), "missing": F.array_join("missing", ",")})


def _pack_sql(pack, table, text, key):
    parts = [
        f"SELECT {key} AS id, '{r}' AS rule, substr(unnest(regexp_extract_all({text}, '{p}')), 1, 30) AS hit FROM {table}"
        for r, p in ((r, p.replace("(?iU)", "(?i)").replace("'", "''")) for r, p in pack)
    ]
    return "\nUNION ALL ".join(parts)


@query("c22_secrets_wide", _pack_sql(C.RULE_PACKS["secrets_wide"], "documents", "text", "doc_id"))
def _(t):
    return C.scan_pack(t.documents, "text", "secrets_wide", id="doc_id").select("id", "rule", "hit")


@query(
    "c22_secrets",
    _pack_sql(C.RULE_PACKS["secrets"], "(SELECT id, replace(code, 'abc123', '''abc123''') AS code FROM programs)", "code", "id"),
    uses=("programs",),
)
def _(t):
    return C.scan_pack(t.programs.withColumn("code", F.replace("code", F.lit("abc123"), F.lit("'abc123'"))), "code", "secrets").select("id", "rule", "hit")


@query(
    "c22_placeholders",
    _pack_sql(C.RULE_PACKS["placeholders"], "(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Placeholder: por ahora se deja.' ELSE '' END AS text FROM documents)", "text", "doc_id"),
)
def _(t):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Placeholder: por ahora se deja.").otherwise(""))
    return C.scan_pack(t.documents.withColumn("text", text), "text", "placeholders", id="doc_id").select("id", "rule", "hit")


@query(
    "c22_lone_where",
    """SELECT o_orderkey AS id, 'where_noop' AS rule, 'WHERE 1 = 1' AS hit FROM orders WHERE o_orderkey % 6 = 0""",
)
def _(t):
    sql = F.when(F.col("o_orderkey") % 6 == 0, "SELECT * FROM T WHERE 1 = 1").otherwise("SELECT * FROM T WHERE 1=1 AND X > 2")
    return C.scan_pack(t.orders.select("o_orderkey", sql.alias("code")), "code", "lone_where", id="o_orderkey").select("id", "rule", "hit")


@query(
    "c22_absolute_paths",
    "SELECT id, 'C:/out/u;v.csv' AS path FROM programs WHERE pos % 8 = 4",
    uses=("programs",),
)
def _(t):
    return C.absolute_paths(t.programs, "code")


@query(
    "c25_pack_blocks",
    """SELECT id, CAST(0 AS INT) AS chunk, CASE WHEN length(code) > 130 AND pos % 8 = 7 THEN substr(code, 1, strpos(code, chr(10) || 'DATA')) ELSE code END AS text,
 length(code) > 130 AND pos % 8 <> 7 AS oversize FROM programs
UNION ALL SELECT id, 1, substr(code, strpos(code, chr(10) || 'DATA') + 1), length(code) - strpos(code, chr(10) || 'DATA') > 130 FROM programs WHERE pos % 8 = 7 AND length(code) > 130""",
    uses=("programs",),
)
def _(t):
    return P.pack_blocks(t.programs, 130)


# a run log per program: a note, the statements as source lines, a title
_LOG = """SELECT id AS log_id, pos AS n, code FROM programs"""


@query(
    "c26_from_run_logs",
    """SELECT id AS log_id, CAST(2 AS INT) AS block, 'PROC SQL;' || chr(10) || '  SELECT X FROM T' || pos || ';' || chr(10) || 'QUIT;' AS code FROM programs WHERE pos % 2 = 0""",
    uses=("programs",),
)
def _(t):
    lines = F.array(
        F.lit("n NOTE: start"),
        F.when(F.col("pos") % 2 == 0, "s  2    PROC SQL;").otherwise("s  2    %LET A = 1;"),
        F.concat(F.lit("s  3      SELECT X FROM T"), F.col("pos").cast("string"), F.lit(";")),
        F.lit("n NOTE: rows"),
        F.lit("s 12    QUIT; trailing"),
        F.lit("t Title"),
        F.lit("s 13    QUIT;"),
    )
    logs = t.programs.select(F.col("id").alias("log_id"), F.posexplode(lines).alias("line_no", "line"))
    out = P.from_run_logs(logs.withColumn("line_no", F.col("line_no") + 1))
    return out


@query(
    "c27_place",
    """SELECT id, CASE pos % 8 WHEN 3 THEN 'pandas' WHEN 4 THEN 'pandas' WHEN 6 THEN 'pandas' ELSE 'hybrid' END AS placement FROM programs""",
    uses=("programs",),
)
def _(t):
    return P.place(P.place_facts(t.programs), C.project_db_libs(C.librefs(t.programs))).select("id", "placement")


@query(
    "c27_place_blocks_sql_first",
    """SELECT id, CAST(0 AS INT) AS block, CASE pos % 8 WHEN 0 THEN 'utility' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'hybrid' ELSE 'sql_pushdown' END AS placement FROM programs
UNION ALL SELECT id, 1, CASE pos % 8 WHEN 0 THEN 'sql_pushdown' ELSE 'hybrid' END FROM programs WHERE pos % 8 IN (0, 7)""",
    uses=("programs",),
)
def _(t):
    libs = C.project_db_libs(C.librefs(t.programs))
    return P.place_blocks(t.programs, libs, sql_first=True).select("id", "block", "placement")


@query(
    "a13_rollup_verdict",
    """SELECT id, CASE pos % 8 WHEN 2 THEN 'hybrid' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'hybrid' WHEN 7 THEN 'hybrid' ELSE 'sql_pushdown' END AS placement FROM programs""",
    uses=("programs",),
)
def _(t):
    libs = C.project_db_libs(C.librefs(t.programs))
    return P.rollup_verdict(P.place_blocks(t.programs, libs, sql_first=True))


@query(
    "c27_rejudge",
    """SELECT id, CASE WHEN pos % 8 IN (0, 1, 2, 5, 7) THEN 'hybrid' END AS placement, 'library confirmed as database' AS reason FROM programs WHERE pos % 8 IN (0, 1, 2, 5, 7)""",
    uses=("programs",),
)
def _(t):
    bare = t.programs.withColumn("code", F.regexp_replace("code", "LIBNAME GG ODBC DSN=DWH;", ""))
    none = t.spark.createDataFrame([], "libref STRING")
    facts = stage(P.place_facts(bare), "facts")  # judged twice
    placed = P.place(facts, none)
    libs = C.qualified_refs(bare).select("libref").distinct()
    return P.rejudge(facts, placed, none, libs, none)


@query(
    "c28_step_logic",
    """SELECT id, pos % 8 <> 0 AS procedural, pos % 8 <> 7 AS sql_expressible, CASE pos % 8 WHEN 3 THEN 'RETAIN ACUM 0|IF FIRST.ID THEN ACUM = 0|ACUM + TOTAL'
 WHEN 7 THEN 'TOTAL = LAG(MONTO)' ELSE '' END AS evidence FROM programs WHERE pos % 8 IN (0, 3, 7)""",
    uses=("programs",),
)
def _(t):
    return P.step_logic(t.programs).withColumn("evidence", F.array_join("evidence", "|"))


@query(
    "o3_longest_programs",
    "SELECT doc_id AS id, length(text) - length(replace(text, chr(10), '')) + 1 AS loc FROM documents ORDER BY loc DESC, id LIMIT 15",
)
def _(t):
    return C.longest_programs(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("code")))
