"""Program texts to rows: statements, blocks, dataset references, step logic, execution place.

Input is ``programs(id, code, ...)``. A text is cut with regular expressions inside its own row (no
Python, no shuffle), and so is the state that runs along its statements (inside PROC SQL, inside a
DATA step). ``keys`` lets the same functions work per program or per
block. All patterns start with ``(?U)``: names like ``AÑO`` are words.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteps.operators.ordered import lag_n, pick_rows, retain_last
from tablesteps.session import stage

# Library engines that are databases.
DB_ENGINES = (
    "ODBC", "OLEDB", "JDBC", "ORACLE", "DB2", "TERADATA", "SQLSVR", "SYBASE", "SAPASE", "SAPIQ", "SAPHANA",
    "INFORMIX", "MYSQL", "POSTGRES", "NETEZZA", "GREENPLM", "VERTICA", "ASTER", "HAWQ", "YBRICK", "REDSHIFT",
    "SNOW", "BIGQUERY", "SPARK", "HADOOP", "IMPALA", "SINGLESTORE", "MONGO", "SFORCE", "SQLSRV", "MSSQL",
)

# Statement heads of a DATA step that are metadata, and heads that need row state.
DECLARATIVE_HEADS = ("by", "where", "format", "label", "keep", "drop", "rename", "length", "attrib")
PROCEDURAL_HEADS = (
    "retain", "array", "do", "end", "output", "link", "goto", "return", "abort", "stop", "delete", "input",
    "put", "infile", "file", "modify", "remove", "replace", "call",
)
PROCEDURAL_TOKENS = (
    r"(?iU)\b(?:lag|dif)\d*\s*\(|\b_n_\b|\b_i_\b|\bfirst\.|\blast\.|\b(?:end|point|nobs|curobs)\s*="
    r"|\b(?:output|delete|stop|abort|link|goto|return|call)\b"
)
SUM_STATEMENT = r"^[A-Za-z_](?U:\w)*(?:\[[^\]]*\])?\s*\+"
# Procedures whose result is a row order; words after FROM/JOIN that are no tables.
ORDER_PROCS = ("sort", "rank", "transpose", "expand", "timeseries")
SQL_STOPWORDS = ("connection", "select", "where", "on", "as", "dual")
DATA_FILE = r"""(?i)(?:"([^'"]*\.(?:sas7bdat|sas7bvew|sd2|sd7|xpt))"|'([^'"]*\.(?:sas7bdat|sas7bvew|sd2|sd7|xpt))')"""

_CUT = "\u0001"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_STRING = r""""[^"]*+"?|'[^']*+'?"""
_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_TOKEN = rf"""{_STRING}|{_COMMENT}|;|[^;"'/]++|/"""
_MASK_TOKEN = rf"""(?:\A|;)(?:\s++|/\*(?s:.*?)\*/)*+%?+\*[^;]*+|{_STRING}|{_COMMENT}|;|[^;"'/]++|/"""
_OPTIONS = r"\((?:[^()]++|\([^()]*+\))*+\)"
_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$"
_BLOCK_START = r"(?imU)^(?=[ \t]*(?:PROC|DATA)\b)"


def _clean(code: Column) -> Column:
    """Text without byte-order mark; the cut mark is kept out of the input."""
    text = F.coalesce(code, F.lit(""))
    return F.when(text.contains("\ufeff") | text.contains(_CUT), F.translate(text, f"\ufeff{_CUT}", "")).otherwise(text)


def _trimmed(texts: Column) -> Column:
    """Texts of an array without blanks at their ends; most begin and end with a plain letter or sign."""

    def plain(c: Column) -> Column:
        return F.ascii(c).between(33, 126)

    inked = F.transform(texts, lambda s: F.trim(s))
    return F.transform(inked, lambda s: F.when(plain(s) & plain(F.substring(s, -1, 1)), s).otherwise(F.btrim(s, F.lit(_BLANKS))))


def _pieces(code: Column) -> Column:
    """Statements of a text: comments out, ``;`` inside strings and comments ignored."""
    clean = _clean(code)
    tokens = F.regexp_extract_all(clean, F.lit(_TOKEN), F.lit(0))
    marked = F.transform(
        tokens, lambda t: F.when(t == ";", _CUT).when(F.startswith(t, F.lit("/*")), " ").otherwise(t)
    )
    # without strings and comments every ``;`` ends a statement
    hidden = code.contains('"') | code.contains("'") | code.contains("/*")
    parts = F.when(hidden, F.split(F.array_join(marked, ""), _CUT)).otherwise(F.split(clean, ";"))
    return F.filter(_trimmed(parts), lambda s: (s != "") & ~s.startswith("*") & ~s.startswith("%*"))


def statements(programs: DataFrame, keys: Sequence[str] = ("id",), code: str = "code") -> DataFrame:
    """Executable statements -> (keys..., pos, stmt).

    Block comments and ``*``/``%*`` statements are left out, doubled quotes stay, an unclosed
    comment drops the rest.
    """
    return programs.select(*keys, F.posexplode(_pieces(F.col(code))).alias("pos", "stmt"))


def _masked(code: Column) -> Column:
    """The text with comments and strings blanked, same length, line breaks kept."""

    def blank(t: Column) -> Column:
        return F.regexp_replace(t, r"[^\n]", " ")

    tokens = F.regexp_extract_all(code, F.lit(_MASK_TOKEN), F.lit(0))
    opening = r"^(?:\s|/\*(?s:.*?)\*/)*%?\*"  # a comment statement at the very start has no ``;`` before it
    shown = F.transform(
        tokens,
        lambda t, i: F.when(
            (F.length(t) > 1) & F.startswith(t, F.lit(";")),
            F.concat(F.lit(";"), blank(F.substring(t, F.lit(2), F.length(t)))),
        )
        .when(t.rlike(r"""^(?:["']|/\*)""") | ((i == 0) & t.rlike(opening)), blank(t))
        .otherwise(t),
    )
    return F.array_join(shown, "")


def _block_sizes(code: Column) -> Column:
    """Lengths of the texts between block starts (the part before the first start may be empty)."""
    marks = F.split(F.regexp_replace(_masked(code), _BLOCK_START, _CUT), _CUT)
    return F.transform(marks, lambda m: F.length(m))


def _running(sizes: Column) -> Column:
    """Offsets of consecutive pieces from their sizes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        sizes,
        start,
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )


def _sized(programs: DataFrame, code: str) -> DataFrame:
    base = programs.select("id", F.translate(F.coalesce(F.col(code), F.lit("")), _CUT, " ").alias("_code"))
    return base.withColumn("_sizes", _block_sizes(F.col("_code")))


def _words(text: Column) -> Column:
    quoted = text.contains('"') | text.contains("'")
    bare = F.when(quoted, F.regexp_replace(text, _STRING, " <str> ")).otherwise(text)
    return F.regexp_extract_all(bare, F.lit(r"(?U)<str>|[\w.&%]+"), F.lit(0))


def blocks(programs: DataFrame, code: str = "code") -> DataFrame:
    """Blocks cut at a PROC or DATA that starts a line -> (id, block, offset, kind, code).

    What comes before the first one is block 0 of kind ``preambulo``; blank parts are left out.
    """
    parts = F.zip_with(_running(F.col("_sizes")), "_sizes", lambda at, n: F.struct(at.alias("offset"), n.alias("size")))
    every = _sized(programs, code).select("id", "_code", parts.alias("_parts"))
    texts = F.transform(
        "_parts",
        lambda b: F.struct(
            b["offset"].alias("offset"), F.substring(F.col("_code"), b["offset"] + 1, b["size"]).alias("text")
        ),
    )
    kept = F.filter(texts, lambda b: F.btrim(b["text"], F.lit(_BLANKS)) != "")
    rows = every.select("id", F.posexplode(kept).alias("block", "_b")).select(
        "id", "block", F.col("_b.offset").alias("offset"), F.col("_b.text").alias("code")
    )
    words = rows.withColumn("_w", F.transform(_words(F.col("code")), lambda w: F.lower(w)))
    first, second = F.get("_w", F.lit(0)), F.get("_w", F.lit(1))
    kind = (
        F.when(first.isNull(), "vacio")
        .when(first == "proc", F.concat_ws(" ", F.lit("proc"), second))
        .when(first == "data", "data")
        .otherwise("preambulo")
    )
    return words.select("id", "block", "offset", kind.alias("kind"), "code")


def pack_blocks(programs: DataFrame, limit: int = 40_000, code: str = "code") -> DataFrame:
    """Greedy chunks of at most ``limit`` characters -> (id, chunk, text, oversize), never cut inside a block.

    A block above the limit is a chunk of its own with ``oversize`` true.
    """
    base = _sized(programs, code).withColumn("_sizes", F.filter("_sizes", lambda n: n > 0))
    text, sizes = F.col("_code"), F.col("_sizes")
    start = F.struct(F.lit(0).alias("filled"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, size: Column) -> Column:
        full = (state["filled"] > 0) & (state["filled"] + size > limit)
        return F.struct(
            F.when(full, size).otherwise(state["filled"] + size).alias("filled"),
            F.when(full, F.array_append(state["cuts"], state["filled"])).otherwise(state["cuts"]).alias("cuts"),
        )

    packed = F.aggregate(sizes, start, step, lambda s: F.array_append(s["cuts"], s["filled"]))
    whole = F.length(text) <= limit
    sized = base.select(
        "id",
        text.alias("_code"),
        F.when(F.length(text) == 0, F.array().cast("array<int>"))
        .when(whole, F.array(F.length(text)))
        .otherwise(packed)
        .alias("_sizes"),
    )
    parts = F.zip_with(_running(F.col("_sizes")), "_sizes", lambda at, n: F.struct(at.alias("at"), n.alias("n")))
    rows = sized.select("id", "_code", F.posexplode(parts).alias("chunk", "_c"))
    return rows.select("id", "chunk", F.substring(F.col("_code"), F.col("_c.at") + 1, F.col("_c.n")).alias("text"), (F.col("_c.n") > limit).alias("oversize"))


# --- statement facts -------------------------------------------------------------------------

_MARKS = "SPE"  # a PROC SQL, another PROC, RUN or QUIT; D is a DATA head


def _heads(pieces: Column) -> Column:
    """Per statement one letter: S (PROC SQL), P (other PROC), E (RUN/QUIT), D (DATA), ``-``."""
    two = r"""^(?U)[^\w.&%"']*([\w.&%]+)(?:[^\w.&%"']+([\w.&%]+|["']))?"""
    marks = r"""^(?iU)[^\w.&%"']*(?:proc|run|quit|data)(?![\w.&%])"""
    heads = F.transform(
        pieces,
        lambda s: F.when(
            s.rlike(marks), F.lower(F.concat_ws(" ", F.regexp_extract(s, two, 1), F.regexp_extract(s, two, 2)))
        ).otherwise(""),
    )
    letters = F.transform(
        heads,
        lambda h: F.when(h == "proc sql", "S")
        .when(h.startswith("proc ") & (h != "proc "), "P")
        .when(h.startswith("run ") | h.startswith("quit "), "E")
        .when(h.startswith("data "), "D")
        .otherwise("-"),
    )
    return F.array_join(letters, "")


def _states(pieces: Column) -> Column:
    """Per statement the state it runs in: ``s`` inside PROC SQL, ``d`` inside a DATA step, else other.

    The letters are cut before each mark; what follows S is SQL, what follows the first D of any
    other stretch is a DATA step. Linear in the text, and all in the row of the program.
    """

    def fill(part: Column) -> Column:
        at = F.when(part.startswith("S"), 1).otherwise(F.instr(part, "D"))
        state = F.when(part.startswith("S"), "s").otherwise("d")
        return F.when(at == 0, part).otherwise(
            F.concat(F.substring(part, F.lit(1), at), F.repeat(state, F.length(part) - at))
        )

    parts = F.split(_heads(pieces), f"(?=[{_MARKS}])")
    return F.regexp_extract_all(F.array_join(F.transform(parts, fill), ""), F.lit("."), F.lit(0))


def _may_refer(stmt: Column, state: Column) -> Column:
    """False for a statement that ``_statement_refs`` finds nothing in, told without its words."""
    heads = r"""^(?iU)[^\w.&%"']*(?:data|set|merge|update|append)(?![\w.&%])"""
    return F.when(state.isin("S", "P"), stmt.contains("=")).otherwise((state == "s") | stmt.rlike(heads))


def tag_statements(
    programs: DataFrame, keys: Sequence[str] = ("id",), code: str = "code", outer: bool = False, referring: bool = False
) -> DataFrame:
    """Statements with their words and state -> (keys..., pos, stmt, toks, head, proc, in_sql, in_data).

    ``outer`` keeps a program without statements as one row of missing values; ``referring`` leaves out
    statements that can name no dataset.
    """
    pieces = programs.select(*keys, _pieces(F.col(code)).alias("_p"))
    both = F.arrays_zip(F.col("_p").alias("stmt"), _states(F.col("_p")).alias("state"))
    explode = F.posexplode_outer if outer else F.posexplode
    rows = pieces.select(*keys, explode(both).alias("pos", "_s")).select(
        *keys, "pos", F.col("_s.stmt").alias("stmt"), F.col("_s.state").alias("_state")
    )
    if referring:
        rows = rows.filter(_may_refer(F.col("stmt"), F.col("_state")))
    out = rows.withColumn("toks", _words(F.col("stmt")))  # no words: no head, and every rule below is silent
    head, second = F.lower(F.get("toks", F.lit(0))), F.lower(F.get("toks", F.lit(1)))
    return out.withColumns(
        {
            "head": head,
            "proc": F.when((head == "proc") & second.isNotNull(), second),
            "in_sql": F.col("_state") == "s",
            "in_data": F.col("_state") == "d",
        }
    ).drop("_state")


def _hits(text: Column, pattern: str, direction: str | Column, kind: str | Column, group: int = 1) -> Column:
    """Array of candidate references: one struct per match of ``pattern``."""
    lit = {n: v if isinstance(v, Column) else F.lit(v) for n, v in (("d", direction), ("k", kind))}
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda t: F.struct(lit["d"].alias("direction"), lit["k"].alias("kind"), t.alias("token")),
    )


def _statement_refs() -> Column:
    stmt = F.col("stmt")
    bare = F.when(stmt.contains("("), F.regexp_replace(stmt, _OPTIONS, " ")).otherwise(stmt)
    joined = F.concat(F.lit(" "), F.array_join("toks", " "))
    low = F.lower(stmt)
    none = F.array().cast("array<struct<direction:string,kind:string,token:string>>")

    def options(names: str, out: str, prefix: Column) -> Column:
        every = [
            _hits(bare, rf"(?iU)\b{n}\s*=\s*([\w&.]+)", "in" if n == "data" else "out", F.concat(prefix, F.lit(f"_{n}")))
            for n in names.split()
        ]
        return F.when(stmt.contains("="), F.concat(*every)).otherwise(none)

    def after(words: str, direction: str, kind: str) -> Column:
        said = reduce(lambda a, b: a | b, [low.contains(w) for w in {w.split(" ")[0]: 0 for w in words.split("|")}])
        return F.when(said, _hits(joined, rf"(?i)(?<= )(?:{words}) (?=(\S+))", direction, kind)).otherwise(none)

    sql = F.concat(
        after("create table|create view", "out", "sql_create"),
        after("insert into|delete from|update|alter table|truncate table", "out", "sql_write"),
        F.filter(
            F.concat(after("from", "in", "sql_from"), after("join", "in", "sql_join")),
            lambda h: ~F.lower(h["token"]).isin(*SQL_STOPWORDS),
        ),
    )
    names = F.regexp_replace(bare, r"(?iU)^\s*\w+", "")
    names = F.when(stmt.contains("/") | stmt.contains("="), F.regexp_replace(names, r"(?sU)\s(?:/|[^\s=]*+=).*$", "")).otherwise(names)
    listed = _hits(
        names, r"(\S+)", F.when(F.col("head") == "data", "out").otherwise("in"), F.col("head")
    )
    return (
        F.when(F.col("proc").isNotNull(), options("data out outdata base", "out", F.concat(F.lit("proc_"), "proc")))
        .when(F.col("head").isin("quit", "run"), none)
        .when(F.col("in_sql"), sql)
        .when(F.col("head") == "libname", none)
        .when(F.col("head") == "append", options("base data", "out", F.lit("append")))
        .when(F.col("head") == "data", listed)
        .when(F.col("head").isin("set", "merge", "update") & F.col("in_data"), listed)
        .otherwise(none)
    )


def dataset_refs(programs: DataFrame, keys: Sequence[str] = ("id",), tagged: DataFrame | None = None) -> DataFrame:
    """Dataset references in order of appearance -> (keys..., direction, libref, table, kind, pos).

    ``direction`` is in, out or macro (a name built from parameters: library ``&MACRO``). The first
    occurrence per direction and name is kept; unqualified names belong to WORK.
    """
    keys = list(keys)
    if tagged is None:
        tagged = tag_statements(programs, keys, referring=True)
    rows = tagged.select(*keys, "pos", F.posexplode(_statement_refs()).alias("_seq", "_r")).select(*keys, "pos", "_seq", "_r.*")
    rows = rows.withColumn("_name", _name_of(F.col("token"))).filter(
        (F.col("_name") != "") & ~F.col("_name").startswith("<") & (F.upper("_name") != "_NULL_")
    )
    macro = F.col("_name").rlike(r"(?U)&\w+")
    plain = F.col("_name").rlike(_IDENTIFIER)
    dotted = F.instr("_name", ".") > 0
    rows = rows.filter(macro | plain).select(
        *keys,
        F.when(macro, "macro").otherwise(F.col("direction")).alias("direction"),
        F.when(macro, "&MACRO")
        .when(dotted, F.upper(F.substring_index("_name", ".", 1)))
        .otherwise("WORK")
        .alias("libref"),
        F.when(macro, F.col("_name")).otherwise(F.upper(F.substring_index("_name", ".", -1))).alias("table"),
        "kind",
        "pos",
        "_seq",
    )
    return pick_rows(rows, [*keys, "direction", "libref", "table"], ["pos", "_seq"]).drop("_seq")


def _statement_files() -> Column:
    """Array of (mode, path) a tagged statement names: quoted data sets, IMPORT/EXPORT, INFILE/FILE."""
    stmt = F.col("stmt")
    writes = (F.col("head") == "data") | stmt.rlike(r"""(?i)create\s+table\s*['"]""")
    named_in_quotes = F.concat(*[F.regexp_extract_all(stmt, F.lit(DATA_FILE), F.lit(g)) for g in (1, 2)])
    none = F.array().cast("array<string>")
    quoted = F.when(stmt.contains("'") | stmt.contains('"'), F.filter(named_in_quotes, lambda p: p != "")).otherwise(none)

    def one(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract(stmt, pattern, 1), """^["']+|["']+$""", "")

    named = r"""("[^"]+"|'[^']+'|\S+)"""
    sql = F.col("in_sql")
    single = (
        F.when(F.col("proc").isin("import", "export"), one(rf"(?i)(?:datafile|outfile)\s*=\s*{named}"))
        .when((F.col("head") == "infile") & ~sql, one(rf"(?i)infile\s+{named}"))
        .when((F.col("head") == "file") & F.col("in_data"), one(rf"(?i)file\s+{named}"))
    )
    reads = (F.col("proc") == "import") | (F.col("head") == "infile")
    mode = F.when(F.coalesce(reads, F.lit(False)), "read").otherwise("write")
    first = F.transform(quoted, lambda p: F.struct(F.when(writes, "write").otherwise("read").alias("mode"), p.alias("path")))
    then = F.when(F.coalesce(single, F.lit("")) != "", F.array(F.struct(mode.alias("mode"), single.alias("path"))))
    return F.concat(first, F.coalesce(then, F.array().cast("array<struct<mode:string,path:string>>")))


def file_refs(programs: DataFrame, keys: Sequence[str] = ("id",), tagged: DataFrame | None = None) -> DataFrame:
    """Data files read or written -> (keys..., mode, path, pos), the first mention of each."""
    keys = list(keys)
    if tagged is None:
        tagged = tag_statements(programs, keys)
    rows = tagged.select(*keys, "pos", F.inline(_statement_files()))
    return pick_rows(rows, [*keys, "mode", "path"], ["pos"]).select(*keys, "mode", "path", "pos")


def _squeezed() -> Column:
    return F.lower(F.trim(F.regexp_replace("stmt", r"(?U)\s+", " ")))


def _through() -> Column:
    """Does a tagged statement hand SQL to a database as it is."""
    low = _squeezed()
    return F.col("in_sql") & (
        low.contains("connect to") | low.contains("connection to") | low.rlike(r"(?sU)\bexecute\b.*\bby\b")
    )


def passthrough(programs: DataFrame, keys: Sequence[str] = ("id",), tagged: DataFrame | None = None) -> DataFrame:
    """Statements that already ran in a database -> (keys..., pos, alias); alias only for CONNECT TO."""
    keys = list(keys)
    if tagged is None:
        tagged = tag_statements(programs, keys)
    low = _squeezed()
    as_name = F.regexp_extract(low, r"(?U)connect to (\w+)(?: as (\w+))?", 2)
    name = F.regexp_extract(low, r"(?U)connect to (\w+)", 1)
    alias = F.upper(F.when(as_name != "", as_name).otherwise(name))
    return tagged.filter(_through()).select(*keys, "pos", alias.alias("alias"))


def _logic() -> tuple[Column, Column]:
    """(is step logic, is procedural) for a tagged statement."""
    head = F.col("head")
    logic = (
        F.col("in_data")
        & ~F.col("in_sql")
        & F.col("proc").isNull()
        & ~head.isin("quit", "run", "libname", "append", "data", "set", "merge", "update", *DECLARATIVE_HEADS)
    )
    procedural = head.isin(*PROCEDURAL_HEADS) | F.col("stmt").rlike(PROCEDURAL_TOKENS) | F.col("stmt").rlike(SUM_STATEMENT)
    return logic, logic & procedural


def step_logic(programs: DataFrame, keys: Sequence[str] = ("id",), tagged: DataFrame | None = None) -> DataFrame:
    """Does a DATA step need row state, or could SQL say it -> flags and up to 20 evidence lines."""
    keys = list(keys)
    if tagged is None:
        tagged = tag_statements(programs, keys)
    logic, procedural = _logic()
    line = F.substring(F.regexp_replace("stmt", r"(?U)\s+", " "), 1, 100)
    rows = tagged.filter(logic).select(*keys, "pos", procedural.alias("_procedural"), line.alias("_line"))
    flags = rows.groupBy(*keys).agg(
        F.bool_or("_procedural").alias("procedural"), F.bool_or(~F.col("_procedural")).alias("sql_expressible")
    )
    shown = pick_rows(rows.filter("_procedural").select(*keys, "pos", "_line"), keys, ["pos"], k=20)
    lines = shown.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "_line"))).alias("_e"))
    return flags.join(lines, keys, "left").select(
        *keys,
        "procedural",
        "sql_expressible",
        F.coalesce(F.transform("_e", lambda e: e["_line"]), F.array().cast("array<string>")).alias("evidence"),
    )


# --- execution place -------------------------------------------------------------------------

def _name_of(token: Column) -> Column:
    name = F.trim(F.when(token.contains("("), F.regexp_replace(token, _OPTIONS, "")).otherwise(token))
    return F.when(token.contains(","), F.regexp_replace(name, ",+$", "")).otherwise(name)


_MACRO = r"(?U)&\w+"


def _named_refs() -> Column:
    """References of a tagged statement as (direction, name), without what is no dataset."""
    named = F.transform(_statement_refs(), lambda r: F.struct(r["direction"].alias("direction"), _name_of(r["token"]).alias("name")))
    return F.filter(named, lambda n: (n["name"] != "") & ~n["name"].startswith("<") & (F.upper(n["name"]) != "_NULL_"))


def _library(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.upper(F.substring_index(name, ".", 1))).otherwise("WORK")


def _plain_refs(names: Column | str) -> Column:
    """References by plain names, which hold no parameters."""
    return F.filter(names, lambda n: n["name"].rlike(_IDENTIFIER))


def _io(plain: Column | str) -> list[Column]:
    """Full names of the datasets read and written, from ``_plain_refs``."""

    def of(direction: str) -> Column:
        some = F.filter(plain, lambda n: n["direction"] == direction)
        return F.array_distinct(F.transform(some, lambda n: F.concat_ws(".", _library(n["name"]), F.upper(F.substring_index(n["name"], ".", -1)))))

    return [of("in").alias("_in"), of("out").alias("_out")]


def _folded_io() -> list[Column]:
    return [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(n) for c, n in (("_in", "inputs"), ("_out", "outputs"))]


def program_datasets(programs: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Sorted names of the datasets each text reads and writes -> (keys..., inputs, outputs), folded map-side.

    A text whose statements cannot name one has no row.
    """
    rows = tag_statements(programs, list(keys), referring=True).select(*keys, _plain_refs(_named_refs()).alias("_plain"))
    lists = rows.groupBy(*keys).agg(F.flatten(F.collect_set("_plain")).alias("_plain"))
    return lists.select(*keys, *[F.sort_array(c).alias(n) for c, n in zip(_io("_plain"), ("inputs", "outputs"))])


def place_facts(programs: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """What ``place`` decides on, one row per key; one pass over the statements, folded map-side.

    (keys..., libs: libraries referred to, has_macro, has_passthrough, touches_files, has_logic,
    has_procedural, order_procs, own_libs: database libraries the text declares, inputs and outputs: sorted
    names of the datasets read and written)
    """
    keys = list(keys)
    tagged = tag_statements(programs, keys, outer=True)
    logic, procedural = _logic()
    engine = F.upper(F.get("toks", F.lit(2)))
    own = (F.col("head") == "libname") & ~F.col("in_sql") & engine.isin(*DB_ENGINES)
    tagged = tagged.withColumn("_names", _named_refs()).withColumn("_plain", _plain_refs("_names"))
    rows = tagged.select(
        *keys,
        F.array_distinct(F.transform("_plain", lambda n: _library(n["name"]))).alias("_libs"),
        *_io("_plain"),
        F.exists("_names", lambda n: n["name"].rlike(_MACRO)).alias("_macro"),
        _through().alias("_through"),
        (F.size(_statement_files()) > 0).alias("_files"),
        logic.alias("_logic"),
        procedural.alias("_procedural"),
        F.when(F.col("proc").isin(*ORDER_PROCS), F.col("proc")).alias("_order"),
        F.when(own, F.upper(F.get("toks", F.lit(1)))).alias("_own"),
    )
    flags = rows.groupBy(*keys).agg(  # lists of one text's library and procedure names
        F.array_distinct(F.flatten(F.collect_set("_libs"))).alias("libs"),
        *_folded_io(),
        F.bool_or("_macro").alias("has_macro"),
        F.bool_or("_through").alias("has_passthrough"),
        F.bool_or("_files").alias("touches_files"),
        F.bool_or("_logic").alias("has_logic"),
        F.bool_or("_procedural").alias("has_procedural"),
        F.sort_array(F.collect_set("_order")).alias("order_procs"),
        F.collect_set("_own").alias("own_libs"),
    )
    filled = {
        c: F.coalesce(c, F.lit(False))
        for c in ("has_macro", "has_passthrough", "touches_files", "has_logic", "has_procedural")
    }
    none = F.array().cast("array<string>")
    return flags.withColumns(filled | {c: F.coalesce(c, none) for c in ("libs", "order_procs", "own_libs", "inputs", "outputs")})


def place(facts: DataFrame, db_libs: DataFrame, sql_first: bool = False, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Where does a block or program run -> (keys..., placement, reasons, unknown_libs, touches_db).

    ``db_libs(libref)`` are the project's database libraries; ``facts.own_libs`` are added to them.
    Placements: sql_passthrough, sql_pushdown, hybrid, pandas, ambiguous, utility. ``sql_first``
    takes WORK for a temporary schema of the server (if there is one) and lets only row-state
    logic and order-dependent procedures keep a step out of SQL.

    Facts and libraries are staged, so the texts behind them are read once each. A row that refers to one outside
    library at most looks it up; only rows with several are exploded and grouped again.
    """
    keys = list(keys)
    facts = stage(facts, "place-facts")
    known = stage(db_libs.select(F.upper("libref").alias("_lib")).distinct(), "place-libs").withColumn("_db", F.lit(True))
    server = known.agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    outside = F.array_except(F.array_except("libs", "own_libs"), F.array(F.lit("WORK")))
    # the facts travel along (flags and names, no text)
    rest = [c for c in facts.columns if c not in keys]
    several = F.coalesce(F.size(outside) > 1, F.lit(False))
    found = F.col("_db").isNotNull()
    unknown = F.when(F.col("_lib").isNotNull() & ~found, F.array("_lib")).otherwise(F.array().cast("array<string>"))
    single = (
        facts.filter(~several)
        .withColumn("_lib", F.get(outside, F.lit(0)))
        .join(known, "_lib", "left")
        .select(*keys, *rest, found.alias("_named_db"), unknown.alias("unknown_libs"))
    )
    many = (
        facts.filter(several)
        .select(*keys, F.struct(*rest).alias("_f"), F.explode(outside).alias("_lib"))
        .join(known, "_lib", "left")
        .groupBy(*keys)
        .agg(
            F.first("_f").alias("_f"),
            F.bool_or(F.col("_db").isNotNull()).alias("_named_db"),
            F.sort_array(F.collect_set(F.when(F.col("_db").isNull(), F.col("_lib")))).alias("unknown_libs"),
        )
        .select(*keys, "_f.*", "_named_db", "unknown_libs")
    )
    rows = single.unionByName(many)
    work = F.array_contains("libs", F.lit("WORK"))
    own_db = F.size(F.array_intersect("libs", "own_libs")) > 0
    order = F.size("order_procs") > 0
    work_db = F.lit(sql_first) & (server | (F.size("own_libs") > 0))
    rows = rows.withColumns(
        {
            "touches_db": F.col("_named_db") | own_db | (work & work_db),
            "_in_work": work & ~work_db,
            "_heavy": (F.col("has_procedural") | order) if sql_first else F.col("has_logic"),
        }
    )
    files, db, refs = F.col("touches_files"), F.col("touches_db"), F.size("libs") > 0
    open_libs = F.size("unknown_libs") > 0
    verdict = (
        F.when(F.col("has_passthrough"), "sql_passthrough")
        .when(F.col("has_macro") & ~refs, "ambiguous")
        .when(open_libs, "ambiguous")
        .when(db & ~files & ~F.col("_in_work") & ~F.col("_heavy"), "sql_pushdown")
        .when(db, "hybrid")
        .when(refs | files | F.col("_heavy"), "pandas")
        .otherwise("utility")
    )
    procs = F.concat(F.lit("order-dependent procedure: "), F.array_join("order_procs", ", "))
    hybrid = [
        F.when(files, F.lit("database tables mixed with files")),
        F.when(F.col("_in_work"), F.lit("database tables mixed with WORK")),
        F.when(F.lit(not sql_first) & F.col("_heavy"), F.lit("DATA step logic")),
        F.when(F.lit(sql_first) & F.col("has_procedural"), F.lit("DATA step logic with row state")),
        F.when(F.lit(sql_first) & order, procs),
    ]
    unconfirmed = F.concat(F.lit("unconfirmed libraries: "), F.array_join("unknown_libs", ", "))
    reasons = (
        F.when(verdict == "sql_passthrough", F.array(F.lit("runs in the database already")))
        .when(open_libs & (verdict == "ambiguous"), F.array(unconfirmed))
        .when(verdict == "ambiguous", F.array(F.lit("only names built from parameters")))
        .when(verdict == "sql_pushdown", F.array(F.lit("inputs and outputs in the database, logic fits SQL")))
        .when(verdict == "hybrid", F.array_compact(F.array(*hybrid)))
        .when((verdict == "pandas") & F.lit(sql_first) & order, F.array(procs))
        .when(verdict == "pandas", F.array(F.lit("only files and WORK datasets")))
        .otherwise(F.array(F.lit("no data references")))
    )
    return rows.select(*keys, verdict.alias("placement"), reasons.alias("reasons"), "unknown_libs", "touches_db")


def place_blocks(programs: DataFrame, db_libs: DataFrame, sql_first: bool = False) -> DataFrame:
    """``place`` for every block; libraries declared in one block count for the whole program."""
    keys = ["id", "block"]
    facts = place_facts(blocks(programs), keys)
    shared = F.flatten(F.collect_set("own_libs").over(W.partitionBy("id")))  # the blocks of one text
    return place(facts.withColumn("own_libs", F.array_distinct(shared)), db_libs, sql_first, keys)


def rollup_verdict(placed: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Program placement from its blocks -> (by..., placement).

    Utility blocks do not count; an ambiguous block makes the program ambiguous; all in the
    database: passthrough or pushdown; some: hybrid; none: hybrid if a block is, else pandas.
    """
    p = F.col("placement")
    in_db = p.isin("sql_passthrough", "sql_pushdown")
    data = p != "utility"
    flags = placed.groupBy(*by).agg(
        F.bool_or(data).alias("_data"),
        F.bool_or(p == "ambiguous").alias("_open"),
        F.bool_and(F.when(data, in_db)).alias("_all_db"),
        F.bool_and(F.when(data, p == "sql_passthrough")).alias("_all_through"),
        F.bool_or(in_db).alias("_some_db"),
        F.bool_or(p == "hybrid").alias("_hybrid"),
    )
    return flags.select(
        *by,
        F.when(~F.col("_data"), "utility")
        .when(F.col("_open"), "ambiguous")
        .when(F.col("_all_db"), F.when(F.col("_all_through"), "sql_passthrough").otherwise("sql_pushdown"))
        .when(F.col("_some_db") | F.col("_hybrid"), "hybrid")
        .otherwise("pandas")
        .alias("placement"),
    )


def rejudge(
    facts: DataFrame,
    placed: DataFrame,
    db_libs: DataFrame,
    confirmed: DataFrame,
    noise: DataFrame,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Judge ambiguous rows again once libraries are confirmed as databases or declared file paths.

    -> (keys..., placement, reason) for the rows that are settled now; the rest stays open.
    """
    keys = list(keys)
    open_ = placed.filter("placement = 'ambiguous'").select(*keys)
    wider = db_libs.select("libref").unionByName(confirmed.select("libref")).distinct()
    again = stage(place(facts.join(open_, keys, "left_semi"), wider, keys=keys), "again")
    settled = again.filter("placement <> 'ambiguous'").select(
        *keys, "placement", F.lit("library confirmed as database").alias("reason")
    )
    rest = again.filter((F.col("placement") == "ambiguous") & (F.size("unknown_libs") > 0))
    quiet = noise.select(F.upper("libref").alias("_lib")).distinct().withColumn("_quiet", F.lit(True))
    judged = (
        rest.select(*keys, "touches_db", F.explode("unknown_libs").alias("_lib"))
        .join(quiet, "_lib", "left")
        .groupBy(*keys, "touches_db")
        .agg(F.bool_and(F.col("_quiet").isNotNull()).alias("_all"))
        .filter("_all")
    )
    return settled.unionByName(
        judged.select(
            *keys,
            F.when(F.col("touches_db"), "hybrid").otherwise("pandas").alias("placement"),
            F.lit("library declared a file path").alias("reason"),
        )
    )


# --- run logs --------------------------------------------------------------------------------

def run_log_lines(lines: DataFrame, log: str = "log_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Source lines of run logs -> (log, line_no, text): ``s`` lines, cut at the log's text column.

    The text column is the smallest one of the log's source lines.
    """
    head = F.regexp_extract(line, r"^s\s+[0-9]+\s*", 0)
    source = lines.filter(F.col(line).rlike(r"^s\s+[0-9]+")).withColumn("_col", F.length(head))
    edge = source.groupBy(log).agg(F.min("_col").alias("_min"))
    return source.join(edge, log).select(
        log, line_no, F.substring(F.col(line), F.col("_min") + 1, F.length(line)).alias("text")
    )


def from_run_logs(lines: DataFrame, log: str = "log_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Query text recovered from run logs -> (log, block, code): every ``PROC SQL; ... QUIT;``.

    ``block`` is the line the block starts on; a block that never reaches QUIT is left out.
    """
    text = run_log_lines(lines, log, line_no, line)
    quit_ = F.regexp_extract("text", r"(?i)^\s*QUIT;", 0)
    text = text.withColumns({"_start": F.col("text").rlike(r"(?i)^\s*PROC SQL;"), "_end": quit_ != ""})
    text = text.withColumn("_mark", F.when(F.col("_start"), F.lit(True)).when(F.col("_end"), F.lit(False)))
    state = retain_last(text, [log], "_mark", [line_no], name="_on")
    state = lag_n(state, [log], "_on", [line_no], name="_was_on")
    state = state.withColumn("_was_on", F.coalesce("_was_on", F.lit(False)))
    begin = F.when(F.col("_start") & ~F.col("_was_on"), F.col(line_no))
    state = retain_last(state.withColumn("_begin", begin), [log], "_begin", [line_no], name="block")
    body = state.filter(F.col("_on") | (F.col("_end") & F.col("_was_on"))).withColumn(
        "text", F.when(F.col("_end"), quit_).otherwise(F.col("text"))
    )
    return (
        body.groupBy(log, "block")  # one block of one log: a single query text
        .agg(F.bool_or("_end").alias("_done"), F.sort_array(F.collect_list(F.struct(line_no, "text"))).alias("_l"))
        .filter("_done")
        .select(log, "block", F.trim(F.array_join(F.transform("_l", lambda x: x["text"]), "\n")).alias("code"))
    )
