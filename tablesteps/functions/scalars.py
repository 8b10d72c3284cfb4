"""Scalar functions of the old language, as Column expressions.

Everything stays in the JVM. Conversions return NULL on bad input (ANSI casts would throw).
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.operators.ordered import row_counter

# Fragments that mark a parameter as a credential.
CREDENTIAL_HINTS = ("user", "pass", "pwd", "uid", "token", "secret", "key", "cred", "auth")

# Legacy date formats and their Spark patterns.
DATE_FORMATS = {
    "yymmn6.": "yyyyMM",
    "yymmdd10.": "yyyy-MM-dd",
    "yymmddn8.": "yyyyMMdd",
    "ddmmyy10.": "dd/MM/yyyy",
    "mmddyy10.": "MM/dd/yyyy",
    "date9.": "ddMMMyyyy",
    "year4.": "yyyy",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- conversions -----------------------------------------------------------------------------

# Fixed value: shape of a plain number (a cast alone would also take Java suffixes such as ``1d``).
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_num(c: Column | str) -> Column:
    """``INPUT(x, best.)``: number, or missing when the text is not one."""
    text = F.trim(_c(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_dmy(c: Column | str, pattern: str = "dd-MM-yyyy") -> Column:
    """``INPUT(x, ddmmyy10.)``: day-month-year text to a date, missing when malformed."""
    return F.to_date(F.try_to_timestamp(F.trim(_c(c)), F.lit(pattern)))


def put(c: Column | str, fmt: str) -> Column:
    """``PUT(x, fmt)`` for ``w.d``, ``zw.``, ``commaw.d``, ``commaxw.d``, ``best.``, dates, ``$w.``."""
    c, fmt = _c(c), fmt.strip().lower()
    if fmt in DATE_FORMATS:
        text = F.date_format(c, DATE_FORMATS[fmt])
        return F.upper(text) if fmt == "date9." else text
    if fmt.startswith("best"):
        return c.cast("string")
    if fmt.startswith("$"):
        width = re.fullmatch(r"\$(\d*)\.", fmt)
        if width is None:
            raise ValueError(f"unknown format {fmt!r}")
        return F.substring(c, 1, int(width[1])) if width[1] else c.cast("string")
    m = re.fullmatch(r"(z|commax|comma|)(\d+)\.(\d*)", fmt)
    if m is None:
        raise ValueError(f"unknown format {fmt!r}")
    kind, width, places = m[1], int(m[2]), int(m[3] or 0)
    if kind == "z":
        return F.format_string(f"%0{width}d", F.round(c, 0).cast("long"))
    if kind == "comma":
        return F.format_number(c, places)
    if kind == "commax":
        return F.translate(F.format_number(c, places), ",.", ".,")
    return F.round(c.cast(f"decimal(38,{min(places + 6, 18)})"), places).cast(f"decimal(38,{places})").cast("string")


def put_yymm(c: Column | str) -> Column:
    """``PUT(d, yymmn6.)``."""
    return F.date_format(_c(c), "yyyyMM")


# --- dates -----------------------------------------------------------------------------------

def intnx_month(d: Column | str, n: int | Column, align: str = "same") -> Column:
    """``INTNX('month', d, n, align)``; ``align`` is always explicit: same, b(egin) or e(nd)."""
    moved = F.add_months(F.to_date(_c(d)), n)
    if align in ("same", "s"):
        return moved
    if align in ("b", "begin"):
        return F.trunc(moved, "MM")
    if align in ("e", "end"):
        return F.last_day(moved)
    raise ValueError(f"unknown alignment {align!r}")


def intck_month(a: Column | str, b: Column | str) -> Column:
    """``INTCK('month', a, b)``: month boundaries crossed, not elapsed months."""
    a, b = _c(a), _c(b)
    return ((F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))).cast("long")


def mdy(m: Column | str, d: Column | str, y: Column | str) -> Column:
    """``MDY(m, d, y)``; missing for an impossible date."""
    zero = F.lit(0)
    return F.to_date(
        F.try_make_timestamp(
            _c(y).cast("int"), _c(m).cast("int"), _c(d).cast("int"), zero, zero, zero.cast("decimal(8,6)")
        )
    )


def datepart(c: Column | str) -> Column:
    return F.to_date(_c(c))


def from_day_number(n: Column | str) -> Column:
    """Legacy day number (days since 1960-01-01) to a date."""
    return F.date_add(F.lit("1960-01-01").cast("date"), _c(n).cast("int"))


def to_day_number(d: Column | str) -> Column:
    """Date to the legacy day number."""
    return F.datediff(F.to_date(_c(d)), F.lit("1960-01-01").cast("date")).cast("long")


def today(asof: str | None = None) -> Column:
    """``TODAY()``; a literal as-of date keeps a run repeatable."""
    return F.lit(asof).cast("date") if asof else F.current_date()


def last_day(y: Column | str, m: Column | str) -> Column:
    """Number of the last day of a month; missing for an impossible month."""
    return F.dayofmonth(F.last_day(mdy(m, F.lit(1), y))).cast("long")


# --- text ------------------------------------------------------------------------------------

def compress(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit(" "), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.trim(_c(c))


def upcase(c: Column | str) -> Column:
    return F.upper(_c(c))


def lowcase(c: Column | str) -> Column:
    return F.lower(_c(c))


def substr(c: Column | str, i: int, n: int) -> Column:
    """``SUBSTR(s, i, n)``, counted from 1."""
    return F.substring(_c(c), i, n)


def scan(c: Column | str, n: int, sep: str, collapse: bool = False) -> Column:
    """``SCAN(s, n, sep)``, counted from 1 (from the end when negative); missing past the end.

    Separators do not collapse unless asked for, as in a plain split.
    """
    c, quoted = _c(c), re.escape(sep)
    if collapse:
        c = F.regexp_replace(c, f"^(?:{quoted})+|(?:{quoted})+$", "")
        quoted = f"(?:{quoted})+"
    return F.try_element_at(F.split(c, quoted), F.lit(n))


def catx(sep: str, *cols: Column | str) -> Column:
    """``CATX(sep, ...)``: trimmed parts, blanks and missing left out."""
    return F.concat_ws(sep, *[F.nullif(F.trim(_c(c).cast("string")), F.lit("")) for c in cols])


def round_half_up(c: Column | str, n: int = 0) -> Column:
    return F.round(_c(c), n)


def base_name(c: Column | str, upper: bool = False) -> Column:
    """Last dotted part of a table name, lower case (upper on request)."""
    last = F.element_at(F.split(F.trim(_c(c)), "[.]"), -1)
    return F.upper(last) if upper else F.lower(last)


def qualify(c: Column | str, default: str = "WORK") -> Column:
    """Upper-cased ``LIB.TABLE``; an unqualified name belongs to ``default``."""
    name = F.upper(F.trim(_c(c)))
    return F.when(F.instr(name, ".") > 0, name).otherwise(F.concat(F.lit(f"{default}."), name))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from the Unicode decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _accent_table()


def fold_accents(c: Column | str) -> Column:
    return F.translate(_c(c), ACCENTED, PLAIN)


def slugify(c: Column | str, fallback: str = "flujo") -> Column:
    """Label to a file-name slug: accents folded, other symbols to ``_``, lower case."""
    ascii_only = F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def url_host(c: Column | str) -> Column:
    """Literal host of a URL; empty when there is none or a parameter builds it."""
    authority = F.regexp_extract(F.trim(_c(c)), r"""(?i)^[a-z][a-z0-9+.\-]*://([^/\s?"']+)""", 1)
    no_user = F.element_at(F.split(authority, "@"), -1)
    host = F.lower(F.trim(F.element_at(F.split(no_user, ":"), 1)))
    return F.when(host.rlike("[&%]"), F.lit("")).otherwise(host)


def is_credential_name(c: Column | str) -> Column:
    """Does a parameter name look like a credential? When in doubt, yes."""
    return F.lower(F.trim(_c(c))).rlike("|".join(CREDENTIAL_HINTS))


def _single_upper() -> tuple[str, str]:
    """Letters whose upper case is several letters, and the one letter that stands for it (itself if there is none)."""
    many = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
    return "".join(many), "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in many)


EXPANDING, SINGLE = _single_upper()


def upper_by_letter(c: Column | str) -> Column:
    """Upper case of each letter on its own, as SQL has it: the length stays, and ``ß`` does not become ``SS``."""

    def apart(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"[{EXPANDING}]+|[^{EXPANDING}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{EXPANDING}]"), F.translate(p, EXPANDING, SINGLE)).otherwise(F.upper(p))), "")

    # an array of one, so that the text is made once
    one = F.transform(F.array(_c(c)), lambda text: F.when(text.rlike(f"[{EXPANDING}]"), apart(text)).otherwise(F.upper(text)))
    return F.get(one, F.lit(0))


def norm_block(c: Column | str) -> Column:
    """Normal form of a piece of code: comments out, blanks squeezed, upper case letter by letter."""
    bare = F.regexp_replace(_c(c), r"(?s)/\*.*?\*/", "")
    return upper_by_letter(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def repair_text(c: Column | str) -> Column:
    """UTF-8 text that was once read as latin-1 (mojibake) put right; other text unchanged."""
    c = _c(c)
    narrow = F.when(c.rlike(r"^[\x00-\xFF]*$"), c)
    return F.coalesce(F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string")), c)


# --- hashes ----------------------------------------------------------------------------------

def sha12(c: Column | str) -> Column:
    return F.substring(F.sha2(_c(c).cast("binary"), 256), 1, 12)


def content_hash(df: DataFrame, key: str, order_by: list[str], text: str) -> DataFrame:
    """One stable hash per key over its ordered texts -> (key, n_cells, content_hash).

    Each (position, text) is hashed on its own and the hashes are added up in four 60-bit lanes,
    so a key of any size needs partial sums only; no group is collected.
    """
    cells = row_counter(df.select(key, *order_by, text), order_by, by=[key], name="_pos")
    digest = F.sha2(F.concat_ws("\u0001", F.col("_pos").cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)
    lanes = [
        F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)
    ]
    return (
        cells.withColumn("_d", digest)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_cells"), F.sha2(F.concat_ws("-", *lanes), 256).alias("content_hash"))
    )
