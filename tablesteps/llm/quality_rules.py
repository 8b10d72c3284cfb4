"""Line-first quality rules, in DataFrame functions only.

Every line is judged alone: it fails for punctuation (a large part of its words ends in symbols or
shouted marks, or a fragment has no sentence mark at all), for navigation (words in menus cut by bars and
arrows) and for boilerplate (cookie, rights, script and licence phrases). Failing lines are taken out, and
a document that loses too large a part of its words is rejected.

The base figures stand beside it: words in three-word windows that the text repeats are found by sorting
the windows of one text, inside its own row, so nothing is shuffled and no window of a long text is left out.

Defined results: a NULL or empty text has no words, so its figures are 0 and it fails the base rule; rows
are judged one by one, so repeated rows and NULL ids change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import WORD, named, texts

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Line rules. A line fails the punctuation rule when this part of its words ends badly.
BAD_END = r"[#*$%&<>=~^_{}\\]{2,}(?:[\x20\x09-\x0D]|$)|!!+(?:[\x20\x09-\x0D]|$)"
BAD_END_PERCENT = 30
SENTENCE_MARK = r"[.!?:;,\"'…。！？»”’)]"
FRAGMENT_WORDS = 4
NAVIGATION = r"(?:^|[\x20\x09-\x0D])[|>»›•·](?:[\x20\x09-\x0D]|$)"
NAVIGATION_PERCENT = 20
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|privacy policy|terms of (?:use|service)|cookies? (?:policy|settings)|accept (?:all )?cookies"
    r"|enable javascript|lorem ipsum|sign up for our newsletter|skip to (?:main )?content|click here to|released under the|subscribe to our)\b"
)
#: A document is rejected when it loses more than this part of its words.
MAX_LOST_PERCENT = 50


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more, each counted once."""

    def marked(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def twin(row: Column, at: Column) -> Column:
                before, after = F.get(rows, at - 1)["w"], F.get(rows, at + 1)["w"]
                return row["w"].eqNullSafe(before) | row["w"].eqNullSafe(after)

            return F.array_sort(F.transform(F.filter(rows, twin), lambda row: row["i"]))

        covered = F.aggregate(
            bind(ordered, starts),
            F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n")),
        )["n"]
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)

    def windows(found: Column) -> Column:
        n = F.size(found)
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", *[F.get(found, i + k) for k in range(size)]))
        return F.when(n < size, F.lit(0)).otherwise(bind(each, marked))

    return bind(words, windows).cast("long")


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def line_fails(line: Column, words: Column) -> Column:
    """True for a line that breaks the punctuation, navigation or boilerplate rule."""
    punctuation = (F.regexp_count(line, F.lit(BAD_END)) * 100 > words * BAD_END_PERCENT) | (
        (words < FRAGMENT_WORDS) & ~line.rlike(SENTENCE_MARK)
    )
    navigation = F.regexp_count(line, F.lit(NAVIGATION)) * 100 > words * NAVIGATION_PERCENT
    return punctuation | navigation | line.rlike(BOILERPLATE)


def _lost(lines: Column) -> Column:
    """Words of the lines and of those that fail, as a struct."""

    def judged(line: Column) -> Column:
        return bind(F.regexp_count(line, F.lit(WORD)), lambda n: F.struct(n.alias("n"), F.when(line_fails(line, n), n).otherwise(0).alias("lost")))

    return F.aggregate(
        F.transform(lines, judged),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("lost")),
        lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), (acc["lost"] + x["lost"]).alias("lost")),
    )


def measure(text: Column) -> dict[str, Column]:
    """The figures of one text, by name."""
    lines = F.filter(F.split(text, "\n", -1), has_word)
    return {
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "lines": bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"), _lost(x).alias("lost"))),
        "words": bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))),
    }


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the base figures, ``base_failed`` and ``kept``."""
    rows = texts(docs, id_col, text_col)
    figures = measure(F.col("text"))
    return _verdict(rows.select("doc_id", *[c.alias(n) for n, c in figures.items()])).select(
        "doc_id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.repeated").alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"), "base_failed", "kept", F.col("lines.lost.lost").cast("long").alias("n_lost_words"),
    )


def _verdict(figures: DataFrame) -> DataFrame:
    n = F.col("words.n")
    base = (n < MIN_WORDS) | (100 * F.col("words.repeated") > MAX_REPEATED_PERCENT * n)
    lost = F.col("lines.lost.lost") * 100 > F.col("lines.lost.n") * MAX_LOST_PERCENT
    return figures.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns unchanged."""
    figures = measure(F.coalesce(named(docs, text_col), F.lit("")))
    rows = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"), *[figures[n].alias(n) for n in ("words", "lines")])
    return _verdict(rows).where("kept").select("row.*")


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the failing lines taken out of the text (blank lines stay)."""
    lines = F.split(named(docs, text_col), "\n", -1)
    good = F.filter(lines, lambda x: ~(has_word(x) & line_fails(x, F.regexp_count(x, F.lit(WORD)))))
    return docs.select(*[(F.array_join(good, "\n") if c == text_col else named(docs, c)).alias(c) for c in docs.columns])
