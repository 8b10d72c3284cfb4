"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Each text gives base spans (assignments, access keys, hexadecimal runs) and further candidates: known
token formats and long mixed strings. Every candidate's value is reduced to a digest; digests are counted
over distinct repositories and owners of the whole corpus, in steps of (value, owner, repository),
(value, owner) and (value), each combined before its shuffle. A value that several owners hold is a widely copied
example; one that a single owner holds looks live. Base spans always stay; candidates outside them are added
as ``owned`` spans when they look live.

Defined results: a NULL or empty text has no spans; a NULL owner or repository is one of its own; repeated
rows are separate rows of one repository; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, named
from tablesteps.llm.quality_rules import bind

#: The base kinds in their order, their patterns, the group that counts and its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: What is searched for the kinds whose matches are runs of one class: only matches that are long enough.
#: A run is matched from its start, so the shorter ones that this leaves out cannot hide another match.
SEARCHED = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
OWNED = "owned"
#: Further candidates: token formats in public use, and long strings of mixed characters.
FORMATS = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
CANDIDATE = f"{FORMATS}|{MIXED}"
MAX_OWNERS = 1
#: A value in more repositories than this is a copied example, whoever owns them.
MAX_REPOS = 20


def spans(text: Column, pattern: str, group: int) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost, non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves, laid end to end, are the text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    walked = F.aggregate(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)").alias("out")),
        lambda acc, p: bind(
            acc["at"] + F.length(p["gap"]),
            lambda start: bind(
                start + F.length(p["match"]),
                lambda end: F.struct(
                    end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out")
                ),
            ),
        ),
    )["out"]
    return F.when(text.rlike(pattern), walked).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)"))


def _base(text: Column) -> list[Column]:
    """Per base kind, ``array<struct<start, kind_no, end, value>>``."""
    def of(number: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = spans(text, SEARCHED.get(kind, pattern), group)
        return _numbered(F.filter(found, lambda s: F.length(s["value"]) >= least), number)

    return [of(number, *rule) for number, rule in enumerate(BASE)]


def _numbered(found: Column, number: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit(OWNED))
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _mixed(value: Column) -> Column:
    return (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")) | value.rlike(f"^(?:{FORMATS})$")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, the base spans' digest, all spans, and how many
    of the values look ``live`` or are ``copied``: held by more than ``max_owners`` owners, or in more than
    ``max_repos`` repositories though one owner has them all."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(
        named(docs, id_col).alias("doc_id"), named(docs, owner_col).cast("string").alias("owner"), named(docs, repo_col).cast("string").alias("repo"),
        F.coalesce(named(docs, text_col), F.lit("")).alias("text"),
    )
    number = len(BASE)
    more = _numbered(F.filter(spans(F.col("text"), CANDIDATE, 0), lambda s: _mixed(s["value"])), number)
    found = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "owner", "repo",
        *[c.alias(kind) for c, (kind, *_) in zip(_base(F.col("text")), BASE)], more.alias("more"),
    )
    found = found.withColumn("base", F.array_sort(F.concat(*[kind for kind, *_ in BASE])))
    outside = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # values leave the scan as digests; a secret itself is not stored
    digested = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("key"))
    found = scratch.put(
        found.select(
            "uid", "doc_id", "owner", "repo", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
            F.transform("base", digested).alias("base"), F.transform(outside, digested).alias("more"),
        ),
        "found",
    )
    each = found.where("size(base) + size(more) > 0").select("uid", "owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    held = each.select(F.col("s.key").alias("k"), "owner", "repo").groupBy("k", "owner", "repo").agg(F.count("*").alias("n"))
    held = held.groupBy("k", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    owned = held.groupBy("k").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    told = each.select("uid", "s", F.col("s.key").alias("key")).join(owned, F.col("key") == F.col("k"))
    told = told.groupBy(F.col("uid").alias("u")).agg(
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"),
        F.collect_list(F.when(live & (F.col("s.kind") == number), F.col("s"))).alias("added"),
    )
    joined = found.join(told, F.col("uid") == F.col("u"), "left")
    added = F.coalesce("added", F.slice("more", 1, 0))
    return joined.select(
        "doc_id", *[f"n_{kind}" for kind, *_ in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", added))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
