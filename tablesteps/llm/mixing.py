"""Mixing sources to target weights through a splitting tree of hypergeometric draws.

Each source gets a target number of words. Its documents stand in an order permuted by a hash; the words of
that order, repeated from the start where the target is above the source's size, are cut into blocks of
equal length, so the number of blocks is the source's exact quota. A binary tree over the output shards
starts with the vector of all quotas; each node draws the left half's vector from the multivariate
hypergeometric distribution and leaves the rest to the right half. A leaf then holds, of each source, a range
of ranks in a pseudo-random permutation of the source's blocks: ranges are disjoint and cover all blocks.
Documents follow the block in which they begin, and are shuffled inside their shard by a hash.

The upper half of the tree is walked by one task (a number of nodes of about the square root of the shards)
and each of its leaves by a task of its own. Words before a document are summed in two steps: over ranges
of the hash, whose number is about the square root of the rows, and inside each range. So a source that holds
a third of all rows is spread over many tasks, and texts are not moved for any of this.

Defined results: sizes are counts of words, NULL and empty texts have none and are never taken; NULL is a
source of its own, after all others; repeated rows are separate documents; an empty table gives no rows;
other columns are not read (``mix`` returns them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablesteps.llm.common import Scratch, named, word_count

BLOCK_WORDS = 1 << 13
SHARD_WORDS = 1 << 22
#: Blocks get longer where there would be more than this many: draws stay exact, as the library's draw ends at 10^9.
MOST_BLOCKS = 500_000_000


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources(source, source_size)`` with ``target``.

    ``weights`` repeat over the sources in code-point order, NULL last. ``share`` of all words is split by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight. That is one level above which no source rises: sorted by cap over weight, the capped ones
    come first.
    """
    everything = Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))
    place = (F.row_number().over(everything) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last(F.col("source").cast("binary")))
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level)
    # the first source whose level stays below its cap gives the level of all that follow
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return levelled.withColumn("level", final).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target")
    )


def split_quotas(quotas: np.ndarray, starts: np.ndarray, low: int, high: int, seed: int, stop: int = 1):
    """Leaves (low, high, quotas, starts) of the tree over shards ``low..high-1``, down to ``stop`` shards."""
    if high - low <= stop:
        yield low, high, quotas, starts
        return
    middle = (low + high) // 2
    total = int(quotas.sum())
    # shards get equal numbers of blocks, but for one more or less
    left_slots = total * (middle - low) // (high - low)
    draw = np.random.default_rng([seed, low, high])
    left = np.zeros_like(quotas)
    rest, want = total, left_slots
    for k, n in enumerate(quotas.tolist()):
        rest -= n
        if n and want:
            left[k] = draw.hypergeometric(n, rest, want)
            want -= int(left[k])
    yield from split_quotas(left, starts, low, middle, seed, stop)
    yield from split_quotas(quotas - left, starts + left, middle, high, seed, stop)


def permuted(ranks: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudo-random permutation of 0..n-1 at ``ranks``: four Feistel rounds, walked back into range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = ranks.astype(np.uint64)
    wild = np.ones(len(x), bool)
    while wild.any():
        y = x[wild]
        left, right = y >> np.uint64(half), y & low
        for turn in range(4):
            key = np.uint64((seed * 1_000_003 + turn * 7919 + 1) & 0xFFFFFFFF)
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, (left ^ (mixed >> np.uint64(32))) & low
        x[wild] = left << np.uint64(half) | right
        wild[wild] = x[wild] >= n
    return x.astype(np.int64)


def _rows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, seed: int, whole: bool) -> DataFrame:
    """Size, source and hash of every row, numbered; with ``whole`` the row itself too, which only ``mix`` reads."""
    row = [F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), named(docs, id_col).alias("doc_id"), named(docs, source_col).cast("string").alias("source"),
        word_count(named(docs, text_col)).alias("size"), F.xxhash64(named(docs, id_col), F.lit(seed)).alias("h"), *row,
    )
    return scratch.put(rows, "rows")


def _plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per row: its words' place in the permuted order, and the copies that the mix takes of it."""
    rows = rows.select("uid", "doc_id", "source", "size", "h")
    total = rows.count()
    bits = max(1, math.ceil(math.log2(max(2, total)) / 2))
    rows = rows.withColumn("range", F.shiftright("h", 64 - bits))
    sources = scratch.put(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "sources")
    # words before each range of the source's hash order, then words before each row of its range
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("begin", F.col("begin") + F.col("base"))
    by_source = sources.withColumnRenamed("source", "s2")
    placed = placed.join(by_source, F.col("source").eqNullSafe(F.col("s2")))
    goal = F.floor(F.col("target") + 0.5)
    taken = [
        F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("begin") - k * F.col("source_size"))).cast("long")
        for k in range(math.ceil(most))
    ]
    copies = F.filter(
        F.array(*[
            F.struct(F.lit(k).alias("pass"), (F.col("begin") + k * F.col("source_size")).alias("at"), words.alias("words"))
            for k, words in enumerate(taken)
        ]),
        lambda c: c["words"] > 0,
    )
    return placed.select("uid", "doc_id", "source", "size", "source_size", "target", goal.alias("goal"), copies.alias("copies"))


def _shards(plan: DataFrame, scratch: Scratch, seed: int, block_words: int, shard_words: int) -> DataFrame:
    """``(source, block, shard)``: the shard of each block, by the splitting tree."""
    quotas = plan.where("goal > 0").groupBy("source").agg(F.first("goal").alias("goal"))
    quotas = quotas.select("source", _blocks(F.col("goal"), block_words).alias("quota"), "goal")
    root = quotas.agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("q"),
        F.greatest(F.lit(1), F.ceil(F.sum("goal") / shard_words)).cast("long").alias("shards"),
    )

    def upper(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sources, quota = [x["source"] for x in row["q"]], np.array([x["quota"] for x in row["q"]], np.int64)
                stop = max(1, math.isqrt(row["shards"]))
                nodes = list(split_quotas(quota, np.zeros_like(quota), 0, row["shards"], seed, stop))
                yield pa.RecordBatch.from_pylist(
                    [{"low": a, "high": b, "sources": sources, "all": quota.tolist(), "quota": q.tolist(), "begin": s.tolist()} for a, b, q, s in nodes],
                    schema,
                )

    def lower(batches):
        for batch in batches:
            for row in batch.to_pylist():
                quota, begin = np.array(row["quota"], np.int64), np.array(row["begin"], np.int64)
                for shard, _, some, starts in split_quotas(quota, begin, row["low"], row["high"], seed):
                    for k in np.flatnonzero(some).tolist():
                        ranks = np.arange(starts[k], starts[k] + some[k])
                        blocks = permuted(ranks, row["all"][k], seed + k)
                        name = pa.array([row["sources"][k]], pa.string()).take(pa.array(np.zeros(len(blocks), np.int64)))
                        yield pa.RecordBatch.from_arrays([name, pa.array(blocks), pa.array(np.full(len(blocks), shard))], ["source", "block", "shard"])

    ints = pa.list_(pa.int64())
    schema = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("sources", pa.list_(pa.string())), ("all", ints), ("quota", ints), ("begin", ints)])
    ddl = StructType.fromDDL("low long, high long, sources array<string>, all array<long>, quota array<long>, begin array<long>")
    nodes = root.mapInArrow(upper, ddl).repartition("low")
    return scratch.put(nodes.mapInArrow(lower, "source string, block long, shard long"), "blocks")


def _blocks(goal: Column, block_words: int) -> Column:
    return F.greatest(F.lit(1), F.floor(goal / block_words + 0.5)).cast("long")


def assign(
    rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: float, seed: int, block_words: int, shard_words: int
) -> tuple[DataFrame, DataFrame]:
    """The plan, one row per document, and the copies in the mix: ``uid, pass, size, words, shard``."""
    plan = scratch.put(_plan(rows, scratch, weights, share, most), "plan")
    words = plan.groupBy("source").agg(F.first("goal").alias("goal")).agg(F.sum("goal")).first()[0] or 0
    block_words = max(block_words, -(-int(words) // MOST_BLOCKS))
    shards = _shards(plan, scratch, seed, block_words, shard_words).select(F.col("source").alias("s"), F.col("block").alias("b"), "shard")
    each = plan.select("uid", "source", "size", "goal", F.explode("copies").alias("c"))
    last = _blocks(F.col("goal"), block_words)
    block = F.least(last - 1, F.floor(F.col("c.at").cast("double") * last / F.col("goal"))).cast("long")
    mixed = each.withColumn("block", block).join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return plan, mixed.select("uid", F.col("c.pass").alias("pass"), "size", F.col("c.words").alias("words"), "shard")


def taken(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1,),
    share: float = 1.0, most: float = 2.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (words that the mix takes)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(docs, scratch, id_col, text_col, source_col, seed, False)
    plan, mixed = assign(rows, scratch, weights, share, most, seed, block_words, shard_words)
    sums = mixed.groupBy(F.col("uid").alias("u")).agg(F.sum("words").alias("words"))
    joined = plan.drop("copies").join(sums, F.col("uid") == F.col("u"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1,),
    share: float = 1.0, most: float = 2.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row per copy, by shard, shuffled inside each shard.

    Copies are whole: the copy of a source within which the target is reached is taken where that comes nearer to
    the target than leaving it out.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(docs, scratch, id_col, text_col, source_col, seed, True)
    _, mixed = assign(rows, scratch, weights, share, most, seed, block_words, shard_words)
    mixed = mixed.where(2 * F.col("words") >= F.col("size"))
    joined = rows.select(F.col("uid").alias("u"), "row").join(mixed, F.col("u") == F.col("uid"))
    dealt = joined.repartition("shard").sortWithinPartitions("shard", F.xxhash64("uid", "pass", F.lit(seed)), "uid", "pass")
    return dealt.select("row.*")
