"""Where do two keyed tables differ: a tree of summed row digests over key ranges, descended only where it must be.

A node is a range of keys of one period; its digest is the sum of its rows' digests, so nodes are made in one
aggregate with map-side sums, whatever the order of the rows. The first level is made from all rows. Only
ranges whose sums differ are read again, for the next level, and only rows of the last level's differing ranges
are left for a comparison row by row. With a whole-number key the ranges are intervals of it, and the re-reads
carry them as plain filters that reach the files; with any other key they are ranges of the key's hash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.session import stage

#: Ranges that a node is cut into, and levels below the root.
FANOUT, DEPTH = 256, 2
#: Intervals that a filter lists; further ones are merged with their nearest neighbours.
FILTERS = 100


@dataclass(frozen=True)
class KeyRanges:
    """Equal-width ranges of the first whole-number key, or of all keys' hash."""

    key: str | None
    low: int
    width: int

    def node(self, keys: Sequence[Column], level: int) -> Column:
        """Number of a row's range at a level; rows without the key are range -1. ``keys`` are normalised."""
        if self.key is None:
            return F.shiftrightunsigned(F.xxhash64(*keys), 64 - 8 * level)
        part = self.size(level)
        place = F.col(self.key).cast("decimal(20,0)") - F.lit(self.low).cast("decimal(20,0)")
        return F.coalesce(F.floor(place / F.lit(part).cast("decimal(20,0)")).cast("long"), F.lit(-1))

    def size(self, level: int) -> int:
        return max(1, -(-self.width // FANOUT**level))

    def filter(self, nodes: list[int], level: int) -> Column | None:
        """A condition that holds for all rows of ``nodes`` (sorted), and for few others."""
        if self.key is None or not nodes:
            return None
        spans: list[list[int]] = []
        for n in (n for n in nodes if n >= 0):
            if spans and n <= spans[-1][1] + 1:
                spans[-1][1] = n
            else:
                spans.append([n, n])
        while len(spans) > FILTERS:
            gaps = [(b[0] - a[1], k) for k, (a, b) in enumerate(zip(spans, spans[1:]))]
            for _, k in sorted(sorted(gaps)[: len(spans) - FILTERS], key=lambda g: -g[1]):
                spans[k : k + 2] = [[spans[k][0], spans[k + 1][1]]]
        part = self.size(level)
        cond = F.col(self.key).isNull() if nodes[0] < 0 else F.lit(False)
        for first, last in spans:
            cond = cond | F.col(self.key).between(self.low + first * part, min(self.low + (last + 1) * part - 1, (1 << 63) - 1))
        return cond


def key_ranges(ref: DataFrame, gen: DataFrame, keys: Sequence[str]) -> KeyRanges:
    """Bounds come from one scan of the key column."""
    whole = [k for k in keys if all(isinstance(d.schema[k].dataType, T.IntegralType) for d in (ref, gen))]
    if not whole:
        return KeyRanges(None, 0, 0)
    key = whole[0]
    both = ref.select(F.col(key).cast("long").alias("k")).unionByName(gen.select(F.col(key).cast("long").alias("k")))
    low, high = both.agg(F.min("k"), F.max("k")).first()
    return KeyRanges(key, low or 0, (high or 0) - (low or 0) + 1)


def _nodes(sides: Sequence[DataFrame], period: Column, ranges: KeyRanges, keys: Sequence[str], level: int, values: Sequence[Mapping[str, Column]]) -> DataFrame:
    """``(_p, _node)`` of the ranges whose counts or sums of digests differ."""
    parts = []
    for rows, sign, cols in zip(sides, (1, -1), values, strict=True):
        each = [cols[c] for c in sorted(cols)]
        filled = [F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in each]), *each]  # a missing value leaves a hash as it was
        digest = [F.xxhash64(F.lit(seed), *filled).cast("decimal(20,0)") * sign for seed in (1, 2)]  # 128 bits
        node = ranges.node([cols[k] for k in keys], level)
        parts.append(rows.select(period.alias("_p"), node.alias("_node"), F.lit(sign).alias("_n"), digest[0].alias("_a"), digest[1].alias("_b")))
    sums = parts[0].unionByName(parts[1]).groupBy("_p", "_node").agg(F.sum("_n").alias("_n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return sums.filter("_n <> 0 OR _a <> 0 OR _b <> 0").select("_p", "_node")


def differing_rows(
    ref: DataFrame, gen: DataFrame, period: Column, keys: Sequence[str], values: Sequence[Mapping[str, Column]]
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in ranges that differ; everything left out is equal on both sides.

    ``values`` gives for ``ref`` and for ``gen`` the compared columns, keys included, normalised and of one type
    by name. Missing periods and keys are ranges of their own.
    """
    ranges = key_ranges(ref, gen, keys)
    sides = [ref, gen]
    for level in range(1, DEPTH + 1):
        found = stage(_nodes(sides, period, ranges, keys, level, values), "ranges")
        numbers = [r[0] for r in found.select("_node").distinct().orderBy("_node").collect()] if ranges.key else []  # FANOUT ** level at most
        near = ranges.filter(numbers, level)
        for k, cols in enumerate(values):
            rows = sides[k] if near is None else sides[k].filter(near)
            node = ranges.node([cols[c] for c in keys], level)
            sides[k] = rows.join(found, period.eqNullSafe(found["_p"]) & (node == found["_node"]), "left_semi")
    return sides[0], sides[1]
