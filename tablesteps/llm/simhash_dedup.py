"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are range-partitioned and sorted by Gray rank, so that neighbours share long bit
patterns. Segments of that order get an index: a node holds the bits that all fingerprints below it
share (mask and value), and an upper node factors out what its children have in common. A search
descends from the root, adds the differing bits of each node's own mask to what the nodes above gave, and
leaves a whole group as soon as the sum is above the limit. A tree of the segments' shared patterns, of a
bounded number of nodes, first tells which segments a fingerprint has to visit; each segment is then
searched by one task.

Copies share a fingerprint, so groups of copies of any size are one entry, and a fingerprint has at most
2,080 others within two bits. A segment gives only a spanning forest of the links that it finds;
components are joined by a distributed minimum-label iteration.

Defined results: a text without words (NULL and empty included) has fingerprint zero and links like any
other; NULL ids are ignored when a component's smallest id is looked for, so that a component of
rows without ids has a NULL one; repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablesteps.llm.common import Scratch, components, named, texts

#: Fingerprints of a segment, as far as the bounds on the number of segments allow. While there are ``FEWEST`` segments, which take
#: at least ``_LEAST`` fingerprints each, the segments that a fingerprint visits do not grow with the table.
SEGMENT, _LEAST = 1 << 17, 512
FEWEST, SEGMENTS = 64, 1 << 16
_FANOUT = 8


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if set in more than half of the shingles' hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = [tokens] if len(tokens) < words else zip(*[tokens[k:] for k in range(words)])
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), seed) for x in joined], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.astype("<u8").view(np.uint8), bitorder="little").reshape(len(some), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """A tree over (mask, value) patterns in Gray order; values are zero outside their mask."""

    def __init__(self, mask: np.ndarray, value: np.ndarray):
        self.levels = [(mask.astype(np.uint64), value.astype(np.uint64))]
        while len(self.levels[-1][0]) > _FANOUT:
            below_mask, below_value = self.levels[-1]
            starts = np.arange(0, len(below_mask), _FANOUT)
            ones, zeros = (np.bitwise_and.reduceat(x, starts) for x in (below_value, below_mask & ~below_value))
            self.levels.append((ones | zeros, ones))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) whose shared bits differ in at most ``limit`` places."""
        found = [self._search(queries[at : at + 4096], at, limit) for at in range(0, len(queries), 4096)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([x[k] for x in found]) for k in (0, 1))

    def _search(self, queries: np.ndarray, first: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        query, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        above, gone = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
        for level in range(top, -1, -1):
            mask, value = self.levels[level]
            own = mask[node] & ~above  # what this node adds to the patterns above it
            gone = gone + np.bitwise_count((queries[query] ^ value[node]) & own)
            stay = gone <= limit
            query, node, gone = query[stay], node[stay], gone[stay]
            if level:
                above = np.repeat(mask[node], _FANOUT)
                children = (node[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
                query, gone = np.repeat(query, _FANOUT), np.repeat(gone, _FANOUT)
                real = children < len(self.levels[level - 1][0])
                query, node, above, gone = query[real], children[real], above[real], gone[real]
        return query + first, node


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def segments(total: int) -> int:
    """Segments of so many fingerprints."""
    return max(1, min(FEWEST, total // _LEAST), min(SEGMENTS, math.ceil(total / SEGMENT)))


def near_links(prints: DataFrame, scratch: Scratch, limit: int = 2) -> DataFrame:
    """``(a, b)``: links that join all of ``prints(fp long)``, distinct values, within ``limit`` bits.

    Not every near pair is returned, but every pair is connected through those returned.
    """
    total = prints.count()
    n = segments(total)

    def rank(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            order = (gray_rank(fp.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(order)], ["fp", "gray"])

    def number(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            at = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, at], ["fp", "gray", "segment"])

    ranked = prints.mapInArrow(rank, "fp long, gray long")
    placed = ranked.repartitionByRange(n, "gray").sortWithinPartitions("gray").mapInArrow(number, "fp long, gray long, segment int")
    placed = scratch.put(placed, "segments")
    # the pattern of each segment: a bounded number of rows
    heads = placed.groupBy("segment").agg(
        F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")
    ).orderBy("segment").collect()
    names = np.array([r.segment for r in heads], np.int32)
    ones, zeros = (np.array([r[k] for r in heads], np.int64).view(np.uint64) for k in ("ones", "zeros"))
    mask, value = ones | zeros, ones

    def route(batches):
        index = GrayIndex(mask, value)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            home = np.searchsorted(names, batch.column(2).to_numpy())
            query, leaf = index.search(fp.view(np.uint64), limit)
            later = leaf >= home[query]  # a pair of segments is searched from one side
            query, leaf = query[later], leaf[later]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[leaf]), pa.array(fp[query]), pa.array(leaf == home[query])], ["segment", "fp", "own"]
            )

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = np.sort(fp[table.column("own").to_numpy()])
        own = own[np.argsort(gray_rank(own), kind="stable")]
        index = GrayIndex(np.full(len(own), ~np.uint64(0)), own)
        query, leaf = index.search(fp, limit)
        a, b = fp[query].view(np.int64), own[leaf].view(np.int64)
        kept = _forest(a[a != b], b[a != b])
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([x for _, x in kept], pa.int64())})

    visits = placed.mapInArrow(route, "segment int, fp long, own boolean")
    return visits.groupBy("segment").applyInArrow(search, "a long, b long")


def _print_batches(batches, words: int, seed: int, text_at: int):
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        fp = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(text_at)], np.uint64).view(np.int64)
        uid = (part << 40) + row + np.arange(batch.num_rows, dtype=np.int64)
        row += batch.num_rows
        yield batch, pa.array(fp), pa.array(uid)


def component_heads(prints: DataFrame, scratch: Scratch, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(fp, head)`` for each fingerprint: the component's first row by id, as a struct. ``links`` joins distinct fingerprints."""
    head = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("uid"))
    heads = scratch.put(prints.groupBy("fp").agg(F.min(head).alias("head")), "heads")
    edges = scratch.put(links(heads.select("fp")), "links")
    stars = components(edges, scratch).select(F.col("v").alias("fp"), "root")
    joined = heads.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = joined.groupBy("root").agg(F.min("head").alias("head"))
    return scratch.put(joined.select("fp", "root").join(low, "root").select("fp", "head"), "components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, limit: int = 2
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = texts(docs, id_col, text_col)

    def run(batches):
        for batch, fp, uid in _print_batches(batches, words, seed, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, uid], ["doc_id", "fp", "uid"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = scratch.put(rows.mapInArrow(run, f"doc_id {kind}, fp long, uid long"), "prints")
    parts = component_heads(prints, scratch, lambda fps: near_links(fps, scratch, limit)).select("fp", F.col("head.doc_id").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(parts, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, limit: int = 2
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all its columns kept."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"), named(docs, id_col).alias("doc_id"), named(docs, text_col).alias("text"))

    def run(batches):
        for batch, fp, uid in _print_batches(batches, words, seed, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, uid], ["row", "doc_id", "fp", "uid"])

    kinds = [rows.schema["row"], rows.schema["doc_id"], StructField("fp", LongType()), StructField("uid", LongType())]
    held = scratch.put(rows.mapInArrow(run, StructType(kinds)), "rows")
    prints = held.select("doc_id", "fp", "uid")
    parts = component_heads(prints, scratch, lambda fps: near_links(fps, scratch, limit))
    gone = prints.join(parts, "fp").where("uid <> head.uid").select("uid")
    return held.join(gone, "uid", "left_anti").select("row.*")
