"""Embedding near-duplicates: ITQ codes, multi-index Hamming tables, reranking with the vectors.

Iterative quantisation learns rotations on a bounded sample: unit vectors are centred, projected on their
principal axes and rotated so that signs lose least; several rotations fill the code where the vectors have
fewer dimensions than it has bits. A code is cut into tables of about log2(n) bits. Two vectors are
candidates if they differ in at most ``flips`` bits of some table and in at most ``radius`` bits in all; both
limits are set on the sample, from pairs built to lie exactly at the least cosine, so that the share of such
pairs that is found is at least ``recall``. Nearer pairs are found more often.

A table is dealt by its leading bits into shards. A vector visits the shards within ``flips`` leading bits
(from one side only); inside a shard it looks up all values within the bits left. A pair counts in the first
table that can find it, so no list of pairs is ever made: a first pass over codes alone tells which vectors
have candidates in which shard, only these vectors are sent there, and the second pass gives each vector's
number of links and a spanning forest of the links. Shards with too many members are split: members are
dealt over parts, and each pair of parts is a task.

Defined results: equal vectors are one class, however many rows; vectors that are NULL, empty, zero or hold
NULL or non-finite entries, or that have another length than the commonest (of equally common ones the longer),
link with nothing and are their own component; NULL ids are ignored where the smallest id is looked for, and are
never kept; repeated rows count as other vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, components, named

#: Vectors that the rotations and limits are learned from, at most.
SAMPLE = 4096
#: Own vectors of a shard, about; members of a part of a split shard.
SHARD, PART = 2048, 8192
_PAIRS = 1 << 18


@dataclass(frozen=True)
class Codes:
    """Hash functions and limits; the size depends on dimensions and bits only."""

    mean: np.ndarray
    planes: np.ndarray  # dimensions x (tables * width)
    tables: int
    width: int
    flips: int
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """``codes[vector, table]``, each of ``width`` bits."""
        bits = ((unit(vectors) - self.mean) @ self.planes > 0).reshape(len(vectors), self.tables, self.width)
        return (bits @ (1 << np.arange(self.width, dtype=np.int64))).astype(np.uint32)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotation(projected: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Turns the code's cube until its corners are nearest to the projected vectors."""
    turn = np.linalg.qr(rng.normal(size=(projected.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return turn


def learn(sample: np.ndarray, total: int, least: float, bits: int, recall: float) -> Codes:
    """Hash functions and limits for ``total`` vectors from a sample of them."""
    rng = np.random.default_rng(0)
    sample = unit(sample)
    mean = sample.mean(axis=0)
    axes = np.linalg.eigh(np.cov((sample - mean).T, bias=True).reshape(len(mean), -1))[1][:, ::-1][:, :bits]
    projected = (sample - mean) @ axes
    planes = np.hstack([axes @ rotation(projected, rng) for _ in range(math.ceil(bits / axes.shape[1]))])
    width = min(24, max(8, math.ceil(math.log2(max(2, total)))))
    tables = bits // width
    codes = Codes(mean, planes[:, : tables * width], tables, width, 0, 0)
    # partners exactly at the least cosine, in random directions
    base = np.tile(sample, (math.ceil(2048 / len(sample)), 1))
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    partner = least * base + math.sqrt(max(0.0, 1 - least * least)) * noise / np.where(length > 0, length, 1)
    apart = np.bitwise_count(codes.encode(base) ^ codes.encode(partner)).astype(int)
    radius = int(np.quantile(apart.sum(axis=1), 0.995, method="higher"))
    nearest = np.where(apart.sum(axis=1) <= radius, apart.min(axis=1), width + 1)
    flips = next((k for k in range(width) if (nearest <= k).mean() >= recall), width)
    return Codes(mean, codes.planes, tables, width, flips, radius)


def within(bits: int, limit: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``limit`` set, the empty one first."""
    masks = [0]
    rows = [(0, 0)]
    for _ in range(min(limit, bits)):
        rows = [(mask | 1 << b, b + 1) for mask, first in rows for b in range(first, bits)]
        masks += [mask for mask, _ in rows]
    return np.array(masks, np.uint32)


def candidates(codes: Codes, table: int, lead: int, shard: int, code: np.ndarray, part: np.ndarray, across: bool):
    """Batches (a, b) of members of a shard that are candidates, each pair once.

    ``lead`` leading bits name the shard; members that lie in it are its own, others visit. ``across``: only pairs of
    different ``part``.
    """
    low = codes.width - lead
    value = code[:, table]
    away = np.bitwise_count((value >> np.uint32(low)) ^ np.uint32(shard))
    rest = (value & np.uint32((1 << low) - 1)).astype(np.int64)
    own = np.flatnonzero(away == 0)
    own = own[np.argsort(rest[own], kind="stable")]
    starts = np.searchsorted(rest[own], np.arange((1 << low) + 1))
    for distance in range(codes.flips + 1):
        asking = np.flatnonzero(away == distance)
        if not len(asking):
            continue
        for mask in within(low, codes.flips - distance).tolist():
            bucket = rest[asking] ^ mask
            first, count = starts[bucket], starts[bucket + 1] - starts[bucket]
            query, first, count = asking[count > 0], first[count > 0], count[count > 0]
            ends = np.cumsum(count)
            at = 0
            while at < len(query):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
                size = count[at:to]
                a = np.repeat(query[at:to], size)
                b = own[np.repeat(first[at:to], size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)]
                at = to
                stay = (away[a] > 0) | (a < b)
                if across:
                    stay &= part[a] != part[b]
                a, b = a[stay], b[stay]
                apart = np.bitwise_count(code[a] ^ code[b])
                stay = (apart.sum(axis=1) <= codes.radius) & ~(apart[:, :table] <= codes.flips).any(axis=1)
                yield a[stay], b[stay]


class Forest:
    """A spanning forest of links that come in batches."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.root[a], self.root[b]
            new = p != q
            a, b, p, q = a[new], b[new], np.maximum(p, q)[new], np.minimum(p, q)[new]
            if not len(a):
                return
            up, at = np.unique(p, return_index=True)  # each root is hung below a smaller one, so there are no rings
            self.edges.append((a[at], b[at]))
            self.root[up] = q[at]
            while (further := self.root[self.root] != self.root).any():
                self.root[further] = self.root[self.root[further]]


def _shards(coded: DataFrame, codes: Codes, lead: int) -> DataFrame:
    """``(shard, cid, code, part, i, j)``: members of the tasks; tasks of a split shard are pairs (i, j) of parts."""
    low = codes.width - lead

    def visit(batches):
        masks = within(lead, codes.flips)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, codes.tables)
            for table in range(codes.tables):
                home = code[:, table] >> np.uint32(low)
                goal = home[:, None] ^ masks
                row, k = np.nonzero(goal >= home[:, None])
                shard = goal[row, k].astype(np.int64) + (table << lead)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["shard", "cid", "code"])

    rows = coded.select("cid", "code").mapInArrow(visit, "shard long, cid long, code binary")
    hot = rows.groupBy("shard").count().where(F.col("count") > PART)
    hot = hot.select("shard", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = rows.join(hot, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("shard", "cid", "code", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))


def _pairs(table: pa.Table, codes: Codes, lead: int):
    """Candidates of a task, by the places of its rows."""
    shard, i, j = (table.column(c)[0].as_py() for c in ("shard", "i", "j"))
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint32).reshape(-1, codes.tables)
    return candidates(codes, shard >> lead, lead, shard & ((1 << lead) - 1), code, table.column("part").to_numpy(), i < j)


def links(classes: DataFrame, total: int, scratch: Scratch, least: float, bits: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """``(cid, n_links)`` and ``edges(a, b)`` of ``classes(cid, vector, size, ...)``; the edges join all that links join."""
    sample = classes.orderBy(F.xxhash64("vector"), "cid").limit(SAMPLE).select("vector").collect()
    codes = learn(np.array([r.vector for r in sample], float), total, least, bits, recall)
    lead = min(codes.width, max(0, math.ceil(math.log2(total / SHARD))))
    kind = classes.schema["vector"].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                code = [x.tobytes() for x in codes.encode(vectors)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary())], ["cid", "vector", "size", "code"])

    coded = scratch.put(classes.select("cid", "vector", "size").mapInArrow(encode, f"cid long, vector {kind}, size long, code binary"), "codes")

    def first(table: pa.Table) -> pa.Table:
        met = np.zeros(table.num_rows, bool)
        for a, b in _pairs(table, codes, lead):
            met[a] = met[b] = True
        return table.select(["shard", "cid", "part", "i", "j"]).filter(pa.array(met))

    def second(table: pa.Table) -> pa.Table:
        vectors = unit(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))
        cid, size = table.column("cid").to_numpy(), table.column("size").to_numpy()
        count, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
        step = max(1, (1 << 22) // vectors.shape[1])
        for a, b in _pairs(table, codes, lead):
            for at in range(0, len(a), step):
                p, q = a[at : at + step], b[at : at + step]
                near = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= least
                p, q = p[near], q[near]
                np.add.at(count, p, size[q]), np.add.at(count, q, size[p])
                forest.add(p, q)
        some = np.flatnonzero(count)
        a, b = (np.concatenate([x[k] for x in forest.edges] or [some[:0]]) for k in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([cid[some], cid[a]])), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[b])]),
            "w": pa.concat_arrays([pa.array(count[some]), pa.nulls(len(a), pa.int64())]),
        })

    task = ["shard", "i", "j"]
    met = _shards(coded, codes, lead).groupBy(*task).applyInArrow(first, "shard long, cid long, part int, i int, j int")
    met = scratch.put(met, "met").join(coded, "cid")
    found = scratch.put(met.groupBy(*task).applyInArrow(second, "a long, b long, w long"), "found")
    counts = found.where("w is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("n_links"))
    return counts, found.where("b is not null").select("a", "b")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, bits: int = 128, recall: float = 0.97) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    scratch = Scratch(rows.sparkSession, "embeddings")
    vector = F.col("vector")
    fine = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector, lambda c: c != 0)
    rows = rows.select(named(rows, id_col).alias("vec_id"), named(rows, vec_col).alias("vector"))
    rows = rows.withColumn("d", F.when(fine, F.size(vector)))
    common = rows.where("d is not null").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = F.coalesce(F.col("d") == (common.d if common else 0), F.lit(False))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if common is None:
        return alone
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]  # 128 bits name a class
    classes = rows.where(usable).groupBy("vector").agg(F.count("*").alias("size"), F.min("vec_id").alias("low"))
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("cid"), "vector", "size", "low", *keys), "classes")
    counts, edges = links(classes, classes.count(), scratch, least, bits, recall)
    stars = components(edges, scratch).select(F.col("v").alias("cid"), "root")
    told = classes.select("cid", "size", "low", "k1", "k2").join(counts, "cid", "left").join(stars, "cid", "left")
    told = scratch.put(told.select("k1", "k2", "low", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "told")
    low = told.groupBy("root").agg(F.min("low").alias("component_id"))
    told = told.join(low, "root").select("k1", "k2", "n_links", "component_id")
    linked = rows.where(usable).select("vec_id", *keys).join(told, ["k1", "k2"])
    linked = linked.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)
