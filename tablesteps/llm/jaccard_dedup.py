"""Near-duplicates by SimHash fingerprints of five-word shingles, made exact by their Jaccard similarity.

First the SimHash operator's search: fingerprints within ``BITS`` bits meet through its Gray-order index, and texts that meet are
linked if their sets are similar enough. A pair at the least similarity lies about ten bits apart, where no
index of 64 bits can leave anything out, so the pairs that lie further apart than the index reaches follow by a prefix filter.

Two sets of shingles whose similarity is at least ``least`` share a shingle among the first
``n - ceil(least * n) + 1`` of each, in whatever order all sets are sorted. So only those prefixes are
shuffled, and every pair that is near enough meets in the bucket of some shingle: nothing is lost to
a radius or a sketch. The order puts shingles that a sample of the texts shows often last, which
keeps buckets small; it changes the cost, not the result. The first shingle that two sets share also bounds what they can
share: nothing before its place in either. Each entry of a bucket tells the largest set that can be near if its shingle is that first one,
and two entries meet only if neither set is larger than the other allows. Copies that share all but their own few shingles,
yet too few, so never become pairs.

Each pair that meets is compared with all its shingles before it is linked. Texts of one set of shingles are
one entry. Buckets that lie in one component after the search are left out. Where buckets are still large, each entry is
compared with one pivot of its bucket, at first the one with the fewest shingles of its own, and buckets that lie in one component by then are left out too; pairs of different
components that still meet are all compared. Components are those of ``simhash_dedup``.

Defined results: shingles are compared by their XXH64, and sets pass for equal by an XXH64 of those; a text of
fewer than five words is one shingle; texts without words (NULL and empty included) are near to each other only; of a
component the row with the smallest id stays, NULL ids last; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablesteps.llm.common import Scratch, components, give_back, named, small_batches
from tablesteps.llm.simhash_dedup import component_heads, majority, near_links

WORDS = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Bits within which the index looks for fingerprints.
BITS = 3
#: One text of ``_SAMPLE`` is looked at for frequent shingles; those seen ``_OFTEN`` times there come last.
_SAMPLE, _OFTEN, _MOST = 8, 8, 1 << 17
#: Entries of a range of hashes, which one task gathers.
_RANGE = 1 << 18
#: Pivots are used while the pairs left are more than this many times the entries and each round halves them, for so many rounds at most.
_PAIRS, _ROUNDS = 1, 8
#: Shingles of the sets that a comparing task keeps.
_KEPT = 1 << 21


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def shingles(text: str | bytes | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    raw = text if isinstance(text, bytes) else _raw(text)
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = [tokens] if len(tokens) < words else zip(*[tokens[k:] for k in range(words)])
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), seed) for x in joined], np.uint64))


def prefix(found: np.ndarray, often: np.ndarray, seen: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The first shingles of a set; ``often`` (sorted) were seen ``seen`` times and come last."""
    n = len(found)
    if not n:
        return found
    count = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        count = np.where(often[at] == found, seen[at], 0)
    return found[np.lexsort((found, count))[: n - -(-n * least[0] // least[1]) + 1]]


def near(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """True if two sets, sorted, are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


def _frequent(held: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            found = [shingles(x.as_py(), words, seed) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["s"])
        give_back()

    some = held.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    top = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= _OFTEN).orderBy(F.desc("n"), "s").limit(_MOST).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _verified(pairs: DataFrame, packed: DataFrame, words: int, seed: int, least: tuple[int, int]) -> DataFrame:
    """Those pairs whose whole sets, made again from the packed texts, are similar enough.

    A task keeps the sets that it made last, up to a number of shingles: pairs come sorted by one side.
    """

    def run(batches):
        made: dict[int, np.ndarray] = {}
        held = 0

        def of(fp: int, packed: pa.Scalar) -> np.ndarray:
            nonlocal held
            found = made.get(fp)
            if found is None:
                found = shingles(zlib.decompress(packed.as_py()), words, seed)
                if held + len(found) > _KEPT:
                    made.clear()
                    held = 0
                made[fp] = found
                held += len(found)
            return found

        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            good = [near(of(i, x), of(j, y), least) for i, j, x, y in zip(a, b, batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        made.clear()
        give_back()

    first, second = (packed.select(F.col("fp").alias(k), F.col("text").alias(f"of_{k}")) for k in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _met(left: DataFrame, right: DataFrame, differ: str) -> DataFrame:
    """Distinct pairs (a, b) in one bucket, of sizes and places of the shingle that allow the similarity."""
    both = left.alias("l").join(right.alias("r"), F.col("l.s") == F.col("r.s")).where(differ).where("l.n <= r.most and r.n <= l.most")
    return both.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()


def _mixed(buckets: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, float, int]:
    """The rows of buckets that hold several components, the pairs left in them, and the number of those rows."""
    per = buckets.groupBy("s", "c").agg(F.count("*").cast("double").alias("k")).groupBy("s").agg(
        F.sum("k").alias("k"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs")
    ).where("pairs > 0")
    per = scratch.put(per, f"shared-{name}")
    rows, pairs = per.agg(F.sum("k"), F.sum("pairs")).first()
    return scratch.put(buckets.join(per.select("s"), "s"), f"buckets-{name}"), pairs or 0.0, int(rows or 0)


def _met_by_print(held: DataFrame, scratch: Scratch, bits: int, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) that the Gray-order index brings together, of sizes that allow the similarity.

    Sets of one fingerprint meet the smallest of them, and those smallest ones meet along the links of the fingerprints.
    """
    sets = scratch.put(held.select("print", "fp", "n").distinct(), "prints")
    heads = scratch.put(sets.groupBy("print").agg(F.min(F.struct("fp", "n")).alias("h")).select("print", "h.*"), "print-heads")
    links = near_links(heads.select(F.col("print").alias("fp")), scratch, bits)
    first, second = (heads.select(F.col("print").alias(k), F.struct("fp", "n").alias(f"of_{k}")) for k in "ab")
    other = links.join(first, "a").join(second, "b").select(F.col("of_a").alias("l"), F.col("of_b").alias("r"))
    same = sets.alias("s").join(heads.alias("h"), "print").where("s.fp <> h.fp").select(F.struct("s.fp", "s.n").alias("l"), F.struct("h.fp", "h.n").alias("r"))
    low, high = F.least("l.n", "r.n"), F.greatest("l.n", "r.n")
    both = same.unionByName(other).where(low * least[1] >= high * least[0])
    return both.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()


def _dealt(fp: np.ndarray, firsts: list[np.ndarray], n: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """A row per range of hashes: its shingles, the places in ``fp`` and ``n`` of the texts that they are from, and 256ths of the prefix before them."""
    s = np.concatenate([*firsts, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(fp), dtype=np.uint32), [len(x) for x in firsts])
    at = np.concatenate([*[np.arange(len(x)) * 256 // len(x) for x in firsts if len(x)], np.zeros(0, np.int64)]).astype(np.uint8)
    order = np.argsort(s, kind="stable")
    ends = np.searchsorted(s[order], cuts)
    rows = [(k, s[x], *_from(of[x], fp, n), at[x]) for k, x in enumerate(np.split(order, ends)) if len(x)]
    columns = [[r[k] if not k else r[k].tobytes() for r in rows] for k in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "s", "of", "fp", "n", "at"])


def _from(of: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    used, place = np.unique(of, return_inverse=True)
    return place.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32), fp[used], n[used].astype(np.int32)


def largest(n: np.ndarray, at: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The largest size of a set that can be near one of size ``n`` if a shingle with ``at`` 256ths of the prefix before it is the first they share."""
    n = n.astype(np.int64)
    before = -(-at.astype(np.int64) * (n - -(-n * least[0] // least[1]) + 1) // 256)
    return ((sum(least) * (n - before)) // least[0] - n).astype(np.int32)


def _shared(table: pa.Table, least: tuple[int, int] = LEAST) -> pa.Table:
    """The entries of one range whose shingle lies in the prefixes of several sets, of sizes that can be near."""
    all_s, all_fp, all_n, all_most = [], [], [], []
    for s, of, fp, n, at in zip(*[table.column(c).to_pylist() for c in ("s", "of", "fp", "n", "at")]):
        s, fp, n = (np.frombuffer(x, t) for x, t in ((s, np.uint64), (fp, np.int64), (n, np.int32)))
        of = np.frombuffer(of, np.uint16 if len(fp) <= 1 << 16 else np.uint32)
        all_s.append(s)
        all_fp.append(fp[of])
        all_n.append(n[of])
        all_most.append(largest(all_n[-1], np.frombuffer(at, np.uint8), least))
    s, fp, n, most = map(np.concatenate, (all_s, all_fp, all_n, all_most))
    order = np.lexsort((fp, s))
    s, fp, n, most = s[order], fp[order], n[order], most[order]
    new = np.append(True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1]))
    s, fp, n, most = s[new], fp[new], n[new], most[new]
    size = 0
    while size != len(s):  # an entry that allows no size of its bucket goes, and may take others along
        size = len(s)
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if size else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, size))
        if size:
            low, high = np.repeat(np.minimum.reduceat(n, starts), many), np.repeat(np.maximum.reduceat(most, starts), many)
            kept = (np.repeat(many, many) > 1) & (low <= most) & (n <= high)
            s, fp, n, most = s[kept], fp[kept], n[kept], most[kept]
    give_back()
    return pa.table({"s": pa.array(s.view(np.int64)), "fp": pa.array(fp), "n": pa.array(n), "most": pa.array(most)})


def jaccard_links(held: DataFrame, scratch: Scratch, words: int = WORDS, seed: int = 42, least: tuple[int, int] = LEAST, bits: int = BITS) -> DataFrame:
    """``(a, b)``: links that join all of ``held(fp, uid, n, print, text)`` that are similar enough; each is a near pair."""
    done = scratch.put(_met_by_print(held, scratch, bits, least), "pairs-by-print")
    scratch.drop("segments", "prints", "print-heads")
    often, seen = _frequent(held, words, seed)

    many = held.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-many * (least[1] - least[0]) // (least[1] * _RANGE)))
    cuts = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)

    def enter(batches):
        for batch in batches:
            firsts = [prefix(shingles(x.as_py(), words, seed), often, seen, least) for x in batch.column(1)]
            yield _dealt(batch.column(0).to_numpy(), firsts, batch.column(2).to_numpy(), cuts)
        give_back()

    dealt = held.select("fp", "text", "n").mapInArrow(enter, "part int, s binary, of binary, fp binary, n binary, at binary")
    found = dealt.groupBy("part").applyInArrow(lambda table: _shared(table, least), "s long, fp long, n int, most int")
    buckets = scratch.put(found, "entries").withColumn("c", F.col("fp"))
    buckets, left, size = _mixed(buckets, scratch, "start")
    scratch.drop("entries")
    if not left:
        return held.sparkSession.createDataFrame([], "a long, b long")

    def pack(batches):
        for batch in batches:
            texts = [zlib.compress(_raw(x.as_py()), 6) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["uid", "fp", "text"])
        give_back()

    asked = buckets.select("fp").distinct()
    chosen = scratch.put(held.select("fp", "uid").join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("uid").alias("uid")).select("uid"), "chosen")
    every = held.select("uid", "fp", "text").mapInArrow(pack, "uid long, fp long, text binary")
    packed = scratch.put(every.join(chosen, "uid", "left_semi").select("fp", "text"), "packed")
    scratch.drop("chosen", "shared-start")

    last = "start"

    def joined(name: str) -> None:
        """Components by the links so far, and what is left of the buckets."""
        nonlocal buckets, left, size, last
        stars = scratch.put(components(edges, scratch), f"roots-{name}")
        told = buckets.join(stars, F.col("fp") == F.col("v"), "left").select("s", "fp", "n", "most", F.coalesce("root", "fp").alias("c"))
        buckets, left, size = _mixed(told, scratch, name)
        scratch.drop(f"buckets-{last}", f"shared-{name}")
        last = name

    # sets that are similar enough share a bucket: what the index found outside the buckets has no packed text and falls away
    edges = scratch.put(_verified(done, packed, words, seed, least), "edges-by-print")
    joined("by-print")
    before = float("inf")
    for turn in range(_ROUNDS):
        if left <= _PAIRS * size or left > before / 2:
            break
        before = left
        # the entry whose shingle comes earliest: at first of the bucket, then of some component
        order = F.struct(F.xxhash64("c", F.lit(turn)) if turn else F.lit(0), -F.col("most") / F.col("n"), F.col("fp"))
        pivots = buckets.groupBy("s").agg(F.min_by(F.struct("fp", "n", "most", "c"), order).alias("p")).select("s", "p.*")
        pairs = scratch.put(_new(_met(buckets, pivots, "l.c <> r.c"), done), f"pairs-{turn}")
        done = done.unionByName(pairs)
        edges = scratch.put(edges.unionByName(_verified(pairs, packed, words, seed, least)), f"edges-{turn}")
        joined(str(turn))
    pairs = scratch.put(_new(_met(buckets, buckets, "l.c < r.c"), done), "pairs")
    return edges.unionByName(_verified(pairs, packed, words, seed, least))


def _new(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done, ["a", "b"], "left_anti")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = 42, least: tuple[int, int] = LEAST
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all its columns kept."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"), named(docs, id_col).alias("doc_id"), named(docs, text_col).alias("text"))

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            found = [shingles(x.as_py(), words, seed) for x in batch.column(2)]
            fp = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), seed) for x in found], np.uint64).view(np.int64)
            uid = (part << 40) + row + np.arange(batch.num_rows, dtype=np.int64)
            row += batch.num_rows
            size = pa.array([len(x) for x in found], pa.int32())
            print_ = np.array([majority(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(uid), size, pa.array(print_)], ["row", "doc_id", "fp", "uid", "n", "print"])
        give_back()

    kinds = [rows.schema["row"], rows.schema["doc_id"], StructField("fp", LongType()), StructField("uid", LongType()), StructField("n", IntegerType()), StructField("print", LongType())]
    with small_batches(docs.sparkSession):
        held = scratch.put(rows.mapInArrow(run, StructType(kinds)), "rows")
        prints = held.select("doc_id", "fp", "uid")
        inner = held.select("fp", "uid", "n", "print", F.col("row").getField(text_col).alias("text"))
        parts = component_heads(prints, scratch, lambda _: jaccard_links(inner, scratch, words, seed, least))
    gone = prints.join(parts, "fp").where("uid <> head.uid").select("uid")
    return held.join(gone, "uid", "left_anti").select("row.*")
