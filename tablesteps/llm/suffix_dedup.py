"""Removal of repeated long strings by a logarithmic family of sparse suffix arrays.

A string of ``length`` bytes (a window) is found through its anchor: of the ``lead``-byte strings in it
the one with the smallest hash. Equal windows have equal anchors, and consecutive windows share one, so a
text's suffixes need be indexed only where the anchor changes: one entry for a run of windows. An entry holds
the hash of its anchor, by which the array is sorted, and that of the run's bytes.

The corpus is cut into batches. Each batch gives a sorted array; a family of arrays holds them in levels, and
two levels of one size are merged into one of twice the size. Every text is then merge-scanned against all
levels. A run whose bytes are found twice is repeated as a whole. A run whose anchor is found only with itself
is new. Where the same anchor is found with other bytes around it, the run's windows are compared one by one
through their own hashes in the same way. Lexicographic order inside the arrays is not needed, as only
equality of ``length`` bytes or more counts.

Texts are kept in blocks of some megabytes. A block asks each range of hashes once for everything it holds and is
answered in its own order, so a string that a third of all texts share is one number per block. Hashes are 64 bits
of a polynomial with random coefficients: two unlike windows pass for equal with a chance of about n*n/2**65
for n windows that are compared one by one.

Defined results: a NULL or empty text has no bytes and no spans; texts shorter than ``length`` are kept whole;
repeated rows repeat each other and are removed like any other copies; ids are passed through, NULL too; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, texts

#: Bytes of text in a block, bytes of an anchor, batches of a corpus that is indexed at once.
BLOCK = 8_000_000
LEAD = 100
BATCHES = 4

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 17)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[k] = np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64)), dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    powers, _ = _power(len(raw))
    return np.append(np.uint64(0), np.cumsum(_BYTES[raw] * powers[: len(raw)], dtype=np.uint64))


def substring_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, inverse = _power(len(prefix))
    return _mix((prefix[stop] - prefix[start]) * inverse[start])


def _sliding(x: np.ndarray, width: int, over: np.ufunc, fill: int) -> np.ndarray:
    """``over`` of each ``width`` neighbours: from the left and right parts of blocks of that width."""
    n = len(x)
    padded = np.append(x, np.full(-n % width, fill, np.uint64)).reshape(-1, width)
    left = over.accumulate(padded, axis=1).ravel()
    right = over.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return over(right[: n - width + 1], left[width - 1 : n])


def runs(raw: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a text with one anchor: anchor, hash of all bytes, first and last window, and whether
    the anchor comes more than once in the text."""
    if len(raw) < length:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(bool)
    prefix = sums(raw)
    at = np.arange(len(raw) - lead + 1)
    hashes = substring_hash(prefix, at, at + lead)
    width = length - lead + 1
    low = _sliding(hashes, width, np.minimum, 2**64 - 1)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    last = np.append(first[1:], len(low)) - 1
    # places that are the smallest of some window; an anchor with two of them may repeat inside one run
    edge = np.zeros(width - 1, np.uint64)
    smallest = hashes == _sliding(np.concatenate([edge, low, edge]), width, np.maximum, 0)
    values, times = np.unique(hashes[smallest], return_counts=True)
    anchor = low[first]
    again = np.isin(anchor, values[times > 1])
    whole = _mix(substring_hash(prefix, first, last + length) + (last - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return _mix(anchor), whole, first, last, again


def _planes(x: np.ndarray, size: int = 8) -> bytes:
    """Numbers with equal bytes of all of them together, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:size]).tobytes()


def _numbers(raw: bytes, size: int = 8) -> np.ndarray:
    wide = np.zeros((8, len(raw) // size), np.uint8)
    wide[:size] = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(wide.T).view("<u8").ravel()


def _sorted_planes(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _sorted_numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw), dtype=np.uint64)


def _distinct(keys: np.ndarray, more: np.ndarray, times: np.ndarray):
    """Distinct (key, more) in order, their times added up, and the place of each input among them."""
    if not len(keys):
        return keys, more, times, np.zeros(0, np.int64)
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    new = np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]))
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[starts], m[starts], np.minimum(np.add.reduceat(times[order], starts), 255), place


_BLOCK_ROW = "block long, ids array<{kind}>, sizes array<int>, text binary, anchors binary, wholes binary, firsts binary, lasts binary, owners binary, again binary"
_ENTRIES = "bucket int, block long, keys binary, more binary, times binary"


def _blocks(docs: DataFrame, kind: str, length: int, lead: int) -> DataFrame:
    """Blocks of ``docs(doc_id, text)``: compressed texts and the runs of all their windows."""

    def run(batches):
        part, seq, ids, raws, held = TaskContext.get().partitionId(), 0, [], [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def close():
            found = [runs(np.frombuffer(r, np.uint8), length, lead) for r in raws]
            anchor, whole, first, last, again = (np.concatenate([f[k] for f in found]) for k in range(5))
            owner = np.repeat(np.arange(len(raws)), [len(f[0]) for f in found])
            parts = [_planes(anchor), _planes(whole), _planes(first, 4), _planes(last - first, 4), _planes(np.diff(owner, prepend=0), 4), np.packbits(again).tobytes()]
            row = [[part << 32 | seq], [ids], [[len(r) for r in raws]], [pack.compress(b"".join(raws))], *[[p] for p in parts]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        names = ["block", "ids", "sizes", "text", "anchors", "wholes", "firsts", "lasts", "owners", "again"]
        for batch in batches:
            types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int32()), *[pa.binary()] * 7]
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                raws.append(text.encode("utf-8", "surrogatepass"))
                ids.append(doc_id)
                held += len(raws[-1]) + 32
                if held >= BLOCK:
                    yield close()
                    seq, ids, raws, held = seq + 1, [], [], 0
        if raws:
            yield close()

    return docs.mapInArrow(run, _BLOCK_ROW.format(kind=kind))


class _Held:
    """A block read back: its texts when asked for, and its runs."""

    def __init__(self, row: dict):
        self.block, self.sizes = row["block"], np.array(row["sizes"], np.int64)
        self.anchor, self.whole = _numbers(row["anchors"]), _numbers(row["wholes"])
        self.first = _numbers(row["firsts"], 4).astype(np.int64)
        self.last = self.first + _numbers(row["lasts"], 4).astype(np.int64)
        self.owner = np.cumsum(_numbers(row["owners"], 4).astype(np.int64))
        self.again = np.unpackbits(np.frombuffer(row["again"], np.uint8))[: len(self.anchor)].astype(bool)
        self._packed = row.get("text")

    def entries(self):
        return _distinct(self.anchor, self.whole, np.ones(len(self.anchor), np.int64))

    def raws(self) -> list[np.ndarray]:
        whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._packed), np.uint8) if self.sizes.sum() else np.zeros(0, np.uint8)
        return np.split(whole, np.cumsum(self.sizes)[:-1])

    def windows(self, raws: list[np.ndarray], repeated: np.ndarray, shared: np.ndarray, length: int):
        """Windows to be compared one by one: their text, place and hash, and in how many places each is known."""
        single = shared | self.again
        texts_, places, hashes, times = [], [], [], []
        for doc in np.unique(self.owner[single]):
            low, high = np.searchsorted(self.owner, (doc, doc + 1))
            mine = low + np.flatnonzero(single[low:high])
            prefix = sums(raws[doc])
            sizes = self.last[mine] - self.first[mine] + 1
            at = np.repeat(self.first[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            texts_.append(np.full(len(at), doc))
            places.append(at)
            hashes.append(substring_hash(prefix, at, at + length))
            times.append(np.repeat(1 + repeated[mine].astype(np.int64), sizes))
        if not places:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none
        return tuple(map(np.concatenate, (texts_, places, hashes, times)))


def _dealt(block: int, keys: np.ndarray, more: np.ndarray | None, times: np.ndarray, cuts: np.ndarray):
    """One row per range of hashes with the sorted entries that fall into it; empty ranges too."""
    at = np.searchsorted(keys, cuts)
    parts = zip(np.split(keys, at), np.split(more if more is not None else keys[:0], at if more is not None else np.zeros_like(at)), np.split(times, at))
    rows = [(b, block, _sorted_planes(k), _planes(m), t.astype(np.uint8).tobytes()) for b, (k, m, t) in enumerate(parts)]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "block", "keys", "more", "times"])


def _merge(table: pa.Table) -> pa.Table:
    """Sorted entries of several arrays as one array, for one range of hashes."""
    keys, more, times = ([f(x) for x in table.column(c).to_pylist()] for c, f in (("keys", _sorted_numbers), ("more", _numbers), ("times", lambda x: np.frombuffer(x, np.uint8).astype(np.int64))))
    k, m, t, _ = _distinct(np.concatenate(keys), np.concatenate(more), np.concatenate(times))
    row = [table.column("bucket").to_pylist()[:1], [-1], [_sorted_planes(k)], [_planes(m)], [t.astype(np.uint8).tobytes()]]
    return pa.table([pa.array(v, t_) for v, t_ in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "more", "times"])


class SuffixArrays:
    """The family: a list of (size in batches, table name); no two levels have one size."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.made = scratch, [], 0

    def _write(self, entries: DataFrame) -> str:
        self.made += 1
        self.scratch.put(entries.groupBy("bucket").applyInArrow(_merge, _ENTRIES), f"level-{self.made}")
        return f"level-{self.made}"

    def _read(self, name: str) -> DataFrame:
        return self.scratch.spark.read.schema(_ENTRIES).parquet(self.scratch.path(name))

    def add(self, entries: DataFrame) -> None:
        """Sorts a batch into an array; merges levels of equal size until all sizes differ."""
        self.levels.append((1, self._write(entries)))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._write(self._read(a).unionByName(self._read(b)))))
            self.scratch.drop(a, b)

    def all(self) -> DataFrame:
        out = self._read(self.levels[0][1])
        for _, name in self.levels[1:]:
            out = out.unionByName(self._read(name))
        return out


def _told(asked: pa.Table, levels: pa.Table) -> pa.Table:
    """Merge-scan of the blocks' entries against all levels: which runs are found twice, which anchors with other runs."""
    read = lambda t: ([_sorted_numbers(x) for x in t.column("keys").to_pylist()], [_numbers(x) for x in t.column("more").to_pylist()])
    (lk, lm), (ak, am) = read(levels), read(asked)
    times = [np.frombuffer(x, np.uint8).astype(np.int64) for x in levels.column("times").to_pylist()]
    keys, more = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (lk + ak, lm + am))
    known = sum(map(len, lk))
    weight = np.concatenate([*times, np.zeros(len(keys) - known, np.int64)])
    k, _, total, place = _distinct(keys, more, weight)
    _, of, runs_ = np.unique(k, return_inverse=True, return_counts=True)
    twice, shared = (total >= 2)[place[known:]], (runs_ >= 2)[of][place[known:]]
    ends = np.cumsum([len(x) for x in ak])[:-1]
    bits = [[np.packbits(x).tobytes() for x in np.split(flags, ends)] for flags in (twice, shared)]
    return pa.table([asked.column("block"), asked.column("bucket"), pa.array([len(x) for x in ak], pa.int32()), *[pa.array(b, pa.binary()) for b in bits]], ["block", "bucket", "n", "twice", "shared"])


def _counted(table: pa.Table) -> pa.Table:
    """Which windows of each block are found twice, for one range of hashes."""
    keys = [_sorted_numbers(x) for x in table.column("keys").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("times").to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    twice = (np.bincount(place, weights=times) >= 2)[place] if len(place) else np.zeros(0, bool)
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array([len(k) for k in keys], pa.int32()), pa.array(bits, pa.binary()), pa.nulls(len(bits), pa.binary())], ["block", "bucket", "n", "twice", "shared"])


_TOLD = "block long, bucket int, n int, twice binary, shared binary"


def _flags(answers: pa.Table, column: str) -> np.ndarray:
    """Flags of a block's entries in the order of the request."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column(column).to_pylist()), key=lambda r: r[0])
    return np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool) for _, n, raw in rows]])


def _removed(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Bytes covered by the intervals."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change[:-1]) > 0


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, lead: int = LEAD, batches: int = BATCHES, kept_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else. With
    ``kept_text`` a column ``kept`` has the remaining bytes.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = scratch.put(_blocks(rows, kind, length, lead), "texts")
    # as many ranges of hashes as blocks, so that a range's task gets about what one block asks for
    bits = max(3, math.ceil(math.log2(max(1, blocks.count()))))
    cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def ask(some):
        for batch in some:
            for k in range(batch.num_rows):
                held = _Held(batch.slice(k, 1).to_pylist()[0])
                keys, more, times, _ = held.entries()
                yield _dealt(held.block, keys, more, times, cuts)

    entries = scratch.put(blocks.drop("text", "ids").mapInArrow(ask, _ENTRIES), "entries")
    family = SuffixArrays(scratch)
    for k in range(batches):
        family.add(entries.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == k))
    told = entries.groupBy("bucket").cogroup(family.all().groupBy("bucket")).applyInArrow(_told, _TOLD)
    told = scratch.put(told, "told")
    scratch.drop("entries", *[name for _, name in family.levels])

    def compare(block: pa.Table, answers: pa.Table) -> pa.Table:
        held = _Held(block.to_pylist()[0])
        place = held.entries()[3]
        twice, shared = _flags(answers, "twice")[place], _flags(answers, "shared")[place]
        _, _, hashes, times = held.windows(held.raws(), twice, shared, length)
        keys, _, total, _ = _distinct(hashes, np.zeros(len(hashes), np.uint64), times)
        return pa.Table.from_batches([_dealt(held.block, keys, None, total, cuts)])

    windows = blocks.drop("ids").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(compare, _ENTRIES)
    seen = scratch.put(windows.groupBy("bucket").applyInArrow(_counted, _TOLD), "windows")

    def remove(block: pa.Table, answers: pa.Table) -> pa.Table:
        held = _Held(block.to_pylist()[0])
        raws, single = held.raws(), answers.column("shared").is_null()
        first, second = answers.filter(pc.invert(single)), answers.filter(single)
        place = held.entries()[3]
        twice, shared = _flags(first, "twice")[place], _flags(first, "shared")[place]
        doc, at, hashes, times = held.windows(raws, twice, shared, length)
        mine = _flags(second, "twice")[_distinct(hashes, np.zeros(len(hashes), np.uint64), times)[3]]
        doc, at = np.append(held.owner[twice], doc[mine]), np.append(held.first[twice], at[mine])
        stop = np.append(held.last[twice], at[len(at) - int(mine.sum()) :]) + length
        order = np.argsort(doc, kind="stable")
        doc, at, stop = doc[order], at[order], stop[order]
        lows, highs = np.searchsorted(doc, np.arange(len(raws))), np.searchsorted(doc, np.arange(len(raws)), side="right")
        out: list[list] = [[], [], [], []]
        for k, raw in enumerate(raws):
            gone = _removed(len(raw), at[lows[k] : highs[k]], stop[lows[k] : highs[k]]) if lows[k] < highs[k] else np.zeros(0, bool)
            kept = raw[~gone].tobytes() if len(gone) else raw.tobytes()
            out[0].append(int(gone.sum()))
            out[1].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            out[2].append(hashlib.sha256(kept).hexdigest())
            out[3].append(kept if kept_text else None)
        columns = [block.column("ids").combine_chunks().flatten(), pa.array(held.sizes), *[pa.array(x, pa.int64()) for x in out[:2]], pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())]
        return pa.table(columns[: 5 + kept_text], names[: 5 + kept_text])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text
    return blocks.groupBy("block").cogroup(told.unionByName(seen).groupBy("block")).applyInArrow(remove, schema)
