"""Language-model scores from a weighted backoff automaton over word bigrams.

A state is the word just read. It has an arc for each word that followed it in the training texts, and a
failure arc to the state without history, whose arcs are the single words and one for all unknown words. The
arcs' weights are smoothed: an arc has (1 - b) c(h, w) / c(h) of its state plus what the failure arc gives,
b P(w). b is the Good-Turing share of unseen bigrams, the part of bigram tokens seen once. P(w) is
c(w) / (N + V), and V / (N + V) for an unknown word (Witten-Bell). Every state's weights add up to 1. A
text is read once from left to right, carrying the state and adding logarithms.

The counts cover all training texts and are never sent whole to a task or the driver. Texts are cut into
blocks of some megabytes; a block asks for the counts of the distinct n-grams that it holds. Requests go to
ranges of the n-grams' 64-bit hashes, where the counts of all blocks are added up, and the sums go back to the
blocks in the order of the request. A frequent n-gram is thus one number per block. Words are told
apart by 64-bit hashes (XXH64).

Defined results: a NULL or empty text is the end token alone; a NULL id counts as the empty text in the fold;
repeated rows are separate texts; without training texts every token is unknown and the score is 0 for each
(V and N are 0, so all weight is on unknown words); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, named, small_batches

#: Bytes of text in a block. More bytes make fewer requests and larger tasks.
BLOCK = 8_000_000
#: Marks that no word can equal, as words have no blanks.
_BEGIN, _END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" begin ", b" end "))


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences, equal bytes of all of them together: compresses well."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _counts(values: np.ndarray) -> bytes:
    """Counts of at most 40 bits, equal bytes together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:5]).tobytes()


def _uncounted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(5, -1).astype(np.int64)
    return sum(planes[k] << (8 * k) for k in range(5))


class Block:
    """Texts of one block as numbered words: the words' hashes, each text's words, and which texts train."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, trains: np.ndarray):
        self.sizes, self.trains = sizes, trains
        self.words = np.append(words, (_END, _BEGIN))
        end, begin = len(words), len(words) + 1
        stops = np.cumsum(sizes + 1) - 1
        self.token = np.full(int(sizes.sum()) + len(sizes), end, np.uint32)
        inside = np.ones(len(self.token), bool)
        inside[stops] = False
        self.token[inside] = tokens
        self.before = np.append(np.uint32(begin), self.token[:-1])
        self.before[self.before == end] = begin
        self.starts = stops - sizes
        self.training = np.repeat(trains, sizes + 1)

    def grams(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words and of bigrams: the sorted hashes, the place of each token's among them, training counts."""
        keys, place = np.unique(self.words[:-1], return_inverse=True)
        at = place[self.token]
        single = keys, at, np.bincount(at[self.training], minlength=len(keys))
        # bigrams of numbered words are made distinct before they are hashed
        code, which = np.unique(self.before.astype(np.uint64) << np.uint64(32) | self.token, return_inverse=True)
        hashed = _mixed(self.words[code >> np.uint64(32)], self.words[code & np.uint64(0xFFFFFFFF)])
        pairs, place = np.unique(hashed, return_inverse=True)
        at = place[which]
        return single, (pairs, at, np.bincount(at[self.training], minlength=len(pairs)))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_ROW = "block long, ids array<{kind}>, trains array<boolean>, sizes array<int>, tokens binary, words binary"


def _encode(docs: DataFrame, kind: str) -> DataFrame:
    """Blocks of ``docs(doc_id, train, text)``."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, trains, rows, numbers, held = [], [], [], {}, 0
        schema = None

        def close():
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            tokens = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
            planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            sizes = pa.array([[len(r) for r in rows]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([ids], pa.list_(schema)), pa.array([trains], pa.list_(pa.bool_())), sizes, pa.array([planes], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                ["block", "ids", "trains", "sizes", "tokens", "words"],
            )

        for batch in batches:
            schema = batch.schema.field(0).type
            for doc_id, train, text in zip(*[c.to_pylist() for c in batch.columns]):
                raw = text.encode("utf-8", "surrogatepass").lower().split()
                rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in raw), np.uint32, len(raw)))
                ids.append(doc_id)
                trains.append(train)
                held += sum(map(len, raw)) + len(raw) + 32
                if held >= BLOCK:
                    yield close()
                    ids, trains, rows, numbers, held, seq = [], [], [], {}, 0, seq + 1
        if rows:
            yield close()

    return docs.mapInArrow(run, _ROW.format(kind=kind))


def _block(row: dict) -> Block:
    tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return Block(np.frombuffer(row["words"], "<u8"), tokens, np.array(row["sizes"], np.int64), np.array(row["trains"], bool))


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    """``bucket, block`` and the packed hashes and training counts of words and of bigrams."""
    cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                parts = []
                for keys, _, counts in _block(row).grams():
                    at = np.searchsorted(keys, cuts)
                    parts.append([(_packed(x), _counts(c)) for x, c in zip(np.split(keys, at), np.split(counts, at))])
                for bucket, ((a, b), (c, d)) in enumerate(zip(*parts)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int32()), pa.array([row["block"]]), *[pa.array([x], pa.binary()) for x in (a, b, c, d)]],
                        ["bucket", "block", "words", "word_counts", "pairs", "pair_counts"],
                    )

    return blocks.select("block", "trains", "sizes", "tokens", "words").mapInArrow(
        run, "bucket int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
    )


def _answer(table: pa.Table) -> pa.Table:
    """Sums over all blocks for one range of hashes, for each block in its own order, and totals."""
    blocks, answers, totals = table.column("block").to_pylist(), [], [0, 0, 0]
    for kind, (name, count) in enumerate((("words", "word_counts"), ("pairs", "pair_counts"))):
        keys = [_unpacked(x) for x in table.column(name).to_pylist()]
        counts = [_uncounted(x) for x in table.column(count).to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64) if len(place) else np.zeros(0, np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        answers.append([_counts(sums[p]) for p in np.split(place, ends)])
        if kind == 0:
            totals[0], totals[1] = int(sums.sum()), int((sums > 0).sum())
        else:
            totals[2] = int((sums == 1).sum())
    rows = len(blocks)
    bucket = table.column("bucket").to_pylist()[:1] * (rows + 1)
    numbers = [pa.array([None] * rows + [t], pa.int64()) for t in totals]
    return pa.table([pa.array([*blocks, None], pa.int64()), pa.array(bucket, pa.int32()), *[pa.array([*a, None], pa.binary()) for a in answers], *numbers], ["block", "bucket", "words", "pairs", "n", "v", "once"])


def traverse(block: Block, single: tuple, pairs: tuple, word_counts: np.ndarray, pair_counts: np.ndarray, n: int, v: int, begins: int, once: int):
    """Per text: known tokens, base score, and the automaton's log10 probability."""
    at, of = single[1], word_counts
    c = of[at]
    known = c > 0
    base = np.log10((c + 1) / (n + v + 1))
    fallback = np.where(known, c, v) / (n + v) if n else np.ones(len(c))
    # the state's own count: how often it was left, which is how often its word was read
    place = np.append(np.searchsorted(single[0], block.words[:-1]), 0)
    left = np.where(block.before == len(block.words) - 1, begins, of[place[block.before]])
    fail = min(0.99, max(0.01, once / n)) if n else 1.0
    arcs = pair_counts[pairs[1]]
    weight = np.where(left > 0, (1 - fail) * arcs / np.maximum(left, 1) + fail * fallback, fallback)
    add = lambda x: np.add.reduceat(x, block.starts)
    return add(known.astype(np.int64)), add(base), add(np.log10(weight))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a condition on the id column; its rows do not train.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(named(docs, id_col).alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.coalesce(named(docs, text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        blocks = scratch.put(_encode(rows, kind), "blocks")
    # as many ranges of hashes as blocks, so that a range's task gets about what one block asks for
    bits = max(3, math.ceil(math.log2(max(1, blocks.count()))))
    answers = _requests(blocks, bits).groupBy("bucket").applyInArrow(
        _answer, "block long, bucket int, words binary, pairs binary, n long, v long, once long"
    )
    answers = scratch.put(answers, "answers")
    totals = answers.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once")]).first()
    begins = blocks.select(F.sum(F.size(F.filter("trains", lambda t: t)))).first()[0] or 0
    n, v, once = totals.n, totals.v, totals.once

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _block(row)
        single, pairs = block.grams()
        order = np.argsort(right.column("bucket").to_numpy())
        back = lambda name: np.concatenate([_uncounted(right.column(name)[int(i)].as_py()) for i in order])
        known, base, total = traverse(block, single, pairs, back("words"), back("pairs"), n, v, begins, once)
        size = len(block.sizes)
        return pa.table(
            [left.column("ids").combine_chunks().flatten(), pa.array(~block.trains), pa.array(block.sizes + 1), pa.array(known), pa.array(np.full(size, n)), pa.array(base), pa.array(total)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = answers.where("block IS NOT NULL").select("block", "bucket", "words", "pairs")
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
