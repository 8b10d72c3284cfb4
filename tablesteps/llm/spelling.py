"""Spelling variants by search schemes on bidirectional FM-indexes of the delimited vocabulary.

The vocabulary is counted inside the tasks that read the texts. Two words one edit apart share, exactly, the
first or the last half of the shorter one. Each word is dealt to a block of words by either half, once for a
partner as long or longer and once for one that is shorter, so that a block holds all partners and its size
does not follow the vocabulary's. A block builds an index over ``$word$word$...``: the suffix ranks of the text
and of the reversed text, kept in step. A search matches one half exactly towards its delimiter and extends
across the other half, allowing one inserted, deleted or replaced code point, up to the other delimiter; what
is left is one suffix, whose rank gives the word. A pair is reported by one of the four rows that may meet it:
by the first half if the words agree on it, else by the last.

A half shared by more words than a block holds is split: its words are dealt over several blocks, and each
searches all of them. Forms are followed by pointer doubling; a form's count is at least ``ratio`` times that of
the word, so chains are no longer than the logarithm of the largest count.

Defined results: NULL and empty texts have no words; a NULL id counts as an empty string before the colon; texts
and words may be of any length; repeated rows count each; the near word of largest count wins, ties go to the
first in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.llm.common import Scratch, texts

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
#: Rows of a block, and words of one half before it is split.
BLOCK = 8192
#: Distinct words that a counting task holds before it passes them on.
_HELD = 300_000
_CHECKPOINT = 32
_LONG_TEXT = 1 << 22


def spelled(doc_id: str, run: str, every: int) -> str:
    """The run in lower case (A-Z only), without one code point where ``every`` divides its hash."""
    run = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
               least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``(word, n)``: words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    rows = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def count(batches):
        runs = re.compile(f"[{letters}]{{{least_length},}}")
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                own = Counter(runs.findall(text) if len(text) < _LONG_TEXT else (m[0] for m in runs.finditer(text)))
                for run, n in own.items():
                    word = spelled(doc_id, run, every)
                    if len(word) >= least_length:
                        found[word] += n
                if len(found) > _HELD:
                    yield out(found)
                    found.clear()
        yield out(found)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of ``text`` in order; all rotations differ."""
    n = len(text)
    key, width = np.zeros(n, np.int64), 0
    bits = max(1, int(text.max()).bit_length())
    while (width + 1) * bits < 63 and width < 8:
        key = (key << bits) | np.roll(text, -width)
        width += 1
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * n + np.roll(rank, -width)
        width *= 2


class TwoWayIndex:
    """FM-indexes of a text and of its reverse; ``side`` 0 extends a match to the left, 1 to the right.

    A match is (own, size, other): its interval of suffix ranks begins at ``own`` in the index that is
    extended and at ``other`` in the other one.
    """

    def __init__(self, text: np.ndarray, letters: int):
        self.letters, self.length = letters, len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=letters))))
        self.sides = []
        for k, t in enumerate((text, text[::-1])):
            order = suffix_ranks(t)
            if k == 0:
                self.delimiters = order[: self.first[1]]  # ranks of suffixes that begin with the delimiter, which is the lowest letter
            before = np.append(t[order - 1], np.full(-len(t) % _CHECKPOINT + _CHECKPOINT, letters))
            grid = before.reshape(-1, _CHECKPOINT).astype(np.uint8 if letters < 256 else np.uint32)
            rows = np.repeat(np.arange(len(grid)), _CHECKPOINT)
            seen = np.bincount(rows * (letters + 1) + before, minlength=len(grid) * (letters + 1)).reshape(len(grid), -1)[:, :letters]
            below = np.zeros((len(grid), letters + 1), np.int32)  # letters below c in all rows before
            below[1:, 1:] = np.cumsum(np.cumsum(seen, axis=0), axis=1)[:-1]
            self.sides.append((grid, below))

    def start(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches of one letter; they begin at the same rank in both indexes."""
        return self.first[c], self.first[c + 1] - self.first[c], self.first[c]

    def extend(self, side: int, own: np.ndarray, size: np.ndarray, other: np.ndarray, c: np.ndarray):
        grid, below = self.sides[side]
        at = np.arange(_CHECKPOINT)

        def less(place):
            row, rest = np.divmod(place, _CHECKPOINT)
            letters, inside = grid[row], at < rest[:, None]
            lower, same = (letters < c[:, None]) & inside, (letters == c[:, None]) & inside
            low = below[row, c] + np.count_nonzero(lower, axis=1)
            return low, below[row, c + 1] - below[row, c] + np.count_nonzero(same, axis=1)

        (low0, same0), (low1, same1) = less(own), less(own + size)
        return self.first[c] + same0, same1 - same0, other + low1 - low0

    def letters_of(self, side: int, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(match, letter) for each letter that can extend a match, but the delimiter."""
        small = np.flatnonzero(size <= 2 * self.letters)
        each = np.repeat(small, size[small])
        place = own[each] + np.arange(len(each)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        seen = np.unique(each * self.letters + self.sides[side][0].ravel()[place])
        seen = seen[seen % self.letters > 0]
        large = np.flatnonzero(size > 2 * self.letters)
        match = np.concatenate([seen // self.letters, np.repeat(large, self.letters - 1)])
        return match, np.concatenate([seen % self.letters, np.tile(np.arange(1, self.letters), len(large))])


def _joined(states: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*states))


def one_edit(index: TwoWayIndex, patterns: np.ndarray, base: np.ndarray, length: np.ndarray, exact: np.ndarray, last: bool, known: np.ndarray):
    """(query, rank of ``$word$``) of the indexed words one edit away.

    ``patterns`` holds the queries as ``$word$`` at ``base`` - 1; the first (or ``last``) ``exact`` letters and the
    delimiter next to them must match. A ``known`` query is itself in the index, so where one match is left
    before any error it is the query, and the search ends.
    """
    side = int(last)  # towards the delimiter of the exact half
    step = 1 if last else -1
    from_ = base + length - exact if last else base + exact - 1
    own, size, other = index.start(patterns[from_])
    query = np.arange(len(base))
    for k in range(1, int(exact.max()) + 1 if len(exact) else 0):
        more = k <= exact[query]  # the last of them is the delimiter
        moved = index.extend(side, own[more], size[more], other[more], patterns[from_[query[more]] + step * k])
        own[more], size[more], other[more] = moved
        alive = size > 0
        query, own, size, other = query[alive], own[alive], size[alive], other[alive]
    side, step, from_, left = 1 - side, -step, from_ - step, length - exact
    zero, one = (query, other, size, own), [(query[:0], own[:0], size[:0], own[:0])]
    found = []
    k = 0
    while len(zero[0]) or any(len(x[0]) for x in one):
        others = (zero[2] > 1) | ~known[zero[0]]
        query, own, size, other = zero = tuple(x[others] for x in zero)
        match, letter = index.letters_of(side, own, size)
        moved = index.extend(side, own[match], size[match], other[match], letter)
        fine = moved[1] > 0
        match, letter, moved = match[fine], letter[fine], tuple(x[fine] for x in moved)
        child = (query[match], *moved)
        one.append(child)  # a letter inserted before the k-th
        query_one, own_one, size_one, other_one = _joined(one)
        done = left[query_one] == k
        expected = np.where(done, 0, patterns[from_[query_one] + step * np.where(done, 0, k)])
        moved = index.extend(side, own_one, size_one, other_one, expected)
        fine = moved[1] > 0
        end = fine & done
        found.append((query_one[end], (moved[2] if side else moved[0])[end]))
        go = fine & ~done
        one = [(query_one[go], *(x[go] for x in moved))]
        more = left[query] > k
        one.append(tuple(x[more] for x in zero))  # the k-th deleted
        more = left[child[0]] > k
        child, letter = tuple(x[more] for x in child), letter[more]
        same = patterns[from_[child[0]] + step * k] == letter
        one.append(tuple(x[~same] for x in child))  # the k-th replaced
        zero = tuple(x[same] for x in child)
        k += 1
    query, rank = _joined(found) if found else (query, query)
    return np.divmod(np.unique(query * index.length + rank), index.length)


def near_in_block(words: list[str], counts: np.ndarray, lengths: np.ndarray, last: np.ndarray, indexed: np.ndarray):
    """For each row its number of near words among the indexed ones, and the best of them as (count, word)."""
    names = sorted({words[k] for k in np.flatnonzero(indexed)})
    near, best = np.zeros(len(words), np.int64), [None] * len(words)
    if not names:
        return near, best
    n_of, held = dict(zip(words, counts.tolist())), set(names)
    known = np.array([w in held for w in words])

    def flat(some):
        return np.frombuffer(("\0" + "\0".join(some) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)

    text, asked = flat(names), flat(words)
    letters, codes = np.unique(np.concatenate([text, asked]), return_inverse=True)
    text, asked = codes[: len(text)], codes[len(text) :]
    index = TwoWayIndex(text, len(letters))
    at = np.flatnonzero(text == 0)  # the delimiter before each word
    size = np.array([len(w) for w in words])
    base = 1 + np.cumsum(size + 1) - size - 1
    half = lengths // 2
    for side in (False, True):
        for rows in np.array_split(rows := np.flatnonzero(last == side), max(1, math.ceil(len(rows) / 4096))):
            exact = (lengths - half if side else half)[rows]
            query, rank = one_edit(index, asked, base[rows], size[rows], exact, side, known[rows])
            hits = np.searchsorted(at, index.delimiters[rank])
            for row, hit in zip(rows[query].tolist(), hits.tolist()):
                word, other = words[row], names[hit]
                h = half[row]
                if min(len(word), len(other)) != lengths[row] or (side and word[:h] == other[:h]):
                    continue  # another row of the word reports this pair
                near[row] += 1
                key = (-n_of[other], other)
                if best[row] is None or key < best[row]:
                    best[row] = key
    return near, best


def near_words(vocab: DataFrame, total: int, least_length: int = 6) -> DataFrame:
    """``(word, n_near, near_n, near)`` of the words of ``vocab(word, n)`` that have near words."""
    size = F.length("word")
    rows = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where(F.col("length") >= least_length)
    half = (F.col("length") / 2).cast("int")
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    part = F.when(F.col("last"), F.expr("right(word, length - cast(length / 2 as int))")).otherwise(F.substring("word", F.lit(1), half))
    rows = rows.withColumn("key", F.xxhash64("length", "last", part))
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK)
    hot = hot.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = max(1, math.ceil(4 * total / BLOCK))
    rows = rows.select(
        F.pmod(F.xxhash64("key", "part"), F.lit(blocks)).alias("block"), "word", "n", "length", "last",
        (F.pmod(F.xxhash64("word"), "parts") == F.col("part")).alias("indexed"),
    )

    def search(table: pa.Table) -> pa.Table:
        words = table.column("word").to_pylist()
        n, length, last, indexed = (table.column(c).to_numpy() for c in ("n", "length", "last", "indexed"))
        near, best = near_in_block(words, n, length.astype(np.int64), last, indexed)
        some = np.flatnonzero(near).tolist()
        return pa.table({
            "word": pa.array([words[k] for k in some], pa.string()), "n_near": pa.array(near[some], pa.int64()),
            "near_n": pa.array([-best[k][0] for k in some], pa.int64()), "near": pa.array([best[k][1] for k in some], pa.string()),
        })

    found = rows.groupBy("block").applyInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), "best.near"
    )


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
             least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the vocabulary."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.put(vocabulary(docs, id_col, text_col, letters, least_length, least_count, every), "vocabulary")
    total, most = vocab.agg(F.count("*"), F.max("n")).first()
    near = near_words(vocab, total, least_length)
    form = lambda c: F.when(F.col("near_n") >= ratio * F.col("n"), F.col(c))
    told = scratch.put(
        vocab.join(near, "word", "left").select(
            "word", form("near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form("near_n").alias("form_n")
        ), "told",
    )
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    steps = math.log(max(1, (most or 1) / least_count), ratio) + 1 if ratio > 1 else total  # links of a chain, at most
    for k in range(math.ceil(math.log2(max(1, steps)))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.put(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
