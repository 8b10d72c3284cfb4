"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a block of texts.

A block is a slice of a partition with some megabytes of text. Its distinct words (matches of the split pattern) are laid
side by side as symbols in one array. An inverted index leads from the rank of each adjacent pair to the
places where the pair stands; ranks are replayed in ascending order over all words of the block
together, and a merge touches only the two neighbouring pairs. Words are independent of each other, so
the block's size does not change any result; the words of earlier blocks of the task are remembered up
to a bound, after which the memory is emptied and refilled.

Defined results: a NULL text is an empty text and has no ids; repeated rows are encoded alike; an
empty table gives no rows; ids of the caller may be NULL and are passed through. Special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tablesteps.llm.common import give_back, texts

#: Words remembered by a task before its memory is emptied, and bytes of text in a block.
REMEMBERED = 600_000
BLOCK = 12_000_000


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and a number in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Replays the merges of a vocabulary over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # every way of cutting a token into two tokens is a pair that makes it
        pairs = sorted(
            (ranks[token[:i]] << 32 | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        )
        self.pair, self.made = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        # tokens with which a pair can make a token of lower rank than their own
        left, right = self.pair >> 32, self.pair & 0xFFFFFFFF
        self.turns_back = set(np.concatenate([left[self.made < left], right[self.made < right]]).tolist())
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of symbols makes, -1 if none."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.made[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has.

        Of the pairs of a word the lowest rank merges first, and of equals the leftmost.
        """
        whole = np.array([self.ranks.get(word, -1) for word in words], np.int64)
        sizes = np.array([len(word) for word in words], np.int64)
        symbols = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        # a word that is a token itself is that token
        starts = np.cumsum(sizes) - sizes
        known = (whole >= 0) & (sizes > 0)
        symbols[known[owner]] = -1
        symbols[starts[known]] = whole[known]
        self._replay(symbols, np.where(known[owner], -1, owner))
        alive = symbols >= 0
        return symbols[alive], np.bincount(owner[alive], minlength=len(words))

    def _replay(self, symbols: np.ndarray, owner: np.ndarray) -> None:
        """Merges in place; a place that was swallowed holds -1. Places of owner -1 stay as they are."""
        n = len(symbols)
        if n < 2:
            return
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        inside = np.flatnonzero((owner[1:] == owner[:-1]) & (owner[1:] >= 0)).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        self._note(index, queue, self._rank(symbols[inside], symbols[inside + 1]), inside)
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            places = np.unique(np.concatenate(found))
            places = places[symbols[places] >= 0]
            right = after[places]
            fits = right < n
            places, right = places[fits], right[fits]
            fits = (owner[right] == owner[places]) & (self._rank(symbols[places], symbols[right]) == rank)
            places, right = places[fits], right[fits]
            if not len(places):
                continue
            if len(places) > 1:
                if rank in self.turns_back:
                    # one place of a word at a time: the merge may bring up a lower rank, which goes first
                    now = np.append(True, owner[places[1:]] != owner[places[:-1]])
                else:
                    # all places, but of overlapping ones (a run of one symbol) each second one
                    at = np.arange(len(places))
                    runs = np.append(True, right[:-1] != places[1:])
                    now = (at - np.maximum.accumulate(np.where(runs, at, 0))) % 2 == 0
                if not now.all():
                    if rank in self.turns_back:
                        index[rank] = [places[~now]]
                        heapq.heappush(queue, rank)
                    places, right = places[now], right[now]
            symbols[places], symbols[right] = rank, -1
            beyond = after[right]
            after[places] = beyond
            linked = beyond < n
            before[beyond[linked]] = places[linked]
            # only the two pairs beside each merged place are new
            left = before[places]
            ok = left >= 0
            ok[ok] = owner[left[ok]] == owner[places[ok]]
            linked[linked] = owner[beyond[linked]] == owner[places[linked]]
            at = np.concatenate([left[ok], places[linked]])
            if len(at):
                self._note(index, queue, self._rank(symbols[at], symbols[np.concatenate([places[ok], beyond[linked]])]), at)

    @staticmethod
    def _note(index: dict[int, list[np.ndarray]], queue: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Files places under the rank of the pair that stands there."""
        ok = ranks >= 0
        ranks, places = ranks[ok], places[ok]
        if not len(ranks):
            return
        order = np.lexsort((places, ranks))
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places]):
            if rank in index:
                index[rank].append(some)
            else:
                index[rank] = [some]
                heapq.heappush(queue, rank)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Encodes blocks of texts; lives in one task."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.merges, self.find, self.remembered = _merges(path), regex.compile(pattern).findall, remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(self, block: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; to be read before the next block."""
        if len(self.number) > self.remembered:
            self._forget()
        number = self.number.__getitem__
        cut = [np.fromiter(map(number, self.find(text)), np.int32) for text in block]
        new = list(islice(self.number, len(self.sizes), None))
        if new:
            flat, sizes = self.merges.encode([word.encode() for word in new])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        return map(self._spread, cut)

    def _spread(self, words: np.ndarray) -> np.ndarray:
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[words] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(read_ranks(path))


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``, one row per row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    most = BLOCK

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch in _blocks(batches, most):
            ids = list(encoder.block(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text behind each list of ids; NULL ids give an empty text.

    Bytes that are not UTF-8, which only lists cut inside a character give, become U+FFFD.
    """
    rows = encoded.select(encoded[f"`{id_col}`"].alias("doc_id"), encoded[f"`{ids_col}`"].alias("ids"))

    def run(batches):
        merges = _merges(path)
        for batch in batches:
            out = [merges.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of what they decode to.

    Encodes and decodes block by block in one task, so that ids are not sent between two Python stages. Smaller
    blocks (``block_bytes``, else ``BLOCK``) and fewer ``remembered`` words hold less memory and replay frequent words more often.
    """
    rows = texts(docs, id_col, text_col)
    most = block_bytes or BLOCK

    def run(batches):
        encoder = Encoder(path, pattern, remembered)
        names = _Numbers()
        for batch in _blocks(batches, most):
            sizes, digests, decoded = [], [], []
            for ids in encoder.block(batch.column(1).to_pylist()):
                ids = ids.tolist()
                sizes.append(len(ids))
                digests.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(encoder.merges.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Numbers(dict):
    """Decimal forms of ids, each made once."""

    def __missing__(self, key: int) -> str:
        self[key] = value = str(key)
        return value
