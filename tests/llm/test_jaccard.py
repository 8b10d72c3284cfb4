"""The pipeline's near-dedup (five-word shingles, Jaccard 0.8) against brute force."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tablesteps.llm import jaccard_dedup, simhash_dedup
from tests.llm.conftest import SCHEMA, TABLES, pairs
from tests.llm.test_dedup import brute_print


def brute_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    """Ids of the first row, by id, of each component."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets = [brute_shingles(rows[i][1]) for i in order]
    root = list(range(len(order)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[order[i]][0] for i in range(len(order)) if find(i) == i]


def check(df):
    by_id = lambda x: sorted(x, key=lambda i: (i is None, i or 0))
    kept = corpus_pipeline.near(df.sparkSession, df, TABLES)
    assert kept.dtypes == df.dtypes
    assert by_id(r.doc_id for r in kept.select("doc_id").collect()) == by_id(brute_kept(pairs(df)))


def planted():
    """Short and long texts with words changed: near copies that lie more than two bits apart, and texts just too far."""
    rng, rows = np.random.default_rng(5), []
    for words in (60, 150, 400, 3000):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 5000, words)]
            for edits in (0, words // 150, words // 60, words // 45, words // 30):
                copy = list(base)
                for at in rng.choice(words, edits, replace=False):
                    copy[at] = f"new{rng.integers(0, 10**9)}"
                rows.append((len(rows), " ".join(copy), "en", "a", 1))
    return rows


def test_near_stage_planted_edits(spark):
    rows = planted()
    far = sum((brute_print(rows[i][1]) ^ brute_print(rows[i + 2][1])).bit_count() > 2 for i in range(0, len(rows), 5))
    assert far > 10 and len(brute_kept([r[:2] for r in rows])) < len(rows) / 2
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_near_stage_searches_fingerprints_first(spark, monkeypatch):
    """The SimHash operator's index brings near copies together before the prefix filter does."""
    searched, linked = [], []
    near_links, verified = jaccard_dedup.near_links, jaccard_dedup._verified

    def search(prints, scratch, bits):
        searched.append(prints.count())
        return near_links(prints, scratch, bits)

    def verify(pairs, *more):
        found = verified(pairs, *more)
        linked.append(found.count())
        return found

    monkeypatch.setattr(jaccard_dedup, "near_links", search)
    monkeypatch.setattr(jaccard_dedup, "_verified", verify)
    check(spark.createDataFrame(planted(), SCHEMA).repartition(4))
    assert searched[0] > 100 and linked[0] > 4


@pytest.mark.parametrize("table", ["hard", "docs", "none"])
def test_near_stage_tables(request, table):
    check(request.getfixturevalue(table))


def test_near_stage_hot_group(spark, monkeypatch):
    """A large group of near copies, some of which are near only to each other, goes through the pivots."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    rows = []
    for k in range(400):
        copy = list(base)
        for at in rng.choice(100, 1 + k % 4, replace=False):
            copy[at] = f"new{rng.integers(0, 30)}"
        rows.append((k, " ".join(copy), "en", "a", 1))
    met, turns = jaccard_dedup._met, []
    monkeypatch.setattr(jaccard_dedup, "_met", lambda *x: turns.append(x[2]) or met(*x))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert len(turns) > 1


def test_prefixes_of_near_sets_meet():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = len(a) // 9
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
        often = np.sort(rng.choice(a, max(1, n // 2), replace=False))
        if jaccard_dedup.near(a, b):
            assert np.intersect1d(*(jaccard_dedup.prefix(x, often, np.arange(len(often)), (4, 5)) for x in (a, b))).size


def test_near_stage_copies_just_too_far_make_no_pairs(spark, monkeypatch):
    """Copies with a sixth of shingles of their own all share a prefix shingle, but few may be near by its place."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    rows = []
    for k in range(400):
        copy = list(base)
        for at in rng.choice(range(5, 95, 6), 3, replace=False):
            copy[at] = f"new{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(copy), "en", "a", 1))
    verified, compared = jaccard_dedup._verified, []

    def verify(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard_dedup, "_verified", verify)
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sum(compared) < 10 * len(rows)


def test_first_shared_shingle_allows_near_sets():
    rng = np.random.default_rng(2)
    for n in range(1, 400, 3):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, more = rng.integers(0, n // 8 + 1, 2)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        often = np.sort(rng.choice(a, max(1, n // 2), replace=False))
        if jaccard_dedup.near(a, b):
            first, second = (jaccard_dedup.prefix(x, often, np.arange(len(often))) for x in (a, b))
            i = next(k for k, x in enumerate(first) if x in second)
            j = list(second).index(first[i])
            most = [jaccard_dedup.largest(np.array([len(x)]), np.array([k * 256 // len(y)]))[0] for x, y, k in ((a, first, i), (b, second, j))]
            assert len(b) <= most[0] and len(a) <= most[1]


def test_segments_stay_as_many_while_they_fit():
    assert simhash_dedup.segments(40_000) == simhash_dedup.segments(200_000) == simhash_dedup.segments(8_000_000)
    assert simhash_dedup.segments(0) == 1 and simhash_dedup.segments(10**12) == simhash_dedup.SEGMENTS
