"""Repeated strings, SimHash, exact dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tablesteps.llm import exact_dedup, simhash_dedup, suffix_dedup
from tests.llm.conftest import pairs


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def brute_repeats(texts, length):
    raws = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(raw[s : s + length] for _, raw in raws for s in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "lead"), [(400, 100), (60, 20), (60, 60)])
def test_repeats_hard(hard, length, lead):
    got = suffix_dedup.repeated(hard, length=length, lead=lead)
    assert ordered(got.collect()) == ordered(brute_repeats(pairs(hard), length))


def test_repeats_documents(docs):
    assert ordered(suffix_dedup.repeated(docs).collect()) == ordered(brute_repeats(pairs(docs), 400))


def test_repeats_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    got = suffix_dedup.repeated(docs.repartition(3), length=80, lead=30, batches=3, kept_text=True).collect()
    assert ordered(r[:5] for r in got) == ordered(brute_repeats(pairs(docs), 80))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_empty(none):
    assert suffix_dedup.repeated(none).collect() == []


def test_levels_merge_geometrically(spark, docs):
    class Counted(suffix_dedup.SuffixArrays):
        def _write(self, entries):
            self.made += 1
            return f"level-{self.made}"

        def _read(self, name):
            class Part:
                def unionByName(self, other):
                    return self

            return Part()

    family = Counted(type("S", (), {"drop": lambda self, *a: None})())
    for k in range(1, 12):
        family.add(None)
        sizes = [size for size, _ in family.levels]
        assert sum(sizes) == k and len(set(sizes)) == len(sizes) == bin(k).count("1")


def brute_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit=2):
    """Root index of each row by a pass over all pairs of distinct values."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= limit:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(v) for v in prints]


def check_simhash(df):
    rows = pairs(df)
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    low = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = [(i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, roots)]
    assert ordered(simhash_dedup.near_duplicates(df).collect()) == ordered(want)
    return rows, roots


def test_simhash_hard(hard):
    rows, roots = check_simhash(hard)
    kept = simhash_dedup.drop_near_duplicates(hard)
    assert kept.dtypes == hard.dtypes
    assert len(kept.collect()) == len(set(roots))


def test_simhash_documents(docs):
    check_simhash(docs)


def test_simhash_empty(none):
    assert simhash_dedup.near_duplicates(none).collect() == []
    assert simhash_dedup.drop_near_duplicates(none).collect() == []


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 25, 3)).astype(np.uint64)
    near = (centres[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel()
    values = np.unique(np.concatenate([centres, near, rng.integers(0, 2**64, 500, dtype=np.uint64)]))
    values = values[np.argsort(simhash_dedup.gray_rank(values))]
    index = simhash_dedup.GrayIndex(np.full(len(values), ~np.uint64(0)), values)
    got = set(zip(*(x.tolist() for x in index.search(values, 2))))
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= 2))))


def test_near_links_over_segments(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SEGMENT", 20)
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 2**63))
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    values |= {int(v) for v in rng.integers(0, 2**63, 200)}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    from tablesteps.llm.common import Scratch, components

    scratch = Scratch(spark, "test")
    links = simhash_dedup.near_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4), scratch)
    stars = {r.v: r.root for r in components(scratch.put(links, "links"), scratch).collect()}
    got = [stars.get(v, v) for v in signed]
    want = brute_components([v % 2**64 for v in signed])
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_components_of_chain_and_star(spark):
    from tablesteps.llm.common import Scratch, components

    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 6)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert ordered(got) == ordered([(k, 0) for k in range(61)] + [(k, 100) for k in range(100, 160)])


def brute_exact(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i))
    first, out = set(), []
    for (i, _), n in sorted(zip(rows, norm), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        ids = groups[n]
        out.append((i, ids[0], len(ids), n not in first, hashlib.sha256(n.encode()).hexdigest()))
        first.add(n)
    return out


def test_exact_hard(hard):
    assert ordered(exact_dedup.annotate(hard).collect()) == ordered(brute_exact(pairs(hard)))
    kept = exact_dedup.drop_duplicates(hard)
    assert kept.dtypes == hard.dtypes
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r[0] or 0 for r in brute_exact(pairs(hard)) if r[3])


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_hot_group_over_partitions(spark, uncoalesced):
    rows = [(k, "same text here" if k % 3 else f"own {k}", "en", "a", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert ordered(exact_dedup.annotate(df).collect()) == ordered(brute_exact(pairs(df)))
    assert exact_dedup.drop_duplicates(df).count() == 1001
    # the hot group really lies in several partitions
    parts = exact_dedup._sorted(df, "doc_id", "text", None).rdd.mapPartitionsWithIndex(lambda i, rs: {(i, r.norm == "same text here") for r in rs}).collect()
    assert sum(hot for _, hot in parts) > 1


def test_exact_empty(none):
    assert exact_dedup.annotate(none).collect() == []
    assert exact_dedup.drop_duplicates(none).collect() == []
