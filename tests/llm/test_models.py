"""Toxicity and quality scores against plain versions of their models."""

import math
import zlib

import numpy as np
import xxhash

from tablesteps.llm import quality_classifier, toxicity
from tablesteps.llm.queries import op9_toxicity, op10_quality_classifier
from tests.llm.conftest import TABLES, pairs

M = (1 << 64) - 1


def labelled(spark, column, fold, keep):
    rows = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", column).collect()
    return {i: y for i, y in rows if y is not None and keep(zlib.crc32(str(i).encode()) % fold)}


def plain_features(text):
    """Coordinates of words, stems, neighbours and skips, one by one."""
    bare = [w.strip(toxicity._MARKS) for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    h = [xxhash.xxh64_intdigest(w) for w in bare]
    out = list(h)
    for size in (5, 7):
        out += [xxhash.xxh64_intdigest(w[:size], size) for w in bare]
    for gap, a, b in ((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        out += [(x * a & M) ^ (y * b & M) for x, y in zip(h, h[gap:])]
    return sorted({v >> (64 - toxicity.BITS) for v in out})


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=12.0, epochs=8):
    """FTRL-proximal with dictionaries; the intercept has no L1."""
    z, n = {}, {}

    def weight(k):
        limit = 0.0 if k == "bias" else l1
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= limit else -(v - math.copysign(limit, v)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for at in order.permutation(len(rows)).tolist():
            keys, label = [*rows[at][0], "bias"], rows[at][1]
            w = [weight(k) for k in keys]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, math.fsum(w))))) - label
            for k, wk in zip(keys, w):
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * wk
                n[k] = old + g * g
    return weight


def test_toxicity_against_plain_ftrl(spark, docs):
    labels = labelled(spark, "toxic", 5, lambda f: f != 0)
    at = {i: plain_features(t) for i, t in pairs(docs)}
    assert len(at) == docs.count()
    rows = [(at[i], labels[i]) for i in sorted(labels) if i in at]
    weight = plain_ftrl(rows)
    for r in op9_toxicity(spark, TABLES).collect():
        total = weight("bias") + math.fsum(weight(k) for k in at[r.doc_id])
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.5)  # weights are sent as 32-bit numbers


def test_quality_against_direct_discriminant(spark, docs):
    labels = labelled(spark, "quality", 4, lambda f: f != 2)
    x = {i: np.array(quality_classifier.statistics(t)) for i, t in pairs(docs)}
    sets = [np.array([x[i] for i, y in sorted(labels.items()) if y == k and i in x]) for k in (0, 1)]
    total = sum(map(len, sets))
    spreads = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * v for s, v in zip(sets, spreads)) / total
    floor = np.diag(np.diag(pooled) + 1e-6)
    log_density = []
    for s, v in zip(sets, spreads):
        cov = 0.98 * (0.9 * v + 0.1 * pooled) + 0.02 * floor
        mean, (_, logdet) = s.mean(axis=0), np.linalg.slogdet(cov)
        log_density.append(lambda p, mean=mean, cov=cov, logdet=logdet, s=s: math.log(len(s) / total) - (logdet + (p - mean) @ np.linalg.solve(cov, p - mean)) / 2)
    for r in op10_quality_classifier(spark, TABLES).collect():
        a, b = (f(x[r.doc_id]) for f in log_density)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, b - a))))) < 1e-9
        assert r.predicted == int(r.score >= 0.7)
