import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablesteps.llm import spelling
from tablesteps.llm.queries import op13_spelling
from tests.llm.conftest import TABLES, pairs


def brute_vocabulary(rows, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def brute_near(words):
    """Near words through all strings with one code point left out."""
    holes, near = defaultdict(set), defaultdict(set)
    sizes = Counter(map(len, words))
    for w in words:
        if sizes[len(w)] == 1 and not sizes[len(w) - 1] + sizes[len(w) + 1]:
            continue
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add((w, k))
    for short, ways in holes.items():
        for w, k in ways:
            if short in words:
                near[w].add(short), near[short].add(w)
            near[w] |= {v for v, j in ways if j == k and v != w}
    return near


def brute(rows, least=5):
    n = brute_vocabulary(rows, least)
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute(spark, sf):
    tables = TABLES.replace("sf0.001", sf)
    want = brute(pairs(spark.read.parquet(f"{tables}/documents.parquet")))
    assert len(want) > 100 and any(v[0] for v in want.values())
    assert got(op13_spelling(spark, tables)) == want


@pytest.mark.parametrize("table", ["hard", "none"])
def test_hard_rows(request, table):
    rows = request.getfixturevalue(table)
    assert got(spelling.variants(rows, least_count=1)) == brute(pairs(rows), least=1)


def test_dense_words_split_halves_and_chains(spark, monkeypatch):
    """Nearly all words of a small alphabet; halves shared by more words than a block holds; long chains of forms."""
    monkeypatch.setattr(spelling, "BLOCK", 40)
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9]))) for _ in range(700)]
    words += ["aaaaaa" + a + b + c for a in "abé" for b in "abé" for c in "abé"] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "AAAAAAAAA"]
    words += ["z" * 400, "z" * 401, "z" * 200 + "y" + "z" * 199, "q" * 3000, "q" * 3001]
    chain = ["chainword", "chainwort", "chainwords"]
    words += ["chain" + "xyzuvw"[:k] for k in range(1, 6) for _ in range(6**k)] + chain * 3
    text = [" ".join(words[k::7]) for k in range(7)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string").repartition(3)
    for least in (1, 2):
        want = brute(list(enumerate(text)), least)
        assert got(spelling.variants(rows, least_count=least)) == want
    assert want["chainx"][1] == "chainxyzuv"


def test_index_against_scan():
    rng = np.random.default_rng(0)
    names = sorted({"".join(rng.choice(list("abc"), rng.integers(6, 10))) for _ in range(300)})
    near = brute_near(set(names))
    words, lengths, last = [], [], []
    for w in names:
        for size in (len(w), len(w) - 1):
            for side in (False, True):
                words.append(w), lengths.append(size), last.append(side)
    count, best = spelling.near_in_block(words, np.ones(len(words), np.int64), np.array(lengths), np.array(last), np.ones(len(words), bool))
    total = Counter()
    for w, k in zip(words, count.tolist()):
        total[w] += k
    assert dict(total) == {w: len(near[w]) for w in names}
