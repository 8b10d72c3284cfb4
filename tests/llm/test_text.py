"""Quality rules, secrets, mixing, BPE, language model and classifiers against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tablesteps.llm import bpe, lm, mixing, quality_classifier, quality_rules, secrets, toxicity
from tests.llm.conftest import SCHEMA, TABLES, pairs
from tests.llm.test_dedup import ordered

WORD = re.compile("[^\x20\x09-\x0d]+")


# quality rules


def brute_quality(i, text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(again) > 50 * len(words)
    lost = 0
    for line in lines:
        n = len(WORD.findall(line))
        bad = len(re.findall(quality_rules.BAD_END, line)) * 100 > n * quality_rules.BAD_END_PERCENT
        bad |= n < quality_rules.FRAGMENT_WORDS and not re.search(quality_rules.SENTENCE_MARK, line)
        bad |= len(re.findall(quality_rules.NAVIGATION, line)) * 100 > n * quality_rules.NAVIGATION_PERCENT
        bad |= bool(re.search(quality_rules.BOILERPLATE, line))
        lost += n * bad
    kept = not base and lost * 100 <= len(words) * quality_rules.MAX_LOST_PERCENT
    return (i, len(words), sum(map(len, words)), sum(text.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(again), base, kept, lost)


def test_quality_hard(hard):
    assert ordered(quality_rules.judge(hard).collect()) == ordered(brute_quality(*r) for r in pairs(hard))
    kept = quality_rules.keep_good(hard)
    assert kept.dtypes == hard.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in pairs(hard) if brute_quality(i, t)[7])


def test_quality_documents_keep_the_good(spark, docs):
    assert ordered(quality_rules.judge(docs).collect()) == ordered(brute_quality(*r) for r in pairs(docs))
    told = quality_rules.judge(docs).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("quality = 1 AND NOT base_failed")
    assert told.where("NOT kept").count() == 0 < told.count()


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(1, "Good line, that ends well.\nHome | About | Help\n\nAll rights reserved by us.", "en", "a", 1)], SCHEMA)
    assert quality_rules.clean_lines(df).first().text == "Good line, that ends well.\n"


def test_quality_is_native(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().toString() + secrets.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# secrets


def brute_secrets(rows):
    found, owners, repos = [], {}, {}
    for i, text, owner in rows:
        text, base = text or "", []
        for number, (kind, pattern, group, least) in enumerate(secrets.BASE):
            base += [(m.start(), number, m.end(), m[group], kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        more = []
        for m in re.finditer(secrets.CANDIDATE, text):
            v = m[0]
            mixed = re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v)
            if (mixed or re.fullmatch(secrets.FORMATS, v)) and not any(b[0] < m.end() and m.start() < b[2] for b in base):
                more.append((m.start(), len(secrets.BASE), m.end(), v, secrets.OWNED))
        found.append((i, base, more))
        for s in base + more:
            owners.setdefault(s[3], set()).add(owner)
            repos.setdefault(s[3], set()).add((owner, i))
    out = []
    for i, base, more in found:
        say = lambda spans: ",".join(f"{s[4]}:{s[0]}:{s[2]}" for s in sorted(spans))
        live = [s for s in base + more if len(owners[s[3]]) <= secrets.MAX_OWNERS and len(repos[s[3]]) <= secrets.MAX_REPOS]
        counts = [sum(s[4] == k for s in base) for k, *_ in secrets.BASE]
        spans = say(base + [s for s in more if s in live])
        out.append((i, *counts, hashlib.sha256(say(base).encode()).hexdigest(), spans, len(live), len(base) + len(more) - len(live)))
    return out


def test_secrets_hard(hard):
    rows = [(r.doc_id, r.text, r.source) for r in hard.select("doc_id", "text", "source").collect()]
    got = secrets.scan(hard)
    assert ordered(got.collect()) == ordered(brute_secrets(rows))
    spans = {r.doc_id: r for r in got.collect()}
    assert spans[18].n_assign == 1 and spans[18].n_access == 1 and "owned" in spans[19].spans
    assert spans[20].n_copied == 1  # two owners hold it


@pytest.mark.parametrize("copies", [secrets.MAX_REPOS, secrets.MAX_REPOS + 1])
def test_secrets_of_one_owner_in_many_repositories(spark, copies):
    token = "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9q"
    rows = spark.createDataFrame([(k, f"say {token} {k}", "en", "one", 1) for k in range(copies)] + [(99, "password=hunter2hunter2", "en", "two", 1)], SCHEMA)
    got = secrets.scan(rows).collect()
    assert ordered(got) == ordered(brute_secrets([(r.doc_id, r.text, r.source) for r in rows.collect()]))
    assert sum(r.n_live for r in got if r.doc_id != 99) == (copies if copies <= secrets.MAX_REPOS else 0)


@pytest.mark.parametrize("operator", [secrets.scan, quality_rules.judge])
def test_native_operators_without_rows(none, operator):
    assert operator(none).collect() == []


def test_secrets_documents(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert ordered(secrets.scan(docs).collect()) == ordered(brute_secrets(rows))


# mixing


def brute_targets(sizes, weights, share, most):
    """Water filling, one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_mixing(request, table):
    df = request.getfixturevalue(table)
    options = dict(weights=(3, 1, 2), share=1.5, most=2.0)
    got = mixing.taken(df, **options).collect()
    rows = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in df.select("doc_id", "text", "source").collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    goal = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert ordered((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == ordered((i, n, sizes[s], round(goal[s], 6)) for i, n, s in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - sum(goal.values())) <= len(sizes)
    assert ordered(got) == ordered(mixing.taken(df.repartition(2), **options).collect())
    mixed = mixing.mix(df, **options)
    assert mixed.dtypes == df.dtypes
    words, texts = Counter(), {(i, t) for i, t in pairs(df)}
    for r in mixed.select("doc_id", "source", "text").collect():
        assert (r.doc_id, r.text) in texts  # copies are whole
        words[r.source] += len(WORD.findall(r.text))
    longest = {s: max(n for _, n, o in rows if o == s) for s in sizes}
    assert all(abs(words[s] - goal[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_mixing_empty(none, spark):
    assert mixing.taken(none).collect() == [] and mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 1)], SCHEMA)
    assert ordered(mixing.taken(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_tree_splits_exactly():
    quotas = np.array([17, 0, 5, 240, 1])
    leaves = list(mixing.split_quotas(quotas, np.zeros_like(quotas), 0, 13, 7))
    assert sum(q for *_, q, _ in leaves).tolist() == quotas.tolist()
    assert {int(q.sum()) for *_, q, _ in leaves} <= {20, 21}
    for k in range(len(quotas)):
        held = sorted(x for *_, q, s in leaves for x in range(s[k], s[k] + q[k]))
        assert held == list(range(quotas[k]))
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("table", ["hard", "docs", "none"])
def test_bpe(request, table, vocabulary):
    df, (path, reference) = request.getfixturevalue(table), vocabulary
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN)
    want = [(i, reference.encode_ordinary(t or "")) for i, t in pairs(df)]
    assert ordered((r.doc_id, list(r.ids)) for r in encoded.collect()) == ordered(want)
    assert ordered(bpe.decode(encoded, path).collect()) == ordered((i, t or "") for i, t in pairs(df))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    told = [(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(reference.decode_bytes(ids))) for i, ids in want]
    assert ordered(bpe.round_trip(df, path, public_tokenizers.PATTERN).collect()) == ordered(told)


def test_bpe_random_words(vocabulary):
    path, reference = vocabulary
    rng = np.random.default_rng(1)
    letters = list("aabcdeeethin ERS'st \n\t129.,é ñ漢🙂")
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(800)] + ["a" * 3000, "ab" * 900, "'" * 700, "é" * 500]
    encoder = bpe.Encoder(path, public_tokenizers.PATTERN)
    for start in range(0, len(texts), 300):
        some = texts[start : start + 300]
        assert [x.tolist() for x in encoder.block(some)] == reference.encode_ordinary_batch(some)


def test_bpe_small_blocks_and_memory(spark, vocabulary):
    """What a task remembers and holds at once does not change the digests; it forgets beyond the bound."""
    path, _ = vocabulary
    df = spark.createDataFrame([(k, f"word{k % 40} other{k} again{k % 3}", "en", "a", 1) for k in range(300)], SCHEMA).repartition(2)
    small = bpe.round_trip(df, path, public_tokenizers.PATTERN, block_bytes=200, remembered=50)
    assert ordered(small.collect()) == ordered(bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())
    encoder = bpe.Encoder(path, public_tokenizers.PATTERN, 50)
    for k in range(20):
        list(encoder.block([f"u{k}x{j}" for j in range(20)]))
        assert len(encoder.number) <= 50 + 80


# language model


def brute_lm(rows):
    docs, counts, follow, states = [], Counter(), Counter(), Counter()
    for i, text in rows:
        tokens = [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]
        held = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        docs.append((i, held, tokens))
        if not held:
            counts.update(tokens)
            follow.update(zip(["<begin>", *tokens], tokens))
            states.update(["<begin>", *tokens[:-1]])
    n, v = sum(counts.values()), len(counts)
    fail = min(0.99, max(0.01, sum(c == 1 for c in follow.values()) / n)) if n else 1.0
    out = []
    for i, held, tokens in docs:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        score = 0.0
        for h, t in zip(["<begin>", *tokens], tokens):
            single = (counts[t] or v) / (n + v) if n else 1.0
            score += math.log10((1 - fail) * follow[h, t] / states[h] + fail * single if states[h] else single)
        out.append((i, held, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("table", ["hard", "docs", "none"])
@pytest.mark.parametrize("block", [lm.BLOCK, 30_000])
def test_lm(request, table, block, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", block)
    df = request.getfixturevalue(table)
    got = lm.score(df, toxicity.fold(F.col("doc_id"), 7) == 2).collect()
    assert ordered((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == ordered(brute_lm(pairs(df)))


def test_lm_without_training_texts(docs):
    got = lm.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in got} == {(0, 0, 0.0)}


# classifiers


def held_out_accuracy(spark, scores, label, parts, out, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in scores.collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % parts == out]
    return rows, sum((s >= least) == bool(y) for s, y in rows) / len(rows)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.fold(F.col("doc_id"), 5) != 0, "toxic")
    rows, accuracy = held_out_accuracy(spark, toxicity.score(docs, model), "toxic", 5, 0, 0.5)
    assert accuracy > 0.96 and len(model[0]) < 5000
    assert sum(s >= 0.5 for s, y in rows if not y) <= 0.01 * len(rows)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_classifier.classify(docs, labels, toxicity.fold(F.col("doc_id"), 4) != 2)
    assert held_out_accuracy(spark, scores, "quality", 4, 2, 0.7)[1] > 0.98


def test_classifiers_hard(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, 1), (9, 0), (10, 0), (10, 0), (11, None), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(hard, labels, F.lit(True), "label")
    got = toxicity.score(hard, model)
    assert got.count() == hard.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    measured = quality_classifier.measure(hard)
    fitted = quality_classifier.fit(measured, labels, F.lit(True), "label")
    got = quality_classifier.score(measured, fitted)
    assert got.count() == hard.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    untrained = toxicity.fit(hard, labels.limit(0), F.lit(True), "label")
    assert {r.score for r in toxicity.score(hard, untrained).collect()} == {0.5}
    assert {r.score for r in quality_classifier.score(measured, quality_classifier.fit(measured, labels.limit(0), F.lit(True), "label")).collect()} == {0.5}
    assert toxicity.score(none, model).collect() == [] and quality_classifier.score(quality_classifier.measure(none), fitted).collect() == []


def test_ftrl_weights_are_sparse_and_learn():
    rng = np.random.default_rng(2)
    rows = [(np.unique(np.append(rng.integers(10, 1000, 20), k % 2)), k % 2) for k in range(600)]
    w, bias = toxicity.train(rows, 10, 1.0, 1.0, 12.0, 0.0, 8)
    assert w[1] > 1 and w[0] < -1 and np.count_nonzero(w) < 60
