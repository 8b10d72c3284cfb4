"""Registered corpus queries against their SQL, and the pipeline against its stages by hand."""

import re

import pytest

import corpus_pipeline
from tablesteps.llm import queries
from tablesteps.queries.base import Query
from tests.llm.conftest import TABLES, pairs
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_text import WORD, brute_quality, brute_targets
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert not compare(spark, connect(TABLES), Query(queries.QUERIES[name], queries.SQL[name]), TABLES)


def test_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if int(n[2:].split("_")[0]) <= 10))
def test_every_document_has_a_row(spark, docs, name):
    out = queries.QUERIES[name](spark, TABLES)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(i for i, _ in pairs(docs))


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_pipeline_stages(spark, request, table):
    rows = request.getfixturevalue(table)
    good = corpus_pipeline.quality(spark, rows, TABLES)
    want = [(i, t) for i, t in pairs(rows) if brute_quality(i, t)[7]]
    by_id = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0))
    assert by_id(pairs(good)) == by_id(want)
    seen, single = set(), []
    for i, t in by_id(want):
        norm = re.sub("[\x20\x09-\x0d]+", " ", t)
        if norm not in seen:
            single.append((i, t))
        seen.add(norm)
    exact = corpus_pipeline.exact(spark, good, TABLES)
    assert by_id(pairs(exact)) == single
    near = corpus_pipeline.near(spark, exact, TABLES)
    stay = set(brute_kept(single))
    kept = [(i, t) for i, t in single if i in stay]
    assert by_id(pairs(near)) == kept
    mixed = corpus_pipeline.mixed(spark, near, TABLES)
    assert good.dtypes == exact.dtypes == near.dtypes == mixed.dtypes == rows.dtypes
    whole, sizes, words, longest = dict(kept), {}, {}, {}
    for r in near.select("source", "text").collect():
        size = len(WORD.findall(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + size
        longest[r.source] = max(longest.get(r.source, 0), size)
    for r in mixed.select("doc_id", "source", "text").collect():
        assert whole[r.doc_id] == r.text
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    goal = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert all(abs(words.get(s, 0) - goal[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert corpus_pipeline.encoded(spark, mixed, TABLES).count() == mixed.count()


def test_pipeline_empty(spark, none):
    out = none
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, TABLES)
    assert out.collect() == []


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, TABLES).count() > 100


def test_pipeline_tidies_up_after_finished_stages(spark, docs, tmp_path):
    from pathlib import Path

    from tablesteps.session import scratch_dir

    folder = Path(scratch_dir(spark).removeprefix("file://"))
    corpus_pipeline.quality(spark, docs, "tidy")
    before, frame, held = set(folder.iterdir()), docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, "tidy")
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        held.append(len(set(folder.iterdir()) - before))
    assert max(held) == 1 and held[-1] == 0


def test_results_of_one_stage_do_not_disturb_each_other(spark, docs):
    a, b = (corpus_pipeline.exact(spark, docs, "twice") for _ in range(2))
    assert a.count() == b.count() > 0
