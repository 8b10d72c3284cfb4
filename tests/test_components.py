"""Levels and cycles of program graphs: inside tasks, and for parts that no task can hold."""

import random
import time

import numpy as np
import pytest

from tablesteps.plans import components, lineage


def brute(ids, edges):
    """Level (None on or behind a cycle) and the ids on a cycle."""
    reach = {i: set() for i in ids}
    for _ in ids:
        for a, b in edges:
            reach[a] |= {b} | reach[b]
    on = {i for i in ids if i in reach[i]}
    stuck = on | {b for a in on for b in reach[a]}
    level = {i: 0 for i in ids if i not in stuck}
    for _ in ids:
        for a, b in edges:
            if b in level:
                level[b] = max(level[b], level[a] + 1)
    return {i: level.get(i) for i in ids}, on


def random_graph(rng, n, m):
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return [(a, b) if rng.random() < 0.15 or a < b else (b, a) for a, b in edges]


@pytest.mark.parametrize("seed", range(40))
def test_inside_a_task(seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 30, rng.choice([10, 30, 60])) + [(3, 3)] * (seed % 2)
    ids, level, on = components.inside(*(np.array(x) for x in zip(*edges)))
    want, ring = brute(sorted({x for e in edges for x in e}), edges)
    assert {i: (None if v < 0 else v) for i, v in zip(ids.tolist(), level.tolist())} == want
    assert set(ids[on].tolist()) == ring


def frames(spark, ids, edges):
    nodes = spark.createDataFrame([(f"n{i}", i) for i in ids], "id STRING, pos INT")
    return nodes, spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "source STRING, target STRING").repartition(3)


@pytest.mark.parametrize("part, task", [(0, 20), (40, 20), (2_000_000, 20), (2_000_000, 200_000)])
def test_small_and_large_parts_agree(spark, monkeypatch, part, task):
    monkeypatch.setattr(components, "PART", part)
    monkeypatch.setattr(components, "TASK", task)
    rng = random.Random(1)
    edges = random_graph(rng, 40, 50) + [(100 + a, 100 + b) for a, b in random_graph(rng, 12, 9)] + [(200, 201), (201, 202), (202, 200), (202, 203)]
    ids = sorted({x for e in edges for x in e} | {999})
    want, on = brute(ids, edges)
    nodes, links = frames(spark, ids, edges)
    order = {r.id: (r.level, r.topo_order) for r in lineage.topo_order(nodes, links).collect()}
    assert {i: order[f"n{i}"][0] for i in ids} == want
    by_order = sorted(ids, key=lambda i: (want[i] is None, want[i] or 0, i))
    assert [f"n{i}" for i in by_order] == sorted(order, key=lambda k: order[k][1])
    places = {r.id: r.place for r in lineage.cycles(nodes, links).collect()}
    assert places == {f"n{i}": "on" if i in on else "behind" for i in ids if want[i] is None}


def test_deep_ladder(spark):
    depth = 5000
    edges = [(2 * k + a, 2 * k + 2 + b) for k in range(depth) for a in (0, 1) for b in (0, 1)]
    nodes, links = frames(spark, range(2 * depth + 2), edges)
    start = time.time()
    rows = lineage.topo_order(nodes, links).collect()
    assert time.time() - start < 60
    assert all(r.level == int(r.id[1:]) // 2 and r.topo_order == int(r.id[1:]) for r in rows)


def test_without_edges(spark):
    nodes, links = frames(spark, [2, 1], [(5, 6)])
    assert [(r.id, r.level) for r in sorted(lineage.topo_order(nodes, links).collect())] == [("n1", 0), ("n2", 0)]
    assert lineage.cycles(nodes, links).count() == 0
