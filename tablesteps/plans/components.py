"""Weakly connected parts of a graph, and what can be told inside each part.

Parts come from minimum labels with shortcuts: each round a vertex takes the smallest label among its
neighbours and then its label's label, so a path of n vertices takes about log2(n) rounds. A vertex with very
many neighbours is a skewed join side, and minima are taken map-side. Parts are independent, so many small ones
share a task, and a part of up to ``PART`` edges is worked off there in time linear in its edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.session import stage

#: Edges of a part that one task takes whole.
PART = 2_000_000
#: Edges of all parts that a task takes together, about. A graph with no more needs no search for its parts.
TASK = 200_000


def connected(links: DataFrame) -> DataFrame:
    """``(id, part)`` of every end of ``links(source, target)``; ``part`` is the smallest id of its part."""
    both = stage(links.select("source", "target").union(links.select("target", "source")).distinct().toDF("id", "near"), "both")
    label = stage(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("part")), "label")
    while True:
        of_near = label.select(F.col("id").alias("near"), F.col("part").alias("_near"))
        low = both.join(of_near, "near").groupBy("id").agg(F.min("_near").alias("_low"))
        new = label.join(low, "id").select("id", F.col("part").alias("_old"), F.least("part", "_low").alias("part"))
        up = new.select(F.col("id").alias("part"), F.col("part").alias("_up"))
        new = stage(new.join(up, "part").select("id", "_old", F.least("part", "_up").alias("part")), "label")
        label = new.select("id", "part")
        if new.filter("part <> _old").isEmpty():
            return label


def inside(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the ends of some edges, the level of each (-1 on or behind a cycle), and which lie on a cycle.

    A level is the longest way from an id without predecessors.
    """
    ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
    a, b = ends[: len(source)], ends[len(source) :]
    n = len(ids)
    level = _peeled(n, a, b)
    rest = level < 0
    stuck = rest[a] & rest[b]
    on = np.zeros(n, bool)
    if stuck.any():
        # what no cycle follows either is behind one; the rest is on a cycle or between two
        p, q = a[stuck], b[stuck]
        core = rest & (_peeled(n, q, p, rest) < 0)
        keep = core[p] & core[q]
        p, q = p[keep], q[keep]
        on = _on_cycle(n, p, q)
    return ids, level, on


def _peeled(n: int, a: np.ndarray, b: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Levels by taking off layers, each edge once; -1 where no layer reaches."""
    order = np.argsort(a, kind="stable")
    b = b[order]
    starts = np.searchsorted(a[order], np.arange(n + 1))
    waiting = np.bincount(b, minlength=n)
    level = np.full(n, -1, np.int64)
    layer = np.flatnonzero((waiting == 0) if among is None else (waiting == 0) & among)
    depth = 0
    while len(layer):
        level[layer] = depth
        size = starts[layer + 1] - starts[layer]
        next_ = b[np.repeat(starts[layer], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        met, times = np.unique(next_, return_counts=True)
        waiting[met] -= times
        layer = met[waiting[met] == 0]
        depth += 1
    return level


def _on_cycle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids with a way back to themselves: strongly connected components, without recursion."""
    order = np.argsort(a, kind="stable")
    starts, b = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    on = np.zeros(n, bool)
    index, low, held, stack = [-1] * n, [0] * n, [False] * n, []
    count = 0
    for first in np.unique(a).tolist():
        if index[first] >= 0:
            continue
        work = [(first, starts[first])]
        while work:
            v, at = work.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                held[v] = True
            if at > starts[v]:
                low[v] = min(low[v], low[b[at - 1]]) if held[b[at - 1]] else low[v]
            while at < starts[v + 1]:
                w = b[at]
                at += 1
                if w == v:
                    on[v] = True
                if index[w] < 0:
                    work += [(v, at), (w, starts[w])]
                    break
                if held[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        held[part[-1]] = False
                    if len(part) > 1:
                        on[part] = True
    return on


def levels_by_part(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(told, left): ``told(id, level, on_cycle)`` of the ends in parts that fit a task, and the edges of larger parts.

    ``level`` is missing on and behind cycles.
    """
    total = links.count()
    if total <= min(TASK, PART):
        tagged = links.withColumn("part", F.lit(0))
    else:
        tagged = stage(links.join(connected(links).withColumnRenamed("id", "source"), "source"), "parts")
    large = tagged.groupBy("part").count().filter(F.col("count") > PART).select("part")
    small = tagged.join(large, "part", "left_anti")
    tasks = max(1, -(-total // TASK))

    def work(table: pa.Table) -> pa.Table:
        ids, level, on = inside(*(table.column(c).to_numpy(zero_copy_only=False) for c in ("source", "target")))
        return pa.table({"id": pa.array(ids, table.schema.field("source").type), "level": pa.array(level, mask=level < 0), "on_cycle": pa.array(on)})

    kind = links.schema["source"].dataType.simpleString()
    told = small.groupBy(F.pmod(F.xxhash64("part"), F.lit(tasks)).alias("_task")).applyInArrow(work, f"id {kind}, level long, on_cycle boolean")
    return told, tagged.join(large, "part", "left_semi").select("source", "target")
