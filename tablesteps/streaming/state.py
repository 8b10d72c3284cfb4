"""Keyed state of a stream: appended deltas with levelled compaction, in shared storage.

Micro-batch n writes one segment: the rows it changed, or, where the levels say so, those rows merged with the
newest segments before it. Which segments make up a state follows from n alone, so nothing has to be kept
besides them, and a batch that is repeated after a failure reads the same segments and overwrites its own.
Segments of FANOUT batches are merged into one of the next level; the start table is merged in when the
number of batches is a power of FANOUT. So a row is rewritten once per level, a state is read from few
segments, and what most batches write follows the batch, not the state.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.session import same_keys

FANOUT = 4
_BATCH = "_batch"


def live(n: int) -> list[tuple[int, int]]:
    """First and last batch of the segments that make up the state after batch ``n``; the start table is batch -1."""
    top = 1
    while top * FANOUT <= n + 1:
        top *= FANOUT
    if top == 1:
        top = 0
    out, at, size = [(-1, top - 1)], top, max(top, 1)
    while at <= n:
        while at + size > n + 1:
            size //= FANOUT
        out.append((at, at + size - 1))
        at += size
    return out


class DeltaState:
    """Rows with unique ``key`` in a folder of segments. A key may be missing; that is a key too."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        self.stored = T.StructType([*schema.fields, T.StructField(_BATCH, T.IntegerType())])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DeltaState:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        return cls(spark, path, T.StructType.fromJson(about["schema"]), about["key"])

    @classmethod
    def create(cls, start: DataFrame, path: str, key: Sequence[str]) -> DeltaState:
        """State whose batch -1 is ``start``; a state that exists stays as it is."""
        state = cls(start.sparkSession, path, start.schema, key)
        about = json.dumps({"schema": start.schema.jsonValue(), "key": list(key)})
        state.spark.createDataFrame([(about,)], "value STRING").coalesce(1).write.mode("ignore").text(f"{path}/about")
        start.withColumn(_BATCH, F.lit(-1)).write.mode("ignore").parquet(state._place((-1, -1)))
        return state

    def _place(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/segment-{segment[0] + 1:012d}-{segment[1] + 1:012d}"  # counted from the start table

    def _segments(self, segments: Sequence[tuple[int, int]]) -> DataFrame:
        """Newest rows of some segments, with the batch that wrote them."""
        rows = [self.spark.read.schema(self.stored).parquet(self._place(s)) for s in segments]
        return self._newest(rows)

    def _newest(self, rows: Sequence[DataFrame]) -> DataFrame:
        """The first table is the largest: the others are made unique first, then only their keys meet it."""
        if len(rows) == 1:
            return rows[0]
        later = rows[1]
        for other in rows[2:]:
            later = later.unionByName(other)
        row = F.struct(*self.schema.names, _BATCH)
        later = later.groupBy(*self.key).agg(F.max_by(row, _BATCH).alias("_row")).select("_row.*")
        keys = later.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
        on = same_keys([rows[0][k] for k in self.key], [keys[f"_k{i}"] for i in range(len(self.key))])
        return rows[0].join(keys, on, "left_anti").unionByName(later)

    def read(self, n: int) -> DataFrame:
        return self._segments(live(n)).select(*self.schema.names)

    def write(self, n: int, changed: DataFrame) -> None:
        """State after batch ``n``: that after ``n - 1`` with the rows ``changed`` (unique keys) put in."""
        changed = changed.select(*self.schema.names).withColumn(_BATCH, F.lit(n))
        segment = live(n)[-1]
        parts = [self.spark.read.schema(self.stored).parquet(self._place(s)) for s in live(n - 1) if s[0] >= segment[0]]
        merged = self._newest([*parts, changed])
        # few files for few rows: a segment of many batches is as wide as its rows need
        merged.hint("rebalance").write.mode("overwrite").parquet(self._place(segment))
        self._purge(n)

    def newest(self) -> int:
        """The last batch whose segments were all written whole; -1 for the start table alone."""
        done = self._finished()
        return max((last for _, last in done if done.issuperset(live(last))), default=-1)

    def _finished(self) -> set[tuple[int, int]]:
        path, fs = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        names = [e.getPath() for e in fs.listStatus(path) if e.getPath().getName().startswith("segment-")]
        whole = [p.getName() for p in names if fs.exists(hadoop.Path(p, "_SUCCESS"))]
        return {tuple(int(x) - 1 for x in name.split("-")[1:]) for name in whole}

    def _purge(self, n: int, keep: int = 2) -> None:
        """Removes segments that no state from batch ``n - keep`` on needs; later states, left by an earlier run, stay."""
        needed = {s for k in range(max(-1, n - keep), n + 1) for s in live(k)}
        path, fs = self._fs()
        for segment in self._finished():
            if segment not in needed and segment[1] <= n:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._place(segment)), True)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())
