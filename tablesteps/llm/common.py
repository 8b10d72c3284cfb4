"""What the corpus operators share: the two text columns, words, staging, connected components.

Every operator reads only the columns it needs, under its own names, so extra columns of any name
cannot clash. A NULL text is an empty text.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.session import scratch_dir

#: One blank character of the contracts, and a word.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(docs: DataFrame, name: str) -> Column:
    """The column called exactly ``name``."""
    return docs[f"`{name}`"]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; a NULL text becomes an empty one."""
    return docs.select(
        named(docs, id_col).alias("doc_id"), F.coalesce(named(docs, text_col), F.lit("")).alias("text")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_collecting: list[list[Scratch]] = []


@contextmanager
def collected() -> Iterator[list[Scratch]]:
    """The scratch folders made inside the block, for a caller that knows when they may go."""
    _collecting.append([])
    try:
        yield _collecting[-1]
    finally:
        _collecting.pop()


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Jobs started inside the block hand Python batches of about ``size`` bytes at most, however long the rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back() -> None:
    """Returns to the machine what a Python worker no longer uses: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``, which all executors share.

    ``put`` cuts the lineage and pins the rows, so that a lost executor cannot change them.
    ``drop`` removes a table that nothing will read again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.name = spark, f"{label}-{uuid.uuid4().hex}"
        self.root = f"{scratch_dir(spark)}/{self.name}"
        if _collecting:
            _collecting[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop("")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; ``root`` is the smallest vertex of its component.

    Alternates large-star and small-star steps until the edges are stars. Minima are aggregated
    before the join, so a vertex with very many neighbours is a skewed join side that adaptive
    execution splits. No edges give no rows.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    ).where("v <> u").distinct()
    pairs, old = scratch.put(pairs, "star-0"), "star-0"
    state = _fingerprint(pairs)
    step = 0
    while state[0]:
        step += 1
        both = pairs.select("v", "u").unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        large = both.join(low, both.v == low.w).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), "m")
        small = (
            large.join(low, large.v == low.w).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select(F.col("w").alias("v"), F.col("m").alias("u")))
            .distinct()
        )
        pairs = scratch.put(small, f"star-{step}")
        scratch.drop(old)
        old, last, state = f"star-{step}", state, _fingerprint(pairs)
        if state == last:
            break
    roots = pairs.select("u").distinct().select(F.col("u").alias("v"), F.col("u").alias("root"))
    return pairs.select("v", F.col("u").alias("root")).unionByName(roots)


def _fingerprint(pairs: DataFrame) -> tuple:
    """Count and order-free digest of the edges; equal after a step only when nothing changed."""
    return tuple(
        pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
    )
