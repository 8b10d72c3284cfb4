"""Exact dedup by content sort.

Sampled splitters range-partition the rows by normalised text (its first characters and its digest,
then the id, so that a group of copies of any size is cut over several partitions). Each partition is
sorted, which Spark does with spilling to disk; equal texts are then neighbours and every row is compared
in full with the one before it. A run of equal texts that crosses partition borders is joined from one
or two summary rows a partition.

Defined results: a NULL text is an empty text, and all texts of blanks only equal each other's
normal form (one blank) but not the empty text. NULL ids sort last; they stay only if the whole group
has no id. Of repeated rows with one id exactly one stays. An empty table gives no rows. Other columns
are not read, except that ``drop_duplicates`` returns all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from tablesteps.llm.common import BLANK, Scratch, named

_PREFIX = 12
_EDGE = "edge boolean, first boolean, part int"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: Column | None) -> DataFrame:
    """Rows in content order: ``id, sha, norm`` and the carried struct."""
    norm = normalise(named(docs, text_col))
    kept = carry if carry is not None else F.struct(F.coalesce(named(docs, text_col), F.lit("")).alias(text_col))
    rows = docs.select(
        named(docs, id_col).alias("id"), F.sha2(norm, 256).alias("sha"), F.substring(norm, 1, _PREFIX).alias("lead"), kept.alias("row")
    )
    ranged = rows.repartitionByRange(F.col("lead"), F.col("sha"), F.asc_nulls_last("id"))
    # the normal form is made again after the shuffle rather than sent through it
    made = ranged.withColumn("norm", normalise(F.col("row")[text_col]))
    return made.sortWithinPartitions("lead", "sha", "norm", F.asc_nulls_last("id"), F.col("row")[text_col])


def _heads(norm: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """True where a text differs from the one before it."""
    out = np.ones(len(norm), bool)
    if len(norm) > 1:
        out[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    if last is not None and len(norm):
        out[0] = norm[0].as_py() != last.as_py()
    return out


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    order = _sorted(docs, id_col, text_col, None)
    id_type = order.schema["id"].dataType.simpleString()

    def scan(batches):
        part, last, run, first_run = TaskContext.get().partitionId(), None, [], True

        def close(pieces, edge):
            ids = pa.chunked_array([x[0] for x in pieces]).combine_chunks()
            n = len(ids)
            sha = pa.chunked_array([x[1] for x in pieces]).combine_chunks()
            keep = ids.take(pa.array(np.zeros(n, np.int64)))
            flags = pa.array(np.full(n, edge)), pa.array(np.arange(n) == 0), pa.array(np.full(n, part, np.int32))
            return ids, keep, pa.array(np.full(n, n)), sha, *flags

        names = ["id", "keep_id", "group_size", "sha", "edge", "first", "part"]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sha, norm = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "sha", "norm"))
            starts = np.flatnonzero(_heads(norm, last))
            last = norm[len(norm) - 1]
            if not len(starts):
                run.append((ids, sha))
                continue
            if starts[0] > 0:
                run.append((ids.slice(0, starts[0]), sha.slice(0, starts[0])))
            if run:
                yield pa.RecordBatch.from_arrays(list(close(run, first_run)), names)
                first_run = False
            if len(starts) > 1:
                yield pa.RecordBatch.from_arrays(_closed(ids, sha, starts, first_run, part), names)
                first_run = False
            run = [(ids.slice(starts[-1]), sha.slice(starts[-1]))]
        if run:
            yield pa.RecordBatch.from_arrays(list(close(run, True)), names)

    schema = f"id {id_type}, keep_id {id_type}, group_size long, sha string, {_EDGE}"
    runs = scratch.put(order.select("id", "sha", "norm").mapInArrow(scan, schema), "runs")
    # at most two runs of a partition can go on in another one: that many rows, and no more, are broadcast
    edges = runs.where("edge").groupBy("sha").agg(
        F.min(F.struct("part", F.expr("NOT first"), "keep_id")).alias("e"), F.count("*").alias("n")
    )
    joined = runs.join(F.broadcast(edges.withColumnRenamed("sha", "edge_sha")), (F.col("edge") & (F.col("sha") == F.col("edge_sha"))), "left")
    whole = F.col("n").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(whole, F.col("keep_id")).otherwise(F.col("e.keep_id")).alias("keep_id"),
        F.coalesce("n", "group_size").alias("group_size"),
        (F.col("first") & (whole | (F.col("part") == F.col("e.part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _closed(ids: pa.Array, sha: pa.Array, starts: np.ndarray, first_run: bool, part: int) -> list[pa.Array]:
    """The runs that begin and end inside one batch."""
    lo, hi = int(starts[0]), int(starts[-1])
    sizes = np.diff(starts)
    head_at = np.repeat(starts[:-1], sizes)
    edge = np.zeros(hi - lo, bool)
    if first_run:
        edge[: sizes[0]] = True
    first = np.zeros(hi - lo, bool)
    first[starts[:-1] - lo] = True
    return [
        ids.slice(lo, hi - lo), ids.take(pa.array(head_at)), pa.array(np.repeat(sizes, sizes)), sha.slice(lo, hi - lo),
        pa.array(edge), pa.array(first), pa.array(np.full(hi - lo, part, np.int32)),
    ]


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    order = _sorted(docs, id_col, text_col, F.struct(*[named(docs, c).alias(c) for c in docs.columns]))

    def scan(batches):
        part, last, first_row = TaskContext.get().partitionId(), None, True
        pending = None  # of the partition's last run only its digest is needed
        for batch in batches:
            if not batch.num_rows:
                continue
            sha, norm = (batch.column(batch.schema.get_field_index(c)) for c in ("sha", "norm"))
            heads = np.flatnonzero(_heads(norm, last))
            last, pending = norm[len(norm) - 1], sha[len(sha) - 1].as_py()
            edge = np.zeros(len(heads), bool)
            if first_row:
                edge[0] = True
                first_row = False
            at = pa.array(heads)
            n = len(heads)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")).take(at), sha.take(at), pa.array(edge), pa.array(np.ones(n, bool)), pa.array(np.full(n, part, np.int32))],
                ["row", "sha", "edge", "first", "part"],
            )
        if pending is not None:
            tail = [pa.nulls(1, row_type), pa.array([pending]), pa.array([True]), pa.array([False]), pa.array([part], pa.int32())]
            yield pa.RecordBatch.from_arrays(tail, ["row", "sha", "edge", "first", "part"])

    kind = order.schema["row"].dataType
    row_type = to_arrow_type(kind)
    schema = StructType([StructField("row", kind), StructField("sha", StringType()), *StructType.fromDDL(_EDGE)])
    heads = scratch.put(order.select("row", "sha", "norm").mapInArrow(scan, schema), "heads")
    # one row for each partition's first and last run: a run goes on if an earlier partition ends with it
    edges = heads.where("edge").groupBy("sha").agg(F.min("part").alias("from_part")).withColumnRenamed("sha", "edge_sha")
    kept = heads.where("first").join(F.broadcast(edges), F.col("edge") & (F.col("sha") == F.col("edge_sha")), "left")
    return kept.where("from_part IS NULL OR from_part = part").select("row.*")
