"""Streaming forms: live trace roll-up, ledgers and queues fed by events, reconciliation of arrivals.

Keyed state is a folder of segments (``state.DeltaState``): a batch writes the rows it changes. A batch that
is repeated after a failure reads the same state and overwrites its own segment, so replays change nothing.
The checkpoint and the state live in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablesteps.operators.reconcile import reconcile_periods
from tablesteps.plans.ledger import QUEUE_KEY, ledger_sync, queue_upsert
from tablesteps.plans.trace import flatten_usage, outcome_columns
from tablesteps.session import same_keys, scratch_scope, stage
from tablesteps.sources.readers import TRACE_SCHEMA
from tablesteps.streaming.state import DeltaState


def trace_source(spark: SparkSession, folder: str) -> DataFrame:
    """JSON trace files as a stream without torn lines (``trace_reject_source`` has those); times are proper timestamps."""
    raw = spark.readStream.schema(TRACE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return raw.filter(F.col("_corrupt_record").isNull()).withColumn("at", F.col("at").try_cast("timestamp"))


def trace_reject_source(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that ``trace_source`` leaves out, as a stream of (file, line)."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", TRACE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter("trim(line) <> ''").withColumn("_bad", parsed["_corrupt_record"]).filter("_bad IS NOT NULL").select("file", "line")


def trace_stream(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Outcomes, duration and tokens per task and time window; late lines count up to ``watermark``."""
    rows = flatten_usage(stream).withWatermark("at", watermark)
    grouped = rows.groupBy(F.window("at", window).alias("w"), F.coalesce("task", F.lit("?")).alias("task"))
    return grouped.agg(*outcome_columns()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*"
    ).drop("w")


def stateful_stream(
    events: DataFrame,
    start: DataFrame,
    path: str,
    key: Sequence[str],
    changes: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Fold micro-batches into a keyed table: ``changes(state, batch)`` gives the new and changed rows."""
    state = DeltaState.create(start, path, key)

    def step(batch: DataFrame, n: int) -> None:
        with scratch_scope(batch.sparkSession):
            state.write(n, changes(state.read(n - 1), batch))

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest state that was written whole; a restarted stream needs no progress of its own for it."""
    state = DeltaState.open(spark, path)
    return state.read(state.newest())


def ledger_stream(events: DataFrame, ledger: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Ledger kept current from a stream of review events (id, note, at)."""

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        return ledger_sync(state.join(batch.select(key).distinct(), key, "left_semi"), batch, key)[0]

    return stateful_stream(events, ledger, path, [key], changes, checkpoint)


def queue_stream(events: DataFrame, queue: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Failure queue kept current from a stream of failures."""

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        met = batch.select(*[F.col(k).alias(f"_m_{k}") for k in QUEUE_KEY]).distinct()
        open_ = state.filter("NOT resolved")
        open_ = open_.join(met, same_keys([open_[k] for k in QUEUE_KEY], [met[f"_m_{k}"] for k in QUEUE_KEY]), "left_semi")
        return queue_upsert(open_, batch, numbered_after=state)

    return stateful_stream(events, queue, path, ["id"], changes, checkpoint)


def period_hashes(rows: DataFrame, period: str) -> DataFrame:
    """(period, hash) over all rows of each period, whatever their order: digests are added up in four lanes."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in sorted(rows.columns)])
    digest = rows.select(F.col(period).cast("string").alias(period), F.sha2(text, 256).alias("_d"))
    lanes = [F.sum(F.conv(F.substring("_d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return digest.groupBy(period).agg(F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *lanes), 256).alias("hash"))


def reconcile_stream(
    arrivals: DataFrame,
    read_ref: Callable[[DataFrame], DataFrame],
    read_gen: Callable[[DataFrame], DataFrame],
    period: str,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
) -> StreamingQuery:
    """Reconcile the periods that arrive -> state of progress (period, hash, status).

    ``read_ref`` and ``read_gen`` get a table of distinct periods and return the rows of those periods, the
    period column included; both may get a missing period and may leave it out. All periods of a batch are hashed in one
    aggregate, and those whose hash is not what passed before are compared in one keyed job, however many they are;
    the comparison joins only ranges of keys that differ. A period of which neither side has rows is EMPTY.
    """
    schema = f"{period} STRING, hash STRING, status STRING"
    start = arrivals.sparkSession.createDataFrame([], schema)

    def semi(rows: DataFrame, periods: DataFrame) -> DataFrame:
        return rows.join(periods.select(F.col(period).alias("_p")), rows[period].cast("string").eqNullSafe(F.col("_p")), "left_semi")

    def lookup(rows: DataFrame, found: DataFrame, *cols: str) -> DataFrame:
        found = found.select(F.col(period).alias("_p"), *cols)
        return rows.join(found, rows[period].eqNullSafe(found["_p"]), "left").drop("_p")

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        arrived = stage(batch.select(F.col(period).cast("string").alias(period)).distinct(), "arrived")
        hashes = lookup(arrived, period_hashes(read_gen(arrived), period), "hash").withColumn("hash", F.coalesce("hash", F.lit("")))
        before = state.withColumnsRenamed({"hash": "_h", "status": "_s"})
        same = F.coalesce((F.col("hash") == F.col("_h")) & (F.col("_s") == "PASS"), F.lit(False))
        told = stage(lookup(hashes, before, "_h", "_s").select(period, "hash", same.alias("_same")), "hashes")
        changed = told.filter("NOT _same").select(period)
        status = reconcile_periods(semi(read_ref(changed), changed), semi(read_gen(changed), changed), period, keys)
        return lookup(told, status, "status").select(
            period, "hash", F.when(F.col("_same"), "PASS").otherwise(F.coalesce("status", F.lit("EMPTY"))).alias("status")
        )

    return stateful_stream(arrivals, start, path, [period], changes, checkpoint)
