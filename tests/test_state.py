"""Stream state as deltas with levels: contents, replays, bytes written, what is removed."""

from pathlib import Path

from pyspark.sql import functions as F

from tablesteps.streaming import streams as T
from tablesteps.streaming.state import DeltaState, live


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_segments_follow_from_the_batch():
    before = live(-1)
    for n in range(300):
        now = live(n)
        assert now[0][0] == -1 and now[-1][1] == n and all(a[1] + 1 == b[0] for a, b in zip(now, now[1:]))
        assert set(now) - set(before) == {now[-1]} and len(now) <= 1 + 4 * 5  # each batch makes one segment
        before = now


def test_contents_replays_and_purge(spark, tmp_path):
    start = spark.createDataFrame([(k, None if k == 3 else f"v{k}") for k in [*range(6), None]], "k INT, v STRING").coalesce(1)
    state = DeltaState.create(start, str(tmp_path), ["k"])
    want = {k: None if k == 3 else f"v{k}" for k in [*range(6), None]}
    for n in range(10):
        changed = {n % 4: f"n{n}", 100 + n: None, None: f"m{n}"}
        delta = spark.createDataFrame(list(changed.items()), "k INT, v STRING").coalesce(1)
        state.write(n, delta)
        if n in (3, 5):
            state.write(n, delta)  # a batch that failed after writing
        want |= changed
        assert state.newest() == n
        assert {r.k: r.v for r in state.read(n).collect()} == want and state.read(n).count() == len(want)
    held = {f.name for f in tmp_path.iterdir() if f.name.startswith("segment-")}
    assert len(held) <= len({s for n in (7, 8, 9) for s in live(n)})
    again = DeltaState.create(start, str(tmp_path), ["k"])
    assert again.newest() == 9 and DeltaState.open(spark, str(tmp_path)).read(9).count() == len(want)


def test_bytes_follow_the_batch(spark, tmp_path):
    start = spark.range(60_000).select(F.concat(F.lit("N"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1)
    state = DeltaState.create(start, str(tmp_path), ["id"])
    whole = size(tmp_path / "segment-000000000000-000000000000")
    written = []
    for n in range(9):
        state.write(n, start.filter(F.col("id").isin([f"N{n}", f"N{n + 7}"])).withColumn("v", F.lit(f"{n}")))
        first, last = live(n)[-1]
        written.append(size(tmp_path / f"segment-{first + 1:012d}-{last + 1:012d}"))
    assert [k for k, w in enumerate(written) if w > whole / 100] == [3]  # only there is the start table merged in
    assert state.read(8).count() == 60_000


def test_periods_without_a_name_and_without_rows(spark, tmp_path):
    schema = "period STRING, k INT, v DOUBLE"
    ref = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), (None, 1, 1.0), (None, None, 2.0), ("e", 1, 1.0)], schema)
    gen = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 1.5), (None, None, 2.0)], schema)
    arrived = spark.createDataFrame([("a",), ("b",), (None,), ("none",), ("e",)], "period STRING")
    arrived.write.parquet(str(tmp_path / "in"))

    def pick(rows):
        return lambda periods: rows.join(periods.select(F.col("period").alias("p")), rows["period"].eqNullSafe(F.col("p")), "left_semi")

    def run(gen, check):
        stream = spark.readStream.schema(arrived.schema).parquet(str(tmp_path / "in"))
        T.reconcile_stream(stream, pick(ref), pick(gen), "period", str(tmp_path / check), str(tmp_path / f"{check}-c"), ["k"]).awaitTermination()
        return {r.period: r.status for r in T.latest_state(spark, str(tmp_path / check)).collect()}

    assert run(gen, "one") == {"a": "PASS", "b": "FAIL", None: "FAIL", "none": "EMPTY", "e": "FAIL"}
    assert run(ref, "two") == {"a": "PASS", "b": "PASS", None: "PASS", "none": "EMPTY", "e": "PASS"}
