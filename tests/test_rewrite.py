"""Deletes and updates by file: what stays untouched, what a lost driver leaves, and the rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablesteps.sources import rewrite
from tablesteps.sources import sinks as W


def made(spark, tmp_path, name, files=100, parts=()):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.range(0, 10_000, 1, files).select("id", (F.col("id") % 3).cast("string").alias("p"), F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("v"))
    W.create_as(df, name, path=str(tmp_path / "t"), partition_by=parts)
    return df


def held(tmp_path):
    return {f.relative_to(tmp_path / "t").as_posix(): (f.stat().st_ino, f.stat().st_mtime_ns) for f in (tmp_path / "t").rglob("*.parquet")}


def content(df):
    return sorted(tuple(r) for r in df.select("id", "p", F.coalesce("v", F.lit(-1))).collect())


def test_one_row_touches_one_file(spark, tmp_path):
    df = made(spark, tmp_path, "w_cow")
    before = held(tmp_path)
    W.delete_where(spark, "w_cow", "id = :k", {"k": 4711})
    after = held(tmp_path)
    assert len(before) == 100 and sum(after.get(f) == s for f, s in before.items()) == 99 and len(after) == 100
    assert content(spark.table("w_cow")) == content(df.filter("id <> 4711"))
    assert not list((tmp_path / "t").glob("_rewrite-*"))
    W.delete_where(spark, "w_cow", "id = 4711")
    assert held(tmp_path) == after  # nothing to do, nothing written
    W.update_table(spark, "w_cow", {"v": "v + id", "id": "-id"}, "v < 3000 AND p = '1'")
    want = df.filter("id <> 4711").selectExpr("CASE WHEN v < 3000 AND p = '1' THEN -id ELSE id END AS id", "p", "CASE WHEN v < 3000 AND p = '1' THEN v + id ELSE v END AS v")
    assert content(spark.table("w_cow")) == content(want)
    assert sum(held(tmp_path).get(f) == s for f, s in after.items()) >= 80


def test_partitions_move_and_empty(spark, tmp_path):
    df = made(spark, tmp_path, "w_cow_p", files=4, parts=["p"])
    W.update_table(spark, "w_cow_p", {"p": "'a b/c'"}, "id < 10")
    W.delete_where(spark, "w_cow_p", "p = '2'")
    want = df.withColumn("p", F.when(F.col("id") < 10, "a b/c").otherwise(F.col("p"))).filter("p <> '2'")
    assert content(spark.table("w_cow_p")) == content(want)
    W.delete_where(spark, "w_cow_p", "p = 'a b/c' AND id >= 5")
    assert spark.table("w_cow_p").filter("p = 'a b/c'").count() == 5
    W.delete_where(spark, "w_cow_p", "true")
    assert spark.table("w_cow_p").count() == 0


@pytest.mark.parametrize("at", ["before", "after", "half"])
def test_a_lost_driver(spark, tmp_path, monkeypatch, at):
    """Lost before the manifest nothing has changed; lost after it the next call finishes the work."""
    name = f"w_cow_{at}"
    df = made(spark, tmp_path, name, files=10)
    class Lost(Exception):
        pass

    finish, calls = rewrite._Files.finish, []

    def broken(self):
        calls.append(1)
        if len(calls) == 2:
            if at == "half":  # some files have moved
                folder = next((tmp_path / "t").glob("_rewrite-*"))
                plan = json.loads((folder / "manifest.json").read_text())
                (folder / "data" / plan["add"][0]).rename(tmp_path / "t" / plan["add"][0])
                Path(plan["remove"][0].removeprefix("file:")).unlink()
            raise Lost
        finish(self)

    def refused(self, *_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(rewrite._Files, "finish", broken)
        if at == "before":
            m.setattr(rewrite._Files, "write", refused)
        with pytest.raises(Lost):
            W.delete_where(spark, name, "id % 100 = 7")
    if at == "before":
        assert content(spark.table(name)) == content(df)
    W.delete_where(spark, name, "id = 3")
    gone = "id = 3" if at == "before" else "id = 3 OR id % 100 = 7"
    assert content(spark.table(name)) == content(df.filter(f"NOT ({gone})"))
    assert not list((tmp_path / "t").glob("_rewrite-*"))
