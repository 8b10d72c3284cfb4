"""Files of one name and the same columns are one question."""

from __future__ import annotations

from tablesteps.plans.plan import match_files


def test_each_row_is_answered_by_its_own_columns(spark):
    steps = spark.createDataFrame(
        [("N1", "GG.R1", "output", ["ID", "C1"]), ("N2", "GG.R2", "output", ["ID", "C2"])], "id STRING, dataset STRING, role STRING, columns ARRAY<STRING>"
    )
    files = [("a/r_9.csv", ["ID", "C1"]), ("a/r_9.csv", ["ID", "C2"]), ("b/r_9.csv", ["ID", "C2"]), ("b/r_9.csv", ["ID", "C2"]), ("c/r2.csv", None), ("d/zz.csv", None), (None, None)]
    got = match_files(spark.createDataFrame(files, "path STRING, columns ARRAY<STRING>"), steps).select("path", "dataset", "confidence")
    want = [("a/r_9.csv", "GG.R1", 0.69), ("a/r_9.csv", "GG.R2", 0.69), ("b/r_9.csv", "GG.R2", 0.69), ("b/r_9.csv", "GG.R2", 0.69),
            ("c/r2.csv", "GG.R2", 0.9), ("d/zz.csv", None, 0.0), (None, None, 0.0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
