"""Session defaults, the shared scratch folder and the hot-group check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_CONF = "tablesteps.hotRows"
HOT_ROWS_DEFAULT = 5_000_000
_LOCAL_SCRATCH: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def build_session(master: str | None = None, app: str = "tablesteps", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; a cluster without the setting
    is an error, because executors could not see that folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SCRATCH[app]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stage`` writes inside the block are removed at its end: write the result before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _SCOPES.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and pins values that depend on task placement, so that a lost executor
    cannot change them. Parquet rather than ``checkpoint()``: later stages prune columns. The table stays
    until the enclosing ``scratch_scope`` ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_rows(spark: SparkSession) -> int:
    """Rows one group may hold before an operator leaves the one-task-per-group plan."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def has_hot_group(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """True if some group of ``by`` holds more than ``limit`` rows.

    Counts all rows, reading only the key columns, with map-side combine. The answer only picks the plan.
    """
    limit = limit if limit is not None else hot_rows(df.sparkSession)
    top = df.select(*by).groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return top > limit


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """NULL-safe equality of two key lists."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])
