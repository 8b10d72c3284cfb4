"""Row-level delete and update of file tables: only the files that hold affected rows are written again.

The files with affected rows are found through the scan's own file names, read alone, and their new contents
are written to a hidden folder beside them. A manifest of the files to add and to remove is the commit: before it
exists nothing has changed, after it the next call finishes what a lost driver left undone, any number of times.
Readers that run between the two moves may see old and new rows of a file together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HIDDEN = "_rewrite-"
_MANIFEST = "manifest.json"


class _Files:
    """The table's folder through Hadoop's file system."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs
        facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        self.provider, self.root = facts.get("Provider", "").lower(), unquote(facts.get("Location", ""))
        self.parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
        if self.root:
            self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(name)

    def below(self, folder: str) -> list[str]:
        """Data files below a folder, relative to it."""
        found, at, top = [], self.fs.listFiles(self.path(folder), True), self.fs.makeQualified(self.path(folder)).toString()
        while at.hasNext():
            name = at.next().getPath().toString().removeprefix(top).lstrip("/")
            if not any(x.startswith(("_", ".")) for x in name.split("/")):
                found.append(name)
        return found

    def write(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        draft = self.path(name + ".draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.fs.rename(draft, self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def finish(self) -> None:
        """Carries out committed rewrites and removes what others left."""
        for entry in self.fs.listStatus(self.path(self.root)):
            name = entry.getPath().getName()
            if not name.startswith(_HIDDEN):
                continue
            folder = f"{self.root}/{name}"
            if self.fs.exists(self.path(f"{folder}/{_MANIFEST}")):
                plan = json.loads(self.read(f"{folder}/{_MANIFEST}"))
                for file in plan["add"]:
                    source, goal = self.path(f"{folder}/data/{file}"), self.path(f"{self.root}/{file}")
                    if self.fs.exists(source):
                        self.fs.mkdirs(goal.getParent())
                        self.fs.rename(source, goal)
                for file in plan["remove"]:
                    self.fs.delete(self.path(file), False)
            self.fs.delete(self.path(folder), True)


def rewrites_files(spark: SparkSession, table: str) -> bool:
    """Can rows of ``table`` be changed file by file."""
    return _Files(spark, table).provider in ("parquet", "orc")


def rewrite_where(
    spark: SparkSession, table: str, cond: str, change: Callable[[DataFrame, str], DataFrame], params: Mapping[str, object] | None = None
) -> int:
    """Apply ``change(rows, flag)`` to the files that hold rows for which ``cond`` is true -> number of files replaced.

    ``flag`` names a boolean column that is true for those rows; ``change`` sees all rows of the files and
    returns what takes their place, with the flag. One writer at a time.
    """
    files = _Files(spark, table)
    files.finish()
    spark.catalog.refreshTable(table)
    columns = spark.table(table).columns
    flag, file = "_hit", "_file"
    source = spark.table(table).select("*", F.col("_metadata.file_path").alias(file))

    def flagged(rows: DataFrame) -> DataFrame:
        return spark.sql(f"SELECT *, coalesce({cond}, false) AS {flag} FROM {{source}}", args=dict(params or {}), source=rows)

    # names of files: the driver has listed all of them to plan the scan
    hit = sorted(unquote(r[0]) for r in flagged(source).filter(flag).select(file).distinct().collect())
    if not hit:
        return 0
    folder = f"{files.root}/{_HIDDEN}{uuid.uuid4().hex}"
    schema = spark.table(table).schema
    rows = spark.read.format(files.provider).schema(schema).option("basePath", files.root).load(hit).select(*columns)
    writer = change(flagged(rows), flag).select(*columns).write.format(files.provider)
    if files.parts:
        writer = writer.partitionBy(*files.parts)
    writer.save(f"{folder}/data")
    files.write(f"{folder}/{_MANIFEST}", json.dumps({"add": files.below(f"{folder}/data"), "remove": hit}))
    files.finish()
    if files.parts:
        spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)
    return len(hit)
