"""Project archives (zip files with a UTF-16 ``project.xml`` and code files) to tables.

One archive is one row of ``binaryFile``; a small helper opens it in the task that read it. What
follows (best entry per task, unknown owners, edges) is DataFrame work.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import cached_property
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.operators.joins import pick_best
from tablesteps.session import stage

_ROWS = "archive STRING, kind STRING, id STRING, type STRING, label STRING, container STRING, target STRING, entry STRING, text STRING"
_FIELDS = [c.split()[0] for c in _ROWS.split(", ")]
_TASK = r"(?:^|/)((?:CodeTask|Query)-[^/]*)(?:/|$)"


def _open(archive: str, content: bytes, files: bool = True) -> Iterator[tuple]:
    """Rows of one archive in the order of ``_FIELDS``; without ``files`` only the edges of ``project.xml``."""

    def text(node, tag: str) -> str:
        return (node.findtext(tag) or "").strip()

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("project.xml").decode("utf-16"))
            for wrapper in root.iterfind("Elements/*") if files else ():
                inner = wrapper.find("Element")
                if inner is not None:
                    yield archive, "element", text(inner, "ID"), text(inner, "Type"), text(inner, "Label"), text(inner, "Container"), None, None, None
            for process in root.iterfind("Elements/*/PFD/*"):
                own = process.find("Element")
                for dep in process.iterfind("Dependencies/*") if own is not None else ():
                    yield archive, "dep", (dep.text or "").strip(), None, None, None, text(own, "ID"), None, None
            for name in z.namelist() if files else ():
                kind = "code" if name.endswith(("/code.sas", ".sql")) else "log" if name.endswith("/result.log") else None
                if kind:
                    raw = z.read(name)
                    try:
                        body = raw.decode("utf-8-sig")
                    except UnicodeDecodeError:
                        body = raw.decode("latin-1")
                    yield archive, kind, None, None, None, None, None, name, body
    except Exception as exc:  # noqa: BLE001  a broken archive is a row, not a failed job
        yield archive, "error", None, None, None, None, None, None, f"{type(exc).__name__}: {exc}"


#: Characters of text that the rows of small archives may hold before they are handed on.
_BATCH = 1 << 22


def _open_all(batches: Iterator[pa.RecordBatch], files: bool = True) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.string()) for name in _FIELDS])
    rows: list[tuple] = []
    held = 0

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    for batch in batches:
        paths, contents = batch.column("path"), batch.column("content")
        for k in range(batch.num_rows):  # one archive at a time in memory, and the rows of small ones together
            for row in _open(paths[k].as_py(), contents[k].as_py(), files):
                rows.append(row)
                held += 256 + len(row[-1] or "")
            if held >= _BATCH:
                yield handed()
                rows, held = [], 0
    if held:
        yield handed()


def _open_projects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _open_all(batches, files=False)


class Archives:
    """Tables of a set of archives ``files(path, content)``; every one carries the ``archive`` it came from.

    ``deps`` alone opens nothing but ``project.xml``. The other tables come from all files inside; these are read
    once, when the first such table is asked for, and their rows are staged.
    """

    def __init__(self, files: DataFrame):
        self._files = files.select("path", "content")

    @cached_property
    def _rows(self) -> DataFrame:
        return stage(self._files.mapInArrow(_open_all, _ROWS), "archives")

    @cached_property
    def elements(self) -> DataFrame:
        """(archive, id, type, label, container)"""
        return self._rows.filter("kind = 'element'").select("archive", "id", "type", "label", "container").dropDuplicates(["archive", "id"])

    @cached_property
    def deps(self) -> DataFrame:
        """(archive, source, target)"""
        rows = self._rows if "_rows" in self.__dict__ else self._files.mapInArrow(_open_projects, _ROWS)
        return rows.filter("kind = 'dep' AND id <> '' AND target <> ''").select("archive", F.col("id").alias("source"), "target").distinct()

    @property
    def _owned(self) -> DataFrame:
        owned = self._rows.filter("kind = 'code'").withColumn("id", F.regexp_extract("entry", _TASK, 1)).filter("id <> ''")
        return owned.select("archive", "id", "entry", F.col("text").alias("code"), F.size(F.split("entry", "/")).alias("_depth"))

    @property
    def _tasks(self) -> DataFrame:
        return self.elements.filter("type = 'TASK'").select("archive", "id")

    @cached_property
    def code(self) -> DataFrame:
        """The shortest path per task -> (archive, id, entry, code)."""
        best = pick_best(self._owned, ["archive", "id"], "_depth", ["entry"], largest=False)
        return best.join(self._tasks, ["archive", "id"], "left_semi").drop("_depth")

    @cached_property
    def orphans(self) -> DataFrame:
        """Code of unknown owners, root or snapshot -> (archive, id, entry, place)."""
        place = F.when(F.col("_depth") <= 2, "root").otherwise("snapshot")
        lost = self._owned.join(self._tasks, ["archive", "id"], "left_anti").withColumn("place", place)
        best = pick_best(lost, ["archive", "id", "place"], "_depth", ["entry"], largest=False)
        return best.select("archive", "id", "entry", "place")

    @cached_property
    def logs(self) -> DataFrame:
        """The longest log per query -> (archive, id, text)."""
        logs = self._rows.filter("kind = 'log' AND entry LIKE '%/Log-%'").select(
            "archive", F.substring_index("entry", "/", 1).alias("id"), "entry", "text"
        )
        return pick_best(logs, ["archive", "id"], F.length("text"), ["entry"]).select("archive", "id", "text")

    @cached_property
    def errors(self) -> DataFrame:
        """Archives that could not be read to their end -> (archive, text)."""
        return self._rows.filter("kind = 'error'").select("archive", "text")

    def nodes(self) -> DataFrame:
        """One row per task -> (archive, id, label, container, task_kind, code, native)."""
        tasks = self.elements.filter("type = 'TASK' AND id <> ''")
        kind = F.substring_index("id", "-", 1)
        return tasks.join(self.code.drop("entry"), ["archive", "id"], "left").select(
            "archive", "id", "label", "container", kind.alias("task_kind"), F.coalesce("code", F.lit("")).alias("code"),
            (~kind.isin("CodeTask", "Query")).alias("native"),
        )


def parse_archives(files: DataFrame) -> Archives:
    """``files(path, content)`` -> the archive tables."""
    return Archives(files)


def read_archives(spark: SparkSession, glob: str) -> Archives:
    """Archives below a path or glob."""
    return parse_archives(spark.read.format("binaryFile").load(glob).select("path", "content"))


def log_lines(logs: DataFrame) -> DataFrame:
    """Log texts as numbered lines for the recovery of query code -> (archive, log_id, line_no, line)."""
    return logs.select("archive", F.concat_ws("|", "archive", "id").alias("log_id"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
