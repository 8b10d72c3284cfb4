"""Small archives share a batch; a broken one is a row."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa

from tablesteps.queries.storage import _zip
from tablesteps.sources import archives
from tablesteps.sources.archives import _open_all, _open_projects, parse_archives


def _archive(k: int) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("project.xml", "<P><Elements/></P>".encode("utf-16"))
        z.writestr(f"CodeTask-{k}/code.sas", f"code {k}")
    return buffer.getvalue()


def test_small_archives_share_a_batch():
    given = [pa.RecordBatch.from_pydict({"path": [f"{k}.egp" for k in ks], "content": [b"no zip" if k == 7 else _archive(k) for k in ks]}) for ks in ((0, 1, 2), (7, 8))]
    out = list(_open_all(iter(given)))
    assert len(out) == 1
    assert [(r["archive"], r["kind"], r["text"] if r["kind"] == "code" else None) for r in out[0].to_pylist()] == [
        ("0.egp", "code", "code 0"), ("1.egp", "code", "code 1"), ("2.egp", "code", "code 2"), ("7.egp", "error", None), ("8.egp", "code", "code 8")
    ]
    assert list(_open_all(iter([]))) == []


def _project(k: int, code: str = "x") -> bytes:
    """An archive with two edges, one of them twice, and one without a source."""
    deps = "".join(f"<D>{d}</D>" for d in (f"CodeTask-{k}", f"CodeTask-{k}", f" Query-{k}0 ", ""))
    flow = f"<PFD><Process><Element><ID>Query-{k}</ID></Element><Dependencies>{deps}</Dependencies></Process></PFD>"
    task = f"<w><Element><ID>CodeTask-{k}</ID><Type>TASK</Type></Element></w>"
    return _zip([(f"CodeTask-{k}/code.sas", code.encode()), ("project.xml", f"<P><Elements>{task}<w>{flow}</w></Elements></P>".encode("utf-16"))])


def test_edges_need_nothing_but_the_project_file(monkeypatch):
    """The same edges and failures as from whole archives, without a code file read."""
    contents = [_project(0), b"no zip", _zip([("project.xml", b"<P>")]), _project(3)]
    given = pa.RecordBatch.from_pydict({"path": list("abcd"), "content": contents})
    whole = [r for out in _open_all(iter([given])) for r in out.to_pylist()]
    seen, read = [], zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, pwd=None: seen.append(name) or read(self, name, pwd))
    edges = [r for out in _open_projects(iter([given])) for r in out.to_pylist()]
    assert edges == [r for r in whole if r["kind"] in ("dep", "error")] and len(edges) == 10
    assert set(seen) == {"project.xml"}


def test_edges_are_not_staged(spark, monkeypatch):
    files = spark.createDataFrame([("a", bytearray(_project(1))), ("b", bytearray(_project(1, "y")))], "path STRING, content BINARY")
    staged = []
    monkeypatch.setattr(archives, "stage", lambda df, label: staged.append(label) or df)
    found = parse_archives(files)
    edges = sorted(tuple(r) for r in found.deps.collect())
    assert edges == [(a, s, "Query-1") for a in "ab" for s in ("CodeTask-1", "Query-10")] and staged == []
    after = parse_archives(files)
    assert sorted((r["archive"], r["id"], r["code"]) for r in after.nodes().collect()) == [("a", "CodeTask-1", "x"), ("b", "CodeTask-1", "y")]
    assert sorted(tuple(r) for r in after.deps.collect()) == edges and after.orphans.count() == 0 and staged == ["archives"]


def test_made_archives_are_zip_files():
    entries = [("a/ñ.sas", "código".encode()), ("empty", b""), ("project.xml", b"x" * 70000)]
    with zipfile.ZipFile(io.BytesIO(_zip(entries))) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == entries
