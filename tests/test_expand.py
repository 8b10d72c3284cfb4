"""Interpolation against direct solutions with numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesteps.operators import expand
from tablesteps.queries import load

TABLES = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def spline(x, y, at):
    """Natural cubic spline through a dense linear system."""
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    p, q = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return p * y[k] + q * y[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h[k] ** 2 / 6


def series(seed, n, gap):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.integers(1, gap, n))
    return x - x[0], rng.normal(size=n)


def frame(spark, knots):
    rows = [(key, DAY + dt.timedelta(int(a)), None if b is None else float(b)) for key, (x, y) in knots.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "k STRING, d DATE, value DOUBLE").repartition(4)


def got(out, key):
    rows = sorted((r.period - DAY).days if r.k == key else -1 for r in out if r.k == key)
    assert rows == list(range(rows[0], rows[-1] + 1))
    return [r.value for r in sorted((r for r in out if r.k == key), key=lambda r: r.period)]


@pytest.mark.parametrize("chunk", [5, 100, 4096])
def test_splines_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(expand, "CHUNK", chunk)
    knots = {"long": series(1, 400, 9), "short": series(2, 3, 4), "two": series(3, 2, 5), "one": series(4, 1, 5), None: series(5, 40, 30)}
    out = expand.proc_expand(frame(spark, knots), ["k"], "d", method="spline").collect()
    for key, (x, y) in knots.items():
        want = spline(x, y, np.arange(x[-1] + 1)) if len(x) > 1 else y
        assert np.allclose(got(out, key), want, rtol=0, atol=1e-9)
    lines = expand.proc_expand(frame(spark, knots), ["k"], "d", method="linear").collect()
    for key, (x, y) in knots.items():
        assert np.allclose(got(lines, key), np.interp(np.arange(x[-1] + 1), x, y))


def test_hot_series_and_missing_ends(spark, hot):
    x, y = series(7, 60, 4)
    y = y.tolist()
    y[0], y[-1], y[30] = None, None, float("nan")
    out = expand.proc_expand(frame(spark, {"h": (x, y)}), ["k"], "d", method="spline").collect()
    values = got(out, "h")
    inner = [k for k in range(1, 59) if k != 30]
    want = spline(x[inner], np.array([y[k] for k in inner]), np.arange(x[1], x[58] + 1))
    assert np.allclose(values[x[1] : x[58] + 1], want, atol=1e-9)
    assert values[: x[1]] == [None] * x[1] and set(values[x[58] + 1 :]) == {None}


def test_hours_and_empty(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 30), 1.0), ("a", dt.datetime(2024, 1, 1, 4, 10), 3.0)]
    df = spark.createDataFrame(rows, "k STRING, t TIMESTAMP, value DOUBLE")
    out = expand.proc_expand(df, ["k"], "t", "hour", method="linear").orderBy("period").collect()
    assert [r.value for r in out] == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert expand.proc_expand(df.limit(0), ["k"], "t", "hour").count() == 0
    with pytest.raises(ValueError):
        expand.proc_expand(df, ["k"], "t", method="cubic")


def test_query_of_splines(spark):
    """All users of the events table against numpy."""
    out = {}
    for r in load()["w8_expand_spline"].run(spark, TABLES).collect():
        out.setdefault(r.user_id, []).append((r.period, r.value))
    known = spark.read.parquet(f"{TABLES}/events.parquet").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("value").alias("v")).collect()
    users = {}
    for r in known:
        users.setdefault(r.user_id, {})[r.d.toordinal()] = r.v
    assert set(users) == set(out)
    for user, points in users.items():
        x = np.array(sorted(points))
        y = np.array([points[k] for k in x.tolist()])
        rows = sorted(out[user])
        want = spline(x, y, np.arange(x[0], x[-1] + 1)) if len(x) > 1 else y
        assert len(rows) == x[-1] - x[0] + 1 and np.allclose([v for _, v in rows], want, atol=1e-8)
