import tempfile

import pytest

from tablesteps.session import HOT_ROWS_CONF, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Every group of more than four rows counts as hot."""
    spark.conf.set(HOT_ROWS_CONF, "4")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def rows(df, *order):
    cols = sorted(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=repr)
