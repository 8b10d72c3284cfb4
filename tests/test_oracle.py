"""Every registered query against its SQL on the smallest tables (rows only where there is no SQL)."""

import pytest

from tablesteps.queries import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# no rows of this kind in the smallest tables
EMPTY_AT_SMALLEST = {"c22_secrets_wide"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(load()))
def test_query(spark, con, name):
    problems = compare(spark, con, load()[name], SF)
    if name in EMPTY_AT_SMALLEST:
        problems = [p for p in problems if p != "SQL gives no rows"]
    assert not problems, problems
