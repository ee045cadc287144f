"""Every registered query with SQL gives the SQL's rows (sf0.001); the others run.

ORACLE_ALL=1 runs all of them; by default the model fits are left to the driver's check.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle_check as oc

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
NAMES = [n for n in QUERIES if n in SQL or os.environ.get("ORACLE_ALL")]


@pytest.fixture(scope="module")
def con():
    return oc.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, _, _, info = oc.compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status in ("ok", "rows"), info


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
