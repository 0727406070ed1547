"""Every query against its comparison SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

QS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QS))
def test_query(spark, con, sf, name):
    status, n, note = compare(spark, con, sf, name, QS[name], SQL.get(name))
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["others_out", "work_rate", "injury_pct", "n"] and df.count() > 0
