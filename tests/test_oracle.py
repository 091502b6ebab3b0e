"""Every registered query against its DuckDB twin (row count, columns and
order-insensitive value hash), at sf0.001.  Set PROMOLENS_ORACLE_SF to
another test-data folder to check a larger scale."""

import os

import pytest

from conftest import SMALL

SF = os.environ.get("PROMOLENS_ORACLE_SF", SMALL)


def _names():
    import __spark_entry__ as E
    return sorted(E._queries())


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    own, sql = set(E._queries()), set(E.oracle_sql())
    assert own <= sql and sql <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from oracle_check import digest
    df = E.queries()[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows) == digest(dcols, drows)
