"""Every catalog query against its SQL twin in DuckDB."""

import decimal
import os

import pytest

from coinstrata.plans import catalog, twins

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    return round(v, 9) if isinstance(v, float) else v


def test_each_query_has_a_twin():
    assert set(catalog.QUERIES) == set(twins.BODIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(twins.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    expected = sorted([tuple(plain(r[i]) for i in order) for r in cursor.fetchall()], key=str)
    assert sorted([tuple(plain(v) for v in r) for r in df.select(*columns).collect()], key=str) == expected
