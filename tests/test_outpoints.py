"""check_outpoints answers for every outpoint of the lines."""

import os

from coinstrata.plans import catalog, twins

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_outpoint_is_checked(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    asked = {f"{o}:{n}" for o, n in c.execute("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem").fetchall()} | {"0:99"}
    got = catalog.queries()["check_outpoints"](spark, SF).collect()
    assert len(got) == len(asked) and {r.outpoint for r in got} == asked
    # the twin's answers, for all orders instead of one in eleven
    whole = twins.oracle_sql()["check_outpoints"].replace(" WHERE l_orderkey % 11 = 0", "")
    cursor = c.execute(whole)
    names = [d[0] for d in cursor.description]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(cursor.fetchall(), key=str)
