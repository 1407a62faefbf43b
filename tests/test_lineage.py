
import os

import pytest

from coinstrata.plans import catalog
from coinstrata.schemas import NOT_MATCHED, NOT_USED

ROOT = os.environ.get("TEST_DATA_ROOT", "/root/testdata")

#: sid is the outpoint that a token's sensible id names, 'zero' for a genesis row, null for an id that can't be read.
RULES = catalog.PRELUDE + f"""
, s AS (
  SELECT code_hash, genesis, arg_min(struct_pack(t := tx_id, v := vout, st := st), struct_pack(h := height, t := CAST(tx_id AS BIGINT), v := vout, st := st)) AS f
  FROM li WHERE l_discount = 0 GROUP BY 1, 2),
named AS (
  SELECT a.*, s.f.t AS gt, s.f.v AS gv, CASE WHEN s.f.t = a.tx_id AND s.f.v = a.vout AND s.f.st = a.st THEN 'zero' ELSE s.f.t || ':' || s.f.v END AS sid
  FROM outs a LEFT JOIN s USING (code_hash, genesis)),
u AS (
  SELECT a.tx_id AS t, a.vout AS v, a.nxt, a.code_hash AS c, a.genesis AS g,
    CASE WHEN s.f.t = a.tx_id AND s.f.v = a.vout AND s.f.st = a.st THEN 'zero' ELSE coalesce(s.f.t || ':' || s.f.v, 'unread ' || a.code_hash || a.genesis) END AS sid
  FROM gone a LEFT JOIN s USING (code_hash, genesis) WHERE a.nxt IS NOT NULL),
z AS (SELECT tx_id || ':' || vout AS point FROM named o WHERE sid = 'zero'),
made AS (
  SELECT DISTINCT u.t || ':' || u.v AS point, o.vout, o.code_hash, o.genesis, coalesce(o.sid, 'unread ' || o.code_hash || o.genesis) AS sid, o.l_tax = 0 AS authority
  FROM u JOIN z ON z.point = u.t || ':' || u.v JOIN named o ON o.tx_id = u.nxt),
pairs AS (
  SELECT o.tx_id, o.vout, u.t IS NOT NULL AS used, coalesce(u.c = o.code_hash AND u.g = o.genesis AND u.sid = coalesce(o.sid, 'unread ' || o.code_hash || o.genesis), FALSE) AS a,
    coalesce(u.c = k.tok.c AND u.g = k.tok.g AND u.sid = k.last, FALSE) AS b, coalesce(u.c = k.auth.c AND u.g = k.auth.g AND u.sid = k.last, FALSE) AS c,
    coalesce(o.sid <> 'zero' AND u.t = o.gt, FALSE) AS d
  FROM named o LEFT JOIN u ON u.nxt = o.tx_id LEFT JOIN LATERAL (
    SELECT max_by(struct_pack(c := m.code_hash, g := m.genesis), m.vout) FILTER (m.code_hash = o.code_hash) AS tok, max_by(struct_pack(c := m.code_hash, g := m.genesis), m.vout) FILTER (m.authority) AS auth,
      max_by(m.sid, m.vout) FILTER (m.code_hash = o.code_hash OR m.authority) AS last
    FROM made m WHERE m.point = o.sid) k ON TRUE),
folded AS (SELECT tx_id, vout, bool_or(used) AS used, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c, bool_or(d) AS d FROM pairs GROUP BY 1, 2),
w AS (
  SELECT amount, CASE WHEN NOT used THEN 'invalid' WHEN sid = 'zero' THEN 'valid' WHEN sid IS NULL OR sid NOT IN (SELECT point FROM z) THEN 'pending'
    WHEN a OR b OR c OR d THEN 'valid' ELSE 'invalid' END AS status, used, a, b, c, d
  FROM named o JOIN folded USING (tx_id, vout)),
v AS (SELECT *, CASE WHEN NOT used THEN '{NOT_USED}' WHEN status = 'invalid' THEN '{NOT_MATCHED}' END AS reason FROM w)
"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lineage_follows_the_rules(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{ROOT}/{sf}/{t}.parquet'")
    expected = c.execute(RULES + "SELECT status, reason, count(*), CAST(sum(amount) AS BIGINT) FROM v GROUP BY 1, 2").fetchall()
    got = [tuple(r) for r in catalog.queries()["ft_lineage_valid"](spark, f"{ROOT}/{sf}").select("status", "reason", "n", "amount").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r[:2] for r in got} == {("valid", None), ("invalid", NOT_MATCHED), ("invalid", NOT_USED), ("pending", None)}
