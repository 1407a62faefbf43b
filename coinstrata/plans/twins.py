"""SQL that gives the rows of the catalog's queries, written from what they mean."""

from __future__ import annotations

from ..schemas import NOT_MATCHED, NOT_USED
from .catalog import ADDRESS, BLOCK, DUST, FLOOR, FORK, LAST_BLOCK, PRELUDE, TOKEN, TX

TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
T = TIME.format("t")
ANTI = "NOT EXISTS (SELECT 1 FROM {0} x WHERE x.tx_id = {1}.tx_id AND x.vout = {1}.vout)"
IN = "EXISTS (SELECT 1 FROM {0} x WHERE x.tx_id = {1}.tx_id AND x.vout = {1}.vout)"

BALANCE = f"""
, rows_ AS (
  SELECT address, amount_sat AS c, CASE WHEN {IN.format('gone', 'a')} THEN amount_sat ELSE 0 END AS s,
         CASE WHEN amount_sat < {DUST} AND {ANTI.format('gone', 'a')} THEN amount_sat ELSE 0 END AS u,
         0 AS m, 0 AS p, 1 AS n, 0 AS pn FROM outs a
  UNION ALL
  SELECT address, 0, 0, CASE WHEN amount_sat < {DUST} THEN amount_sat ELSE 0 END, amount_sat, 0, 0, 0 FROM mouts a
  WHERE {ANTI.format('outs', 'a')} AND {ANTI.format('gone', 'a')}
  UNION ALL
  SELECT g.address, 0, 0, CASE WHEN k.amount_sat < {DUST} THEN -k.amount_sat ELSE 0 END, 0, k.amount_sat, 0, 1
  FROM mgone g JOIN (
    SELECT tx_id, vout, amount_sat FROM outs
    UNION ALL SELECT tx_id, vout, amount_sat FROM mouts a WHERE {ANTI.format('outs', 'a')}) k ON k.tx_id = g.tx_id AND k.vout = g.vout
  WHERE {ANTI.format('gone', 'g')}
  UNION ALL SELECT address, 0, 0, 0, 0, 0, 0, 0 FROM gone UNION ALL SELECT address, 0, 0, 0, 0, 0, 0, 0 FROM mgone
  UNION ALL SELECT address, 0, 0, 0, 0, 0, 0, 0 FROM mouts),
sums AS (
  SELECT address, CAST(sum(c) - sum(s) AS BIGINT) AS b, CAST(sum(m) AS BIGINT) AS m, CAST(sum(p) AS BIGINT) AS p,
         CAST(sum(u) AS BIGINT) AS u, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pn) AS BIGINT) AS pn FROM rows_ GROUP BY address)
SELECT address, b AS confirmed_balance_satoshi, b + m - p AS balance_satoshi, m AS mempool_income_satoshi, p AS mempool_spend_satoshi,
       u AS unsafe_fee_satoshi, b / 1e8 AS confirmed_balance, (b + m - p) / 1e8 AS balance, m / 1e8 AS mempool_income,
       p / 1e8 AS mempool_spend, u / 1e8 AS unsafe_fee, n AS confirmed_utxo_count, pn AS mempool_utxo_count FROM sums
"""

EVENTS = f"""
, amounts AS (
  SELECT tx_id, vout, amount_sat FROM mouts
  UNION ALL SELECT tx_id, vout, amount_sat FROM outs a WHERE {ANTI.format('mouts', 'a')}),
ev AS (
  SELECT address, tx_id, vout, tx_id AS etx, 0 AS rank, 'income' AS kind, t, amount_sat AS amount, FALSE AS mem FROM outs
  UNION ALL SELECT address, tx_id, vout, tx_id, 1, 'income', t, amount_sat, TRUE FROM mouts
  UNION ALL SELECT g.address, g.tx_id, g.vout, coalesce(nxt, 'pending_spend_' || g.tx_id || ':' || g.vout), 2, 'spend', t, coalesce(k.amount_sat, 0), TRUE
    FROM mgone g LEFT JOIN amounts k ON k.tx_id = g.tx_id AND k.vout = g.vout
  UNION ALL SELECT g.address, g.tx_id, g.vout, coalesce(nxt, 'spend_' || g.tx_id || ':' || g.vout), 3, 'spend', t, coalesce(k.amount_sat, 0), FALSE
    FROM gone g LEFT JOIN amounts k ON k.tx_id = g.tx_id AND k.vout = g.vout)
"""
HISTORY = (
    EVENTS
    + f"""
, hist AS (
  SELECT address, etx AS tx_id, CAST(sum(amount) FILTER (kind = 'income') AS BIGINT) AS income, CAST(sum(amount) FILTER (kind = 'spend') AS BIGINT) AS spend,
         arg_min(t, rank * 1000000000000 + epoch(t)) AS t, arg_min(mem, rank * 1000000000000 + epoch(t)) AS is_mempool
  FROM ev GROUP BY 1, 2),
h AS (
  SELECT address, tx_id, {T} AS time, coalesce(income, 0) AS income, coalesce(spend, 0) AS spend,
         CASE WHEN coalesce(income, 0) > 0 AND coalesce(spend, 0) > 0 THEN 'mixed' WHEN coalesce(income, 0) > 0 THEN 'income' ELSE 'spend' END AS type, is_mempool
  FROM hist)
"""
)

FT_LIVE = f"""
, cf AS (SELECT * FROM outs WHERE contract_type = 'ft'), mf AS (SELECT * FROM mouts WHERE contract_type = 'ft'),
gf AS (SELECT * FROM gone WHERE contract_type = 'ft'), pf AS (SELECT * FROM mgone WHERE contract_type = 'ft'),
live AS (SELECT * FROM cf a WHERE {ANTI.format('gf', 'a')}),
fresh AS (SELECT * FROM mf a WHERE {ANTI.format('live', 'a')})
"""
FT_BALANCE = (
    FT_LIVE
    + f"""
, parts_ AS (
  SELECT address, code_hash, genesis, amount AS c, 0 AS m, 0 AS p, 0 AS pc, 0 AS pm, 1 AS n, tx_id || ':' || vout AS op FROM live
  UNION ALL SELECT address, code_hash, genesis, 0, amount, 0, 0, 0, 1, tx_id || ':' || vout FROM fresh
  UNION ALL SELECT address, code_hash, genesis, 0, 0, amount, CASE WHEN {IN.format('live', 'a')} THEN amount ELSE 0 END,
    CASE WHEN {ANTI.format('live', 'a')} AND {IN.format('fresh', 'a')} THEN amount ELSE 0 END, 0, NULL FROM pf a)
SELECT address, code_hash, genesis, CAST(sum(c) AS BIGINT) AS confirmed, CAST(sum(m) AS BIGINT) AS unconfirmed_income,
       CAST(sum(p) AS BIGINT) AS unconfirmed_spend, CAST(sum(pc) AS BIGINT) AS unconfirmed_spend_from_confirmed,
       CAST(sum(pm) AS BIGINT) AS unconfirmed_spend_from_unconfirmed, CAST(sum(n) AS BIGINT) AS utxo_count, min(op) AS first_outpoint,
       CAST(sum(c) + sum(m) - sum(p) AS BIGINT) AS balance, code_hash || '/' || genesis AS sensible_id, genesis AS name, code_hash AS symbol, 8 AS decimals
FROM parts_ GROUP BY address, code_hash, genesis HAVING min(op) IS NOT NULL
"""
)
UNSPENT = f"""
, both_ AS (SELECT * FROM outs UNION ALL SELECT * REPLACE (-1 AS height) FROM mouts),
free AS (
  SELECT * FROM both_ a WHERE {ANTI.format('gone', 'a')} AND {ANTI.format('mgone', 'a')})
"""
ONE = "QUALIFY row_number() OVER (PARTITION BY tx_id, vout ORDER BY height < 0, height) = 1"
OWNERS = """
, signed AS (
  SELECT code_hash, genesis, address, amount FROM outs WHERE contract_type = 'ft'
  UNION ALL SELECT code_hash, genesis, address, -amount FROM gone WHERE contract_type = 'ft'),
owners AS (
  SELECT code_hash, genesis, address, CAST(sum(amount) AS BIGINT) AS balance FROM signed GROUP BY 1, 2, 3 HAVING sum(amount) > 0)
"""
TOKEN_EVENTS = """
, ev AS (
  SELECT {who} AS address, code_hash, genesis, tx_id, vout, 'income' AS direction, epoch_ms(t) AS time, height, amount FROM outs
  UNION ALL SELECT {who}, code_hash, genesis, nxt, vout, 'outcome', epoch_ms(t), height, amount FROM gone WHERE nxt IS NOT NULL
  UNION ALL SELECT {who}, code_hash, genesis, tx_id, vout, 'income', epoch_ms(t), -1, amount FROM mouts
  UNION ALL SELECT {who}, code_hash, genesis, nxt, vout, 'outcome', epoch_ms(t), -1, amount FROM mgone WHERE nxt IS NOT NULL)
"""
EV, NEV = TOKEN_EVENTS.format(who="address"), TOKEN_EVENTS.format(who="CAST(l_suppkey AS VARCHAR)")
FIRST_EVENT = "QUALIFY row_number() OVER (PARTITION BY address, code_hash, genesis, tx_id, direction ORDER BY height DESC, time, vout, amount) = 1"
INDEX = "CAST(l_partkey AS DECIMAL(20,0)) AS token_index"
NFT = f"""tx_id, vout, CAST(l_suppkey AS VARCHAR) AS address, code_hash, genesis, code_hash || '/' || genesis AS sensible_id, {INDEX},
  CAST(1000 AS DECIMAL(20,0)) AS token_supply, 'm' || l_partkey AS meta_tx_id, CAST(0 AS BIGINT) AS meta_vout, amount_sat AS value_sat, height"""
NFT_LIVE = UNSPENT + f", nl AS (SELECT {NFT}, l_partkey, tx_id || '_' || vout AS flag FROM free {ONE})"
HOLDER = NFT_LIVE + """
, hold AS (
  SELECT code_hash, genesis, token_index, address, tx_id, vout, height, l_partkey FROM nl
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (height < 0) DESC, height DESC, tx_id DESC, vout DESC) = 1)
"""
SELLS = HOLDER + f"""
, sells AS (
  SELECT a.tx_id, a.vout, a.address AS seller, CAST(a.l_suppkey AS VARCHAR) AS contract_address, a.code_hash, a.genesis, CAST(a.l_partkey AS DECIMAL(20,0)) AS token_index,
    CAST(amount_sat AS DECIMAL(20,0)) AS price, amount_sat AS value_sat, a.height, h.address AS holder,
    coalesce(h.address = CAST(a.l_suppkey AS VARCHAR), FALSE) AS is_ready, a.tx_id || '_' || a.vout AS flag, a.l_partkey
  FROM (SELECT * FROM both_ WHERE vout >= 6 {ONE.replace('QUALIFY', 'AND ' + ANTI.format('gone', 'both_') + ' AND ' + ANTI.format('mgone', 'both_') + ' QUALIFY')}) a LEFT JOIN hold h ON h.l_partkey = a.l_partkey)
"""
NFT_OWNERS = """
, signed AS (
  SELECT code_hash, genesis, CAST(l_suppkey AS VARCHAR) AS address, 1 AS n FROM outs
  UNION ALL SELECT code_hash, genesis, CAST(l_suppkey AS VARCHAR), -1 FROM gone),
owners AS (SELECT code_hash, genesis, address, CAST(sum(n) AS BIGINT) AS nft_count FROM signed GROUP BY 1, 2, 3 HAVING sum(n) > 0)
"""
BLOCKS = ", blk AS (SELECT height, sha256(CAST(height AS VARCHAR)) AS block_hash, CAST(count(DISTINCT tx_id) AS INTEGER) AS tx_count, CAST(sum(amount_sat) AS BIGINT) AS reward_sat FROM outs GROUP BY height)"
LISTED = """
, once AS (SELECT code_hash, genesis, tx_id, vout, CAST(min(amount) AS BIGINT) AS amount FROM raw WHERE {test} GROUP BY 1, 2, 3, 4)
"""
ISSUED, BURNT = "l_discount = 0", "round(l_tax, 2) = 0.08"
STREAM = """
, span AS (SELECT min(height) AS lo, (max(height) - min(height)) // 4 + 1 AS w FROM outs),
bo AS (
  SELECT tx_id, row_number() OVER (PARTITION BY height, tx_id ORDER BY vout) - 1 AS vout, address, amount_sat, height, t, (height - lo) // w AS batch FROM outs, span),
fo AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY tx_id, vout ORDER BY height, (SELECT 1)) = 1),
ins AS (
  SELECT DISTINCT g.tx_id, g.vout, b.batch FROM gone g JOIN (SELECT DISTINCT tx_id, batch FROM bo) b ON b.tx_id = g.nxt),
sp AS (SELECT DISTINCT i.tx_id, i.vout FROM ins i JOIN bo ON bo.tx_id = i.tx_id AND bo.vout = i.vout AND bo.batch <= i.batch),
sg AS (
  SELECT address, amount_sat AS a, 1 AS m, 0 AS s FROM fo
  UNION ALL SELECT address, -amount_sat, 0, 1 FROM fo JOIN sp ON sp.tx_id = fo.tx_id AND sp.vout = fo.vout)
SELECT address, CAST(sum(a) AS BIGINT) AS balance_sat, CAST(sum(m) AS BIGINT) AS outputs, CAST(sum(s) AS BIGINT) AS spends FROM sg GROUP BY address
"""

OF_TOKEN = f"code_hash = '{TOKEN[0]}' AND genesis = '{TOKEN[1]}'"
#: The rules of lineage over the genesis rows of the star tables. sid is the outpoint that a token's sensible id names,
#: 'zero' for a genesis row, null for an id that can't be read.
LINEAGE = f"""
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
  SELECT o.tx_id, o.vout, o.code_hash, o.genesis, amount, CASE WHEN NOT used THEN 'invalid' WHEN sid = 'zero' THEN 'valid' WHEN sid IS NULL OR sid NOT IN (SELECT point FROM z) THEN 'pending'
    WHEN a OR b OR c OR d THEN 'valid' ELSE 'invalid' END AS status, used, a, b, c, d
  FROM named o JOIN folded USING (tx_id, vout)),
v AS (SELECT *, CASE WHEN NOT used THEN '{NOT_USED}' WHEN status = 'invalid' THEN '{NOT_MATCHED}' END AS reason FROM w)
"""

BODIES = {
    "balance_all": BALANCE,
    "balance_one": BALANCE + f" WHERE address = '{ADDRESS}'",
    "utxos_unspent": f"""
SELECT address, tx_id, vout AS "index", amount_sat AS amount, TRUE AS is_mempool FROM mouts a WHERE {ANTI.format('gone', 'a')} AND {ANTI.format('mgone', 'a')}
UNION ALL
SELECT address, tx_id, vout, amount_sat, FALSE FROM outs a
WHERE amount_sat > {FLOOR} AND {ANTI.format('mouts', 'a')} AND {ANTI.format('gone', 'a')} AND {ANTI.format('mgone', 'a')}""",
    "spent_outpoints": f"SELECT address, tx_id || ':' || vout AS outpoint, {T} AS time, nxt AS spend_tx_id FROM gone",
    "utxo_by_tx": f"SELECT tx_id, vout, address, amount_sat, {T} AS time FROM outs WHERE tx_id = '{TX}'",
    "mempool_utxos": f"SELECT address, tx_id || ':' || vout AS outpoint, amount_sat AS amount, {T} AS time FROM mouts",
    "history_tx": HISTORY + " SELECT * FROM h",
    "history_page": HISTORY + " SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY address ORDER BY time DESC, tx_id) BETWEEN 6 AND 10",
    "history_utxo_events": EVENTS + f""" SELECT address, tx_id, vout AS "index", amount, kind AS type, {T} AS time, mem AS is_mempool FROM ev""",
    "check_outpoints": f"""
, asked AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS tx_id, l_linenumber AS vout FROM lineitem UNION ALL SELECT '0', 99)
SELECT q.tx_id || ':' || q.vout AS outpoint, (c.tx_id IS NOT NULL OR m.tx_id IS NOT NULL) AS is_exist,
  CASE WHEN c.tx_id IS NOT NULL THEN 'block' WHEN m.tx_id IS NOT NULL THEN 'mempool' END AS "where", c.tx_id IS NOT NULL AS tx_confirm,
  coalesce(c.address, m.address) AS address, coalesce(c.amount_sat, m.amount_sat, 0) AS value, {TIME.format('coalesce(c.t, m.t)')} AS time,
  CASE WHEN s.tx_id IS NOT NULL OR p.tx_id IS NOT NULL THEN 'spend' ELSE 'unspent' END AS spend_status,
  CASE WHEN s.tx_id IS NOT NULL THEN 'block' WHEN p.tx_id IS NOT NULL THEN 'mempool' END AS spend_where,
  CASE WHEN s.tx_id IS NOT NULL THEN s.nxt ELSE p.nxt END AS spend_tx
FROM asked q LEFT JOIN outs c ON c.tx_id = q.tx_id AND c.vout = q.vout LEFT JOIN mouts m ON m.tx_id = q.tx_id AND m.vout = q.vout
LEFT JOIN gone s ON s.tx_id = q.tx_id AND s.vout = q.vout LEFT JOIN mgone p ON p.tx_id = q.tx_id AND p.vout = q.vout""",
    "ledger_totals": """
SELECT (SELECT count(DISTINCT tx_id) FROM outs) AS transactions, (SELECT count(*) FROM (SELECT DISTINCT tx_id, vout FROM outs)) AS outputs,
  (SELECT count(DISTINCT address) FROM outs) AS addresses, (SELECT count(*) FROM (SELECT DISTINCT tx_id, vout FROM gone)) AS spends,
  (SELECT count(DISTINCT address) FROM gone) AS spending_addresses""",
    "dedup_first_wins": "SELECT tx_id, vout, st AS status, address, amount_sat, height FROM li",
    "ft_balance": FT_BALANCE,
    "ft_utxos": UNSPENT + f"""
SELECT address, code_hash, genesis, tx_id, vout, amount, amount_sat AS value_sat, height, code_hash || '/' || genesis AS sensible_id, genesis AS name,
  code_hash AS symbol, 8 AS decimals, tx_id || '_' || vout AS flag FROM free WHERE contract_type = 'ft' {ONE}""",
    "ft_unique_utxos": UNSPENT + f"""
SELECT code_hash, genesis, tx_id, vout, code_hash || '/' || genesis AS sensible_id, CAST(l_partkey AS VARCHAR) AS custom_data, amount_sat AS value_sat, height
FROM free WHERE contract_type = 'unique' {ONE}""",
    "ft_info": " SELECT DISTINCT p_brand AS code_hash, p_type AS genesis, p_brand || '/' || p_type AS sensible_id, p_type AS name, p_brand AS symbol, 8 AS decimals FROM part",
    "ft_summary_page": """ SELECT DISTINCT p_brand AS code_hash, p_type AS genesis, p_brand || '/' || p_type AS sensible_id, p_type AS name, p_brand AS symbol, 8 AS decimals
FROM part ORDER BY sensible_id, code_hash, genesis LIMIT 20 OFFSET 10""",
    "ft_supply": f"""
, i AS (SELECT code_hash, genesis, min(amount) AS a FROM raw WHERE {ISSUED} GROUP BY code_hash, genesis, tx_id, vout),
b AS (SELECT code_hash, genesis, min(amount) AS a FROM raw WHERE {BURNT} GROUP BY code_hash, genesis, tx_id, vout),
u AS (SELECT code_hash, genesis, a AS x, 0 AS y FROM i UNION ALL SELECT code_hash, genesis, 0, a FROM b)
SELECT code_hash, genesis, CAST(sum(x) AS BIGINT) AS issued, CAST(sum(y) AS BIGINT) AS burned, CAST(greatest(sum(x) - sum(y), 0) AS BIGINT) AS supply FROM u GROUP BY 1, 2""",
    "ft_owners": OWNERS + " SELECT * FROM owners",
    "ft_owners_topk": OWNERS + " SELECT * FROM owners QUALIFY row_number() OVER (PARTITION BY code_hash, genesis ORDER BY balance DESC, address) <= 10",
    "ft_owner_tx_data": """
SELECT address, code_hash, genesis, tx_id, vout, amount, 'income' AS kind FROM outs WHERE contract_type = 'ft'
UNION ALL SELECT address, code_hash, genesis, tx_id, vout, amount, 'spend' FROM gone WHERE contract_type = 'ft'""",
    "ft_address_history": EV + """
, r AS (SELECT address, tx_id, code_hash, genesis, CAST(coalesce(sum(amount) FILTER (direction = 'income'), 0) AS BIGINT) AS income,
  CAST(coalesce(sum(amount) FILTER (direction = 'outcome'), 0) AS BIGINT) AS outcome FROM ev GROUP BY 1, 2, 3, 4),
x AS (SELECT address, tx_id, coalesce(max(time) FILTER (height >= 0), max(time)) AS time, max(height) AS height, bool_or(direction = 'income') AS is_income,
  bool_or(direction = 'outcome') AS is_outcome FROM ev GROUP BY 1, 2),
p AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY address ORDER BY time DESC, tx_id) <= 5)
SELECT address, tx_id, time, height, is_income, is_outcome, code_hash, genesis, income, outcome FROM p JOIN r USING (address, tx_id)""",
    "ft_genesis_history": EV + """
SELECT code_hash, genesis, tx_id, direction, time, height FROM ev WHERE height >= 0
QUALIFY row_number() OVER (PARTITION BY code_hash, genesis, tx_id, direction ORDER BY time, height) = 1""",
    "ft_supply_list": LISTED.format(test=ISSUED) + " SELECT * FROM once",
    "ft_burn_list": LISTED.format(test=BURNT) + " SELECT * FROM once ORDER BY code_hash || '@' || genesis || '@' || tx_id || '@' || vout LIMIT 50 OFFSET 20",
    "ft_db_address_history": EV + f" SELECT address, code_hash, genesis, tx_id, direction, time, height FROM ev WHERE height >= 0 {FIRST_EVENT}",
    "ft_used": " SELECT nxt AS used_tx_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM gone WHERE nxt IS NOT NULL GROUP BY 1",
    "ft_lineage_valid": LINEAGE + " SELECT status, reason, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM v GROUP BY 1, 2",
    "ft_unchecked": LINEAGE + " SELECT lpad(tx_id, 64, '0') AS tx_id, vout, code_hash, genesis, amount FROM v WHERE status = 'pending'",
    "ft_unchecked_total": LINEAGE + " SELECT count(*) AS total FROM v WHERE status = 'pending'",
    "ft_invalid": LINEAGE + " SELECT lpad(tx_id, 64, '0') AS tx_id, vout, code_hash, genesis, reason FROM v WHERE status = 'invalid'",
    # rows of other tokens are no rows for this question, in outputs and spends alike
    "ft_utxos_of_token": f"""
, tg AS (SELECT tx_id, vout FROM gone WHERE {OF_TOKEN} UNION ALL SELECT tx_id, vout FROM mgone WHERE {OF_TOKEN}),
both_ AS (SELECT * FROM outs WHERE {OF_TOKEN} UNION ALL SELECT * REPLACE (-1 AS height) FROM mouts WHERE {OF_TOKEN})
SELECT address, code_hash, genesis, tx_id, vout, amount, amount_sat AS value_sat, height, code_hash || '/' || genesis AS sensible_id, genesis AS name,
  code_hash AS symbol, 8 AS decimals, tx_id || '_' || vout AS flag FROM both_ a WHERE contract_type = 'ft' AND {ANTI.format('tg', 'a')} {ONE}""",
    "ft_balance_one": f"{FT_BALANCE.rstrip()} AND address = '{ADDRESS}'",
    "ft_genesis_rows": LINEAGE + " SELECT lpad(tx_id, 64, '0') AS tx_id, vout, code_hash, genesis, height FROM named WHERE sid = 'zero'",
    "ft_issue_authorities": f" SELECT tx_id, vout, code_hash, genesis, {IN.format('gone', 'a')} AS is_spent FROM outs a WHERE l_tax = 0",
    "ft_spends_resolved": f"""
SELECT a.tx_id AS prev_tx_id, a.vout AS prev_vout, g.nxt AS used_tx_id, a.address, a.code_hash, a.genesis, a.amount
FROM gone g JOIN outs a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL AND a.contract_type = 'ft'""",
    "unique_spends_resolved": f"""
SELECT a.tx_id AS prev_tx_id, a.vout AS prev_vout, g.nxt AS used_tx_id, a.code_hash, a.genesis, CAST(a.l_partkey AS VARCHAR) AS custom_data
FROM gone g JOIN outs a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL AND a.contract_type = 'unique'""",
    "ft_mempool_spends": f"""
, known AS (SELECT * FROM outs UNION ALL SELECT * FROM mouts a WHERE {ANTI.format('outs', 'a')})
SELECT a.tx_id AS prev_tx_id, a.vout AS prev_vout, g.nxt AS used_tx_id, a.contract_type, a.address, a.code_hash, a.genesis, a.amount
FROM mgone g JOIN known a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL""",
    "nft_mempool_parents": f"""
, known AS (SELECT *, 0 AS source FROM outs UNION ALL SELECT *, CASE WHEN vout < 6 THEN 1 ELSE 2 END FROM mouts a WHERE {ANTI.format('outs', 'a')})
SELECT a.code_hash, a.genesis, a.source, count(*) AS n, CAST(sum(a.l_partkey) AS BIGINT) AS indexes
FROM mgone g JOIN known a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL GROUP BY 1, 2, 3""",
    "nft_spends_by_address": """
SELECT CAST(a.l_suppkey AS VARCHAR) AS address, a.code_hash, a.genesis, CAST(a.l_partkey AS DECIMAL(20,0)) AS token_index, a.tx_id AS prev_tx_id, a.vout AS prev_vout, g.nxt AS used_tx_id
FROM gone g JOIN outs a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL""",
    "nft_sell_spends_by_address": """
SELECT a.address AS seller, a.code_hash, a.genesis, CAST(a.l_partkey AS DECIMAL(20,0)) AS token_index, CAST(a.amount_sat AS DECIMAL(20,0)) AS price, a.tx_id AS prev_tx_id, a.vout AS prev_vout, g.nxt AS used_tx_id
FROM gone g JOIN outs a ON a.tx_id = g.tx_id AND a.vout = g.vout WHERE g.nxt IS NOT NULL AND a.vout >= 6""",
    "nft_utxos_by_address": NFT_LIVE + " SELECT * EXCLUDE (l_partkey) FROM nl",
    "nft_holder_fast": HOLDER + " SELECT * EXCLUDE (l_partkey) FROM hold",
    "nft_utxos_by_token_range": NFT_LIVE + " SELECT * EXCLUDE (l_partkey) FROM nl WHERE l_partkey BETWEEN 10 AND 150",
    "nft_sell_by_address": SELLS + " SELECT * EXCLUDE (l_partkey) FROM sells",
    "nft_sell_by_token": SELLS.replace("vout >= 6", "vout >= 6 AND l_partkey BETWEEN 1 AND 100") + " SELECT * EXCLUDE (l_partkey) FROM sells ORDER BY l_partkey, tx_id, vout LIMIT 50",
    "nft_count": NFT_LIVE + " SELECT address, count(*) AS nft_count FROM nl GROUP BY 1",
    "nft_address_summary": NFT_LIVE + """
SELECT address, code_hash, genesis, any_value(sensible_id) AS sensible_id, any_value(token_supply) AS token_supply, arg_min(meta_tx_id, struct_pack(a := tx_id, b := vout)) AS meta_tx_id,
  any_value(meta_vout) AS meta_vout, count(*) AS nft_count FROM nl GROUP BY 1, 2, 3""",
    "nft_summary": """
SELECT code_hash, genesis, code_hash || '/' || genesis AS sensible_id, CAST(1000 AS DECIMAL(20,0)) AS token_supply, 'm' || min(l_partkey) AS meta_tx_id, CAST(0 AS BIGINT) AS meta_vout
FROM outs GROUP BY 1, 2""",
    "nft_info": f"""
SELECT DISTINCT code_hash, genesis, {INDEX}, code_hash || '/' || genesis AS sensible_id, CAST(1000 AS DECIMAL(20,0)) AS token_supply, 'm' || l_partkey AS meta_tx_id, CAST(0 AS BIGINT) AS meta_vout
FROM li""",
    "nft_owners": NFT_OWNERS + " SELECT * FROM owners",
    "nft_owners_topk": NFT_OWNERS + " SELECT * FROM owners QUALIFY row_number() OVER (PARTITION BY code_hash, genesis ORDER BY nft_count DESC, address) <= 5",
    "nft_history": NEV + f" SELECT address, code_hash, genesis, tx_id, direction, time, height FROM ev {FIRST_EVENT}",
    "block_list": BLOCKS + f" SELECT * FROM blk WHERE height <= {LAST_BLOCK} ORDER BY height DESC LIMIT 30",
    "block_tx_page": f"""
, x AS (SELECT DISTINCT height, tx_id FROM outs WHERE height = {BLOCK}), y AS (SELECT height, CAST(row_number() OVER (ORDER BY tx_id) - 1 AS INTEGER) AS tx_pos, tx_id FROM x)
SELECT * FROM y WHERE tx_pos BETWEEN 2 AND 6""",
    "block_fees": """
, ins AS (SELECT g.nxt AS tx_id, sum(o2.amount_sat) AS a FROM gone g JOIN outs o2 ON o2.tx_id = g.tx_id AND o2.vout = g.vout WHERE g.nxt IS NOT NULL GROUP BY 1),
x AS (SELECT height, tx_id, sum(amount_sat) AS a FROM outs GROUP BY 1, 2)
SELECT height, CAST(sum(coalesce(ins.a, 0) - x.a) AS BIGINT) AS fees_sat, count(*) AS tx_count FROM x LEFT JOIN ins USING (tx_id) GROUP BY height""",
    "block_info": BLOCKS + f" SELECT * FROM blk WHERE height = {BLOCK}",
    "block_info_by_hash": BLOCKS + f" SELECT * FROM blk WHERE block_hash = sha256('{BLOCK}')",
    "block_all_txs": f"""
, x AS (SELECT DISTINCT height, tx_id FROM outs WHERE height = {BLOCK})
SELECT height, CAST(row_number() OVER (ORDER BY tx_id) - 1 AS INTEGER) AS tx_pos, tx_id FROM x""",
    "fee_rates": f"""
, ins AS (SELECT g.nxt AS tx_id, count(*) AS c, count(o2.tx_id) AS k, coalesce(sum(o2.amount_sat), 0) AS a
  FROM gone g LEFT JOIN outs o2 ON o2.tx_id = g.tx_id AND o2.vout = g.vout WHERE g.nxt IS NOT NULL GROUP BY 1),
x AS (SELECT height, tx_id, sum(amount_sat) AS a, count(*) AS n FROM outs GROUP BY 1, 2),
z AS (SELECT tx_id, CAST(sum(coalesce(c, 0) * 148 + n * 34 + 10) AS BIGINT) AS size FROM x LEFT JOIN ins USING (tx_id) GROUP BY 1)
SELECT height, tx_id, CAST(coalesce(ins.a, 0) - x.a AS BIGINT) AS fee_sat, size, CAST(trunc((coalesce(ins.a, 0) - x.a) / size) AS BIGINT) AS fee_rate
FROM x LEFT JOIN ins USING (tx_id) JOIN z USING (tx_id) WHERE height <= {LAST_BLOCK}""",
    "block_counts": """
, ins AS (SELECT nxt AS tx_id, count(*) AS n FROM gone WHERE nxt IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT height, tx_id FROM outs),
i AS (SELECT height, count(*) AS tx_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS inputs FROM x LEFT JOIN ins USING (tx_id) GROUP BY 1)
SELECT height, any_value(tx_count) AS tx_count, any_value(inputs) AS inputs, count(*) AS outputs, count(DISTINCT address) AS addresses FROM outs JOIN i USING (height) GROUP BY height""",
    "chain_info": BLOCKS + " SELECT max(height) AS max_height, count(*) AS blocks FROM blk",
    "miner_tag": r"""
, s AS (SELECT p_partkey AS part, regexp_extract_all(chr(3) || '/' || replace(p_name, ' ', '/') || '/' || p_brand || chr(1) || '.' || p_type, '[0-9a-zA-Z.-]+') AS runs FROM part),
u AS (SELECT part, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos FROM s)
SELECT part, run AS miner FROM u QUALIFY row_number() OVER (PARTITION BY part ORDER BY length(run) DESC, pos) = 1""",
    "reorg_detect": BLOCKS + f" SELECT min(height) AS fork_height, count(*) AS reorg_size FROM blk WHERE height >= {FORK}",
    "reorg_rollback": f"""
SELECT 'outputs' AS kind, count(*) AS n, max(height) AS max_height, CAST(sum(amount_sat) AS BIGINT) AS amount_sat FROM outs WHERE height < (SELECT min(height) FROM outs WHERE height >= {FORK})
UNION ALL SELECT 'spends', count(*), max(height), 0 FROM gone WHERE height < (SELECT min(height) FROM outs WHERE height >= {FORK})""",
    "mempool_evict": f"""
SELECT 'outputs' AS kind, address, count(*) AS n FROM mouts a WHERE {ANTI.format('outs', 'a')} GROUP BY 2
UNION ALL SELECT 'spends', address, count(*) FROM mgone a WHERE {ANTI.format('gone', 'a')} GROUP BY 2""",
    "events_daily": " SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "log_page": BLOCKS + " SELECT * FROM blk ORDER BY height DESC LIMIT 20 OFFSET 40",
    "stream_ledger_final": STREAM,
}


def oracle_sql() -> dict[str, str]:
    return {name: PRELUDE + body for name, body in BODIES.items()}
