"""Hand-computed ledgers, one for each rule."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coinstrata import schemas
from coinstrata.operators import ledger as L
from coinstrata.operators import paging, reorg
from coinstrata.plans import base, explorer, ops
from coinstrata.streaming.sync import load_blocks

T0 = datetime(2024, 1, 1)
H = lambda n: T0 + timedelta(hours=n)


def make(spark, outputs=(), spends=(), pool=(), pool_spends=()):
    """outputs and pool: tx, vout, address, amount, hour; spends: tx, vout, address, spender, hour."""
    return L.Ledger(
        spark.createDataFrame([(t, v, a, x, H(h), h) for t, v, a, x, h in outputs], schemas.OUTPUTS),
        spark.createDataFrame([(t, v, a, s, H(h), h) for t, v, a, s, h in spends], schemas.SPENDS),
        spark.createDataFrame([(t, v, a, x, H(h)) for t, v, a, x, h in pool], schemas.MEMPOOL_OUTPUTS),
        spark.createDataFrame([(t, v, a, s, H(h)) for t, v, a, s, h in pool_spends], schemas.MEMPOOL_SPENDS),
    )


def one(df):
    return {r.address: r.asDict() for r in df.collect()}


def test_first_row_of_an_outpoint_counts(spark):
    led = make(spark, [("t", 0, "a", 10, 1), ("t", 0, "a", 99, 2)])
    r = one(base.balance(led))["a"]
    assert (r["balance_satoshi"], r["confirmed_utxo_count"]) == (10, 1)


def test_dust_and_floor(spark):
    led = make(spark, [("t", i, "a", x, 1) for i, x in enumerate((599, 600, 1000, 1001))])
    assert one(base.balance(led, "a", 600))["a"]["unsafe_fee_satoshi"] == 599
    assert [r.amount for r in base.utxos(led, "a").collect()] == [1001]


def test_confirmed_hides_unconfirmed_in_balances(spark):
    led = make(spark, [("t", 0, "a", 5000, 1)], pool=[("t", 0, "a", 5000, 2)])
    r = one(base.balance(led))["a"]
    assert (r["confirmed_balance_satoshi"], r["mempool_income_satoshi"]) == (5000, 0)
    assert [(x.amount, x.is_mempool) for x in base.utxos(led).collect()] == [(5000, True)]
    assert L.overlay(led.outputs, led.mempool_outputs).count() == 1


def test_unconfirmed_income_of_a_spent_outpoint_is_excluded(spark):
    led = make(spark, spends=[("t", 0, "a", "s", 3)], pool=[("t", 0, "a", 700, 2)])
    assert one(base.balance(led))["a"]["mempool_income_satoshi"] == 0
    assert base.utxos(led).count() == 0


def test_chained_unconfirmed_spend(spark):
    led = make(spark, pool=[("A", 0, "a", 900, 1), ("B", 0, "b", 800, 2)], pool_spends=[("A", 0, "a", "B", 2)])
    r = one(base.balance(led))
    assert r["a"]["balance_satoshi"] == 0 and r["a"]["mempool_utxo_count"] == 1 and r["b"]["balance_satoshi"] == 800
    assert [x.tx_id for x in base.utxos(led).collect()] == ["B"]


def test_history_types(spark):
    led = make(
        spark,
        [("i", 0, "a", 10, 1), ("m", 0, "a", 4, 3), ("k", 0, "a", 7, 1)],
        [("i", 0, "a", "m", 3), ("k", 0, "a", None, 4), ("gone", 1, "a", "z", 5)],
        pool_spends=[("m", 0, "a", "", 6)],
    )
    got = {r.tx_id: (r.type, r.income, r.spend, r.is_mempool) for r in base.history(led, "a").collect()}
    assert got == {
        "i": ("income", 10, 0, False),
        "k": ("income", 7, 0, False),
        "m": ("mixed", 4, 10, False),
        "spend_k:0": ("spend", 0, 7, False),
        "z": ("spend", 0, 0, False),
        "pending_spend_m:0": ("spend", 0, 4, True),
    }
    page = [r.tx_id for r in base.history_page(led, "a", 1, 2).collect()]
    assert page == ["pending_spend_m:0", "z"] and base.history_page(led, "a", 9, 2).count() == 0
    assert base.history_utxos(led, "a").count() == 7


def test_addresses_that_share_a_prefix_stay_apart(spark):
    led = make(spark, [("t", 0, "ab", 10, 1), ("t", 1, "abc", 20, 1)])
    assert one(base.balance(led, "ab")) .keys() == {"ab"}


BLOCK = [
    (100003, "test_hash3", datetime(2021, 6, 11, 18, 57, 36), [
        ("test_tx_hash_1", [("tx03", 1)], [("addr1", 123456)]),
        ("test_tx_hash_2", [("test_tx_hash_2", 0)], [("addr1", 123456)]),
    ]),
]


def test_inherited_block(spark):
    blocks = spark.createDataFrame(BLOCK, schemas.RAW_BLOCKS)
    outputs, spends = load_blocks(blocks)
    assert outputs.count() == 2
    assert [(r.prev_tx_id, r.prev_vout, r.address) for r in spends.collect()] == [("test_tx_hash_2", 0, "addr1")]
    assert [r.tx_id for r in L.unspent(outputs, spends).collect()] == ["test_tx_hash_1"]
    assert [r.tx_id for r in L.spent(outputs, spends).collect()] == ["test_tx_hash_2"]


def test_outputs_without_address(spark):
    blocks = spark.createDataFrame([(1, "h", T0, [("x", [], [("", 5), (None, None), ("a", 7)]), ("y", [("x", 0)], [("b", 5)])])], schemas.RAW_BLOCKS)
    outputs, spends = load_blocks(blocks)
    assert sorted((r.vout, r.address, r.amount_sat) for r in outputs.filter("tx_id = 'x'").collect()) == [(0, "errAddress", 5), (1, "errAddress", 0), (2, "a", 7)]
    assert spends.first().address == "errAddress"
    none = spark.createDataFrame([], schemas.MEMPOOL_OUTPUTS), spark.createDataFrame([], schemas.MEMPOOL_SPENDS)
    assert "errAddress" not in one(base.balance(L.Ledger(outputs, spends, *none)))


def test_outpoint_status(spark):
    led = make(spark, [("t", 0, "a", 10, 1), ("t", 1, "a", 11, 1)], [("t", 0, "a", "s", 2)], [("u", 0, "b", 12, 3)], [("t", 1, "a", "v", 4)])
    asked = spark.createDataFrame([("t:0",), ("t:1",), ("u:0",), ("no:7",), ("bad",)], "outpoint string")
    got = {r.outpoint: (r.is_exist, r["where"], r.value, r.spend_status, r.spend_where, r.spend_tx) for r in base.check_outpoints(led, asked).collect()}
    assert got == {
        "t:0": (True, "block", 10, "spend", "block", "s"),
        "t:1": (True, "block", 11, "spend", "mempool", "v"),
        "u:0": (True, "mempool", 12, "unspent", None, None),
        "no:7": (False, None, 0, "unspent", None, None),
        "bad": (False, None, 0, "unspent", None, None),
    }


def test_totals(spark):
    r = base.totals(make(spark, [("t", 0, "a", 1, 1), ("t", 1, "b", 1, 1)], [("t", 0, "a", "s", 2)])).first()
    assert tuple(r) == (1, 2, 2, 1, 1)


@pytest.mark.parametrize("cursor,size,cap,expected", [(-1, 0, None, range(10)), (0, 500, 100, range(100)), (148, 10, None, [148, 149]), (999, 10, None, [])])
def test_cursor_pages(spark, cursor, size, cap, expected):
    rows = spark.range(150)
    got = [r.id for r in paging.cursor_page(rows, [F.asc("id")], cursor, size, cap).collect()]
    assert got == list(expected)


def test_next_cursor_and_pages(spark):
    assert (paging.next_cursor(25, 0), paging.next_cursor(25, 20), paging.next_cursor(25, 99), paging.total_pages(25, 10)) == (10, 0, 0, 3)
    assert [r.id for r in paging.numbered_page(spark.range(25), [F.asc("id")], 3, 10).collect()] == list(range(20, 25))
    assert [r.id for r in paging.window_below(spark.range(50), "id", 30, 3).collect()] == [30, 29, 28]


def test_fees_ignore_unknown_inputs(spark):
    blocks = spark.createDataFrame(
        [(1, "h", T0, [("cb", [("0" * 64, -1)], [("m", 50)]), ("p", [("q", 0)], [("a", 50), ("a", 60)]), ("f", [("p", 0), ("p", 1), ("lost", 3)], [("b", 100)])])], schemas.RAW_BLOCKS
    )
    outputs, _ = load_blocks(blocks)
    sizes = spark.createDataFrame([("f", 3), ("cb", 100)], "tx_id string, size long")
    got = {r.tx_id: (r.fee_sat, r.fee_rate) for r in explorer.tx_fees(blocks, outputs, sizes).collect()}
    assert got == {"cb": (0, 0), "p": (-110, None), "f": (10, 3)}
    assert tuple(explorer.block_fees(explorer.tx_fees(blocks, outputs)).first()) == (1, -100, 3)
    assert tuple(ops.block_counts(blocks).first()) == (1, 3, 5, 4, 3)
    assert [r.tx_id for r in explorer.block_tx_page(blocks, 1, 1, 1).collect()] == ["p"]
    assert explorer.block_all_txs(blocks, 1).count() == 3


def test_fork_and_rollback(spark):
    stored = spark.createDataFrame([(h, f"x{h}") for h in range(1, 11)], "height long, block_hash string")
    chain = spark.createDataFrame([(h, f"x{h}" if h < 7 else f"y{h}") for h in range(1, 12)], "height long, block_hash string")
    assert tuple(reorg.fork_height(stored, chain).first()) == (7, 4)
    assert reorg.fork_height(stored, stored).first().fork_height is None
    led = make(spark, [("t", h, "a", 1, h) for h in range(1, 11)], [("t", h, "a", "s", h) for h in range(2, 11)])
    kept = reorg.rollback(led, 7)
    assert kept.outputs.agg(F.max("height")).first()[0] == 6 and kept.spends.agg(F.max("height")).first()[0] == 6
    assert reorg.keep_below(led.outputs, reorg.fork_height(stored, chain)).count() == 6
    assert reorg.keep_below(led.outputs, reorg.fork_height(stored, stored)).count() == 10


def test_eviction_deletion_and_last_writer(spark):
    led = make(spark, [("t", 0, "a", 1, 1)], [("q", 0, "a", "t", 1)], [("t", 0, "a", 1, 0), ("n", 0, "a", 1, 0)], [("q", 0, "a", "t", 0), ("t", 0, "a", "n", 0)])
    left = reorg.evict(led)
    assert [r.tx_id for r in left.mempool_outputs.collect()] == ["n"] and [r.prev_tx_id for r in left.mempool_spends.collect()] == ["t"]
    rows = spark.createDataFrame([("k", "v1", 1), ("k", "v2", 2), ("l", "w", 1)], "key string, value string, version int")
    assert sorted(tuple(r) for r in reorg.latest_per_key(rows, ["key"], "version").collect()) == [("k", "v2", 2), ("l", "w", 1)]
    assert reorg.delete_keys(rows, spark.createDataFrame([("k", "v1")], "key string, value string")).count() == 2


def test_logs(spark):
    log = spark.createDataFrame([(i, i, "h", 0, 0, 0, 0, 0, 0, 0, 0, 0, i % 2) for i in range(50)], schemas.INDEXER_LOG)
    assert [r.height for r in ops.index_log_page(log, 2).collect()] == list(range(8, -1, -2))
    changes = spark.createDataFrame([(1, 5, 6, "a", "b", 2, 10, 0), (1, 5, 6, "a", "b", 2, 20, 1)], schemas.REORG_LOG)
    assert [(r.id, r.status) for r in ops.reorg_log_page(changes).collect()] == [(1, 1)]
    errors = spark.createDataFrame([(i, 1, i, "h", i, "m") for i in range(3)], schemas.ERR_LOG)
    assert [r.id for r in ops.error_log_page(errors, 1, 2).collect()] == [2, 1]
    state = spark.createDataFrame([("last_mempool_clean_height", "7"), ("last_mempool_clean_height", "9"), ("other", "99")], "key string, value string")
    assert ops.cleaned_height(state).first().height == 9


def test_block_by_height_or_hash(spark):
    blocks = spark.createDataFrame([(7, "ab" * 32, T0, []), (8, "cd" * 32, T0, [])], schemas.RAW_BLOCKS)
    assert explorer.block_info(blocks, 7).count() == explorer.block_info(blocks, "7").count() == explorer.block_info(blocks, "AB" * 32).count() == 1
