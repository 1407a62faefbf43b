"""Tokens and NFTs on hand-made ledgers."""

from decimal import Decimal

from pyspark.sql import functions as F

from coinstrata import schemas
from coinstrata.operators import tokens as K
from coinstrata.plans import ft, nft
from coinstrata.streaming.sync import validate_new

Z = schemas.ZERO_SENSIBLE_ID
G_TX = "".join(f"{i:02x}" for i in range(31, -1, -1))
SID = "".join(f"{i:02x}" for i in range(32)) + "02000000"


def out(tx, vout, amount=10, address="a", code="c", gen="g", sid=SID, kind="ft", height=5):
    return (tx, vout, kind, address, code, gen, sid, "n", "s", 8, None if amount is None else Decimal(amount), 546, "d", height, height * 1000)


def spend(tx, vout, used, amount=10, address="a", code="c", gen="g", sid=SID, kind="ft", height=6):
    return (tx, vout, used, kind, address, code, gen, sid, Decimal(amount), 546, height, height * 1000)


def ledger(spark, outputs=(), spends=(), pool=(), pool_spends=(), info=None):
    o = spark.createDataFrame(list(outputs), schemas.TOKEN_OUTPUTS)
    p = spark.createDataFrame(list(pool), schemas.TOKEN_OUTPUTS)
    everything = o.unionByName(p)
    return K.TokenLedger(
        o, spark.createDataFrame(list(spends), schemas.TOKEN_SPENDS), p, spark.createDataFrame(list(pool_spends), schemas.TOKEN_SPENDS), K.token_info(everything) if info is None else info
    )


def test_balance_by_state(spark):
    t = ledger(
        spark,
        [out("t1", 0, 10), out("t1", 0, 10), out("t2", 1, 5), out("t3", 0, 7, address="b")],
        [spend("t1", 0, "t9", 10)],
        [out("m1", 0, 3), out("t2", 1, 5)],
        [spend("t2", 1, "m2", 5), spend("m1", 0, "m3", 3), spend("zz", 0, "m4", 9, address="onlyspend")],
    )
    got = {r.address: r for r in ft.ft_balance(t).collect()}
    a = got["a"]
    assert (a.confirmed, a.unconfirmed_income, a.unconfirmed_spend, a.balance, a.utxo_count) == (5, 3, 8, 0, 2)
    assert (a.unconfirmed_spend_from_confirmed, a.unconfirmed_spend_from_unconfirmed, a.first_outpoint) == (5, 3, "m1:0")
    assert set(got) == {"a", "b"} and got["b"].balance == 7
    assert ft.ft_balance(t, "a", "c", "other").count() == 0


def test_utxos_and_unique(spark):
    t = ledger(spark, [out("t1", 0), out("t2", 0), out("u1", 0, kind="unique")], [spend("t1", 0, "x")], [out("m", 0)], [spend("t2", 0, "y")])
    assert [(r.tx_id, r.height, r.flag, r.symbol) for r in ft.ft_utxos(t).collect()] == [("m", -1, "m_0", "s")]
    assert [(r.tx_id, r.custom_data) for r in ft.ft_unique_utxos(t).collect()] == [("u1", "d")]


def test_supply_floor_and_repeats(spark):
    rows = lambda *x: spark.createDataFrame([("c", "g", f"t{i}", 0, Decimal(a)) for i, a in x], "code_hash string, genesis string, tx_id string, vout int, amount decimal(20,0)")
    got = ft.ft_supply(rows((1, 100), (2, 50), (2, 50)), rows((3, 30))).first()
    assert (got.issued, got.burned, got.supply) == (150, 30, 120)
    assert ft.ft_supply(rows((1, 10)), rows((3, 30))).first().supply == 0


def test_issue_detection(spark):
    genesis = out("g0", 0, 0, sid=Z)
    authority = lambda tx, vout, sid=SID: out(tx, vout, 0, sid=sid)
    other = "11" * 36
    t = ledger(
        spark,
        [genesis, out("t1", 0, 5), authority("t1", 1), out("t1", 2, 9), authority("t2", 0), out("t2", 1, 6), out("t3", 0, 8), out("t4", 0, 4, sid=other), authority("t4", 1), out("t5", 0, 3)],
        [spend("g0", 0, "t1", 0, sid=Z), spend("t1", 1, "t2", 0), spend("t2", 0, "t3", 0), spend("t1", 1, "t4", 0), spend("t1", 0, "t5", 5)],
    )
    got = sorted((r.tx_id, r.vout) for r in K.issues(t.outputs, t.spends).collect())
    assert got == [("t1", 0), ("t3", 0)]
    authorities = {(r.tx_id, r.vout): r.is_spent for r in ft.ft_genesis_utxo(t).collect()}
    assert authorities == {("t1", 1): True, ("t2", 0): True, ("t4", 1): False}
    assert sorted({r.tx_id for r in K.genesis_outputs(t.outputs, t.spends).collect()}) == ["t1"]


def test_lineage_rules(spark):
    g = lambda tx, vout, **k: out(tx, vout, sid=Z, **k)
    unknown = "ee" * 32 + "00000000"
    outputs = [
        out("o_a", 0), out("o_b", 0, gen="g2"), out("o_c", 0, code="c9"), out("o_d", 0, code="c9"), out("o_no", 0), out("o_unused", 0), g("o_zero", 0), out("o_pending", 0, sid=unknown), out("o_late", 0, height=99),
    ]
    start = [g(G_TX, 2)]
    made = [out("first", 0, 7, gen="tokengen"), out("first", 1, 0, code="authcode", gen="authgen")]
    spends = [
        spend(G_TX, 2, "first", 0, sid=Z),
        spend("p", 0, "o_a"),
        spend("p", 1, "o_b", gen="tokengen"),
        spend("p", 2, "o_c", code="authcode", gen="authgen"),
        spend(G_TX, 5, "o_d", code="zz"),
        spend("p", 3, "o_no", code="zz"),
        spend("p", 4, "o_zero"),
        spend("p", 5, "o_pending"),
        spend("p", 6, "o_late"),
    ]
    t = ledger(spark, outputs + start + made, spends)
    at_genesis = K.genesis_outputs(t.outputs, t.spends)
    wanted = t.outputs.filter(F.col("tx_id").startswith("o_"))
    got = {r.tx_id: (r.status, r.reason) for r in K.validate_lineage(wanted, t.spends, K.genesis_rows(t.outputs), at_genesis, 50).collect()}
    assert got == {
        "o_a": ("valid", None), "o_b": ("valid", None), "o_c": ("valid", None), "o_d": ("valid", None), "o_zero": ("valid", None),
        "o_no": ("invalid", schemas.NOT_MATCHED), "o_unused": ("invalid", schemas.NOT_USED), "o_pending": ("pending", None), "o_late": ("pending", None),
    }
    checked = K.validate_lineage(wanted, t.spends, K.genesis_rows(t.outputs), at_genesis, 50)
    assert ft.unchecked_total(checked).first().total == ft.unchecked(checked).count() == 2 and ft.invalid(checked).count() == 2
    again = validate_new(wanted, t.spends, K.genesis_rows(t.outputs), at_genesis, 100, checked.filter("status <> 'pending'"))
    assert [(r.tx_id, r.status) for r in again.collect()] == [("o_late", "valid")]


def test_owners_drop_zero(spark):
    t = ledger(spark, [out("t1", 0, 10), out("t2", 0, 5, address="b"), out("t2", 1, 9, address="d")], [spend("t1", 0, "x", 10)])
    assert [(r.address, r.balance) for r in ft.ft_owners(t, cursor=0, size=1).collect()] == [("d", 9)]
    assert sorted((r.address, r.balance) for r in ft.ft_owners(t).collect()) == [("b", 5), ("d", 9)]
    assert ft.ft_top_owners(t, 1).count() == 1
    assert sorted((r.kind, r.tx_id) for r in ft.ft_owner_tx_data(t, "a").collect()) == [("income", "t1"), ("spend", "t1")]


def test_histories(spark):
    t = ledger(spark, [out("t1", 0, 10, height=1), out("t1", 1, 4, height=1), out("t2", 0, 5, height=2)], [spend("t1", 0, "t2", 10, height=2)], [out("m", 0, 3, height=9)], [spend("t2", 0, "m", 5, height=9)])
    got = [(r.tx_id, r.income, r.outcome) for r in ft.ft_address_history(t, "a", size=2).collect()]
    assert sorted(got) == [("m", 3, 5), ("t2", 5, 10)]
    assert sorted((r.tx_id, r.direction) for r in ft.ft_genesis_history(t).collect()) == [("t1", "income"), ("t2", "income"), ("t2", "outcome")]
    assert [r.tx_id for r in ft.ft_genesis_history(t, cursor=0, size=1).collect()] == ["t2"]
    assert ft.ft_db_address_history(t, "a").count() == 3
    assert [r.used_tx_id for r in ft.used_by(t.spends, "t2").collect()] == ["t2"]


def test_summary_info_and_genesis(spark):
    t = ledger(spark, [out(G_TX, 2, 0, sid=Z), out("i", 0, 7), out("i", 1, 0)], [spend(G_TX, 2, "i", 0, sid=Z)], [out("f", 0, 1, code="new")])
    assert [r.code_hash for r in ft.ft_summary(t).collect()] == ["c", "new"]
    assert ft.ft_info(t, "new", "g").count() == 1
    r = ft.ft_genesis(t, "c", "g").first()
    assert (r.genesis_tx_id, r.genesis_vout, r.issue_tx_id, r.genesis_outputs, r.issue_outpoint) == (G_TX, 2, "i", 2, "i:1")
    supply = ft.ft_supply(K.issues(t.outputs, t.spends), K.burns(t.outputs), K.genesis_outputs(t.outputs, t.spends), t.info).first()
    assert (supply.supply, supply.allow_increase_issues, supply.max_supply) == (7, True, None)
    assert K.burns(spark.createDataFrame([out("b", 0, 5, address=schemas.BURN_ADDRESS), out("b", 1, 0, address=schemas.BURN_ADDRESS)], schemas.TOKEN_OUTPUTS)).count() == 1
    assert ft.dump(t.outputs, [F.asc("tx_id"), F.asc("vout")], 2, 2, code_hash="c").count() == 1


def item(tx, vout, index, address="a", gen="g", height=5, meta="m1"):
    return (tx, vout, address, "c", gen, SID, Decimal(index), Decimal(100), meta, 0, 546, height, height * 1000)


def gone(tx, vout, used, index, address="a", gen="g", height=6):
    return (tx, vout, used, address, "c", gen, Decimal(index), height, height * 1000)


def nfts(spark, outputs=(), spends=(), pool=(), pool_spends=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return K.TokenLedger(make(outputs, schemas.NFT_OUTPUTS), make(spends, schemas.NFT_SPENDS), make(pool, schemas.NFT_OUTPUTS), make(pool_spends, schemas.NFT_SPENDS), None)


def test_nft_index_order_and_range(spark):
    t = nfts(spark, [item("t", 0, 2), item("t", 1, 10), item("t", 2, 9)])
    assert [int(r.token_index) for r in nft.nft_utxos_by_token(t, cursor=0).collect()] == [2, 9, 10]
    assert [int(r.token_index) for r in nft.nft_utxos_by_token(t, "c", "g", least=9, most=10, cursor=0).collect()] == [9, 10]
    assert nft.nft_utxos_by_token(t, index=2).count() == 1
    assert [r.tx_id for r in nft.nft_utxos_by_address(t, "a", cursor=2, size=5).collect()] == ["t"]


def test_nft_listing_readiness(spark):
    t = nfts(spark, [item("h1", 0, 1, "contract"), item("h2", 0, 2, "someone")])
    listing = lambda tx, index, height=7: (tx, 0, "seller", "contract", "c", "g", Decimal(index), Decimal(99), 546, height)
    made = spark.createDataFrame([listing("s1", 1), listing("s2", 2), listing("s4", 1)], schemas.NFT_LISTINGS)
    waiting = spark.createDataFrame([listing("s3", 3)], schemas.NFT_LISTINGS)
    ended = spark.createDataFrame([("s4", 0)], "prev_tx_id string, prev_vout int")
    sales = nft.Listings(made, ended, waiting, ended.limit(0))
    got = [(r.tx_id, r.is_ready, r.height, int(r.price)) for r in nft.nft_sell_by_address(sales, t, "seller", cursor=0).collect()]
    assert got == [("s1", True, 7, 99), ("s2", False, 7, 99), ("s3", False, -1, 99)]
    assert nft.nft_sell_by_token(sales, t, "c", "g", least=2).count() == 2


def test_nft_counts_owners_and_compat(spark):
    t = nfts(spark, [item("t", 0, 1), item("t", 1, 2), item("t", 2, 3, "b")], [gone("t", 0, "x", 1)], [item("m", 0, 1, "b"), item("n", 0, 4, "b")], [gone("n", 0, "y", 4, "b")])
    assert {r.address: r.nft_count for r in nft.nft_count(t).collect()} == {"a": 1, "b": 2}
    assert nft.live(t, strict_compat=True).count() == 4
    assert {r.address: r.nft_count for r in nft.nft_owners(t).collect()} == {"a": 1, "b": 1}
    assert [(int(r.token_index), r.address) for r in nft.nft_holder(t, index=1).collect()] == [(1, "b")]
    summary = {r.address: (r.nft_count, r.meta_tx_id) for r in nft.nft_address_summary(t).collect()}
    assert summary == {"a": (1, "m1"), "b": (2, "m1")}
    assert nft.nft_summary(t.outputs).count() == 1 and nft.nft_top_owners(t, 1).count() == 1
    assert {(r.tx_id, r.direction) for r in nft.nft_history(t, "a").collect()} == {("t", "income"), ("x", "outcome")}
    assert nft.nft_info(t.outputs, t.mempool_outputs, index=4).count() == 1


def test_nft_genesis_authority(spark):
    t = nfts(spark, [item("t", 0, 1, meta=schemas.ZERO_TXID), item("t", 1, 0), item("t", 2, 5)])
    r = nft.nft_genesis(t).first()
    assert (r.genesis_tx_id, r.genesis_vout, r.issue_outpoint) == (G_TX, 2, "t:0")
