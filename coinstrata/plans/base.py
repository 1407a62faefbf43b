"""Queries on the base ledger. Each answers for one address or, without one, for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coins, outpoint, outpoint_parts, time_text
from ..operators.ledger import Ledger, first_per, outpoint_states
from ..operators.paging import numbered_page, page_for_each
from ..schemas import DUST, SPENDABLE_FLOOR


def _total(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast("bigint")


def balance(ledger: Ledger, address: str | None = None, dust: int = DUST) -> DataFrame:
    """Confirmed and unconfirmed balance. An unconfirmed output counts unless it is confirmed or its outpoint is spent;
    confirmed_utxo_count counts all received outputs and mempool_utxo_count unconfirmed spends, as users know them."""
    s = outpoint_states(ledger.of(address))
    confirmed, fresh = F.col("confirmed_sat"), F.when(F.col("confirmed_sat").isNull() & ~F.col("is_spent"), F.col("mempool_sat"))
    pending = F.when(F.col("is_mempool_spent") & ~F.col("is_spent"), F.coalesce(confirmed, F.col("mempool_sat")))
    small = lambda x: F.when(x < dust, x)
    sums = s.groupBy("address").agg(
        (_total(confirmed) - _total(F.when(F.col("is_spent"), confirmed))).alias("confirmed_balance_satoshi"),
        F.count(confirmed).alias("confirmed_utxo_count"),
        _total(fresh).alias("mempool_income_satoshi"),
        _total(pending).alias("mempool_spend_satoshi"),
        F.count(pending).alias("mempool_utxo_count"),
        (_total(small(F.when(~F.col("is_spent"), confirmed))) + _total(small(fresh)) - _total(small(pending))).alias("unsafe_fee_satoshi"),
    )
    sums = sums.withColumn("balance_satoshi", F.expr("confirmed_balance_satoshi + mempool_income_satoshi - mempool_spend_satoshi"))
    whole = {"confirmed_balance_satoshi": "confirmed_balance", "balance_satoshi": "balance", "mempool_income_satoshi": "mempool_income", "mempool_spend_satoshi": "mempool_spend", "unsafe_fee_satoshi": "unsafe_fee"}
    return sums.select(
        "address",
        *whole,
        *(coins(F.col(k)).alias(v) for k, v in whole.items()),
        "confirmed_utxo_count",
        "mempool_utxo_count",
    )


def utxos(ledger: Ledger, address: str | None = None, floor: int = SPENDABLE_FLOOR) -> DataFrame:
    """Spendable outputs. An outpoint that is seen unconfirmed is listed so; the floor holds for confirmed ones only."""
    s = outpoint_states(ledger.of(address)).filter("not is_spent and not is_mempool_spent")
    seen = F.col("mempool_sat").isNotNull()
    rows = s.filter(seen | (F.col("confirmed_sat") > floor))
    return rows.select("address", "tx_id", F.col("vout").alias("index"), F.coalesce("mempool_sat", "confirmed_sat").alias("amount"), seen.alias("is_mempool"))


def spent_outpoints(ledger: Ledger, address: str | None = None) -> DataFrame:
    return ledger.of(address).spends.select("address", outpoint(*("prev_tx_id", "prev_vout")).alias("outpoint"), time_text(F.col("block_time")).alias("time"), "spend_tx_id")


def utxo_by_tx(ledger: Ledger, tx_id: str | None = None) -> DataFrame:
    """All outputs of a transaction in their order, spent or not."""
    rows = ledger.outputs if tx_id is None else ledger.outputs.filter(F.col("tx_id") == tx_id)
    return rows.select("tx_id", "vout", "address", "amount_sat", time_text(F.col("block_time")).alias("time"))


def mempool_utxos(ledger: Ledger, address: str | None = None) -> DataFrame:
    return ledger.of(address).mempool_outputs.select("address", outpoint().alias("outpoint"), F.col("amount_sat").alias("amount"), time_text(F.col("seen_time")).alias("time"))


def _events(ledger: Ledger, address: str | None) -> DataFrame:
    """Income and spend events of each outpoint; a spend of an output that isn't known has amount 0."""
    known = F.coalesce("mempool_sat", "confirmed_sat", F.lit(0))

    def event(rank: int, kind: str, at: str, tx: Column, amount: Column, unconfirmed: bool) -> Column:
        made = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col(at).alias("at"), tx.alias("event_tx"), amount.alias("amount"), F.lit(unconfirmed).alias("is_mempool"))
        return F.when(F.col(at).isNotNull(), made)

    point = outpoint()
    listed = F.array_compact(
        F.array(
            event(0, "income", "confirmed_time", F.col("tx_id"), F.col("confirmed_sat"), False),
            event(1, "income", "mempool_time", F.col("tx_id"), F.col("mempool_sat"), True),
            event(2, "spend", "mempool_spend_time", F.coalesce(F.nullif("mempool_spend_tx_id", F.lit("")), F.concat(F.lit("pending_spend_"), point)), known, True),
            event(3, "spend", "spend_time", F.coalesce("spend_tx_id", F.concat(F.lit("spend_"), point)), known, False),
        )
    )
    return outpoint_states(ledger.of(address)).select("address", "tx_id", "vout", F.explode(listed).alias("e")).select("address", "tx_id", "vout", "e.*")


def history(ledger: Ledger, address: str | None = None) -> DataFrame:
    """Per transaction what an address received and spent, and whether it did both; spenders that aren't known get ids
    made from the outpoint. Time and state are those of the transaction's first event in the order income, spend."""
    e = _events(ledger, address)
    amount = lambda kind: _total(F.when(F.col("kind") == kind, F.col("amount")))
    txs = e.groupBy("address", F.col("event_tx").alias("tx_id")).agg(
        amount("income").alias("income"), amount("spend").alias("spend"), F.min(F.struct(F.when(F.col("rank") == 3, 3).otherwise(F.col("rank")).alias("rank"), "at", "is_mempool")).alias("f")
    )
    kind = F.when((F.col("income") > 0) & (F.col("spend") > 0), "mixed").when(F.col("income") > 0, "income").otherwise("spend")
    return txs.select("address", "tx_id", time_text(F.col("f.at")).alias("time"), "income", "spend", kind.alias("type"), F.col("f.is_mempool").alias("is_mempool"))


def history_order() -> list[Column]:
    return [F.desc("time"), F.asc("tx_id")]


def history_page(ledger: Ledger, address: str | None, page: int = 1, limit: int = 10) -> DataFrame:
    rows = history(ledger, address)
    if address is None:
        return page_for_each(rows, ["address"], history_order(), page, limit)
    return numbered_page(rows, history_order(), page, limit)


def history_utxos(ledger: Ledger, address: str | None = None) -> DataFrame:
    """One row per income or spend event."""
    return _events(ledger, address).select("address", "tx_id", F.col("vout").alias("index"), "amount", F.col("kind").alias("type"), time_text(F.col("at")).alias("time"), "is_mempool")


def check_outpoints(ledger: Ledger, wanted: DataFrame) -> DataFrame:
    """Where each ``outpoint`` of ``wanted`` is, what it holds and whether, where and by whom it is spent."""
    asked = wanted.select("outpoint").distinct().select("outpoint", outpoint_parts(F.col("outpoint")).alias("p")).select("outpoint", F.col("p.tx_id").alias("tx_id"), F.col("p.vout").alias("vout"))
    keys = asked.select("tx_id", "vout")
    spent_keys = keys.withColumnsRenamed({"tx_id": "prev_tx_id", "vout": "prev_vout"})
    mine = Ledger(
        ledger.outputs.join(keys, ["tx_id", "vout"], "left_semi"),
        ledger.spends.join(spent_keys, ["prev_tx_id", "prev_vout"], "left_semi"),
        ledger.mempool_outputs.join(keys, ["tx_id", "vout"], "left_semi"),
        ledger.mempool_spends.join(spent_keys, ["prev_tx_id", "prev_vout"], "left_semi"),
    )
    # an output belongs to one address; should rows disagree, the one that has the output counts
    states = first_per(outpoint_states(mine), ["tx_id", "vout"], [F.col("confirmed_sat").isNull(), F.col("mempool_sat").isNull(), F.col("address")])
    found = asked.join(states, ["tx_id", "vout"], "left")
    confirmed, unconfirmed = F.col("confirmed_sat").isNotNull(), F.col("mempool_sat").isNotNull()
    block_spend, pool_spend = F.coalesce("is_spent", F.lit(False)), F.coalesce("is_mempool_spent", F.lit(False))
    return found.select(
        "outpoint",
        (confirmed | unconfirmed).alias("is_exist"),
        F.when(confirmed, "block").when(unconfirmed, "mempool").alias("where"),
        confirmed.alias("tx_confirm"),
        F.when(confirmed | unconfirmed, F.col("address")).alias("address"),
        F.coalesce("confirmed_sat", "mempool_sat", F.lit(0)).cast("bigint").alias("value"),
        time_text(F.coalesce("confirmed_time", "mempool_time")).alias("time"),
        F.when(block_spend | pool_spend, "spend").otherwise("unspent").alias("spend_status"),
        F.when(block_spend, "block").when(pool_spend, "mempool").alias("spend_where"),
        F.when(block_spend, F.col("spend_tx_id")).when(pool_spend, F.col("mempool_spend_tx_id")).alias("spend_tx"),
    )


def totals(ledger: Ledger) -> DataFrame:
    """Exact numbers of transactions, outputs, spends, and addresses that received or spent."""
    # each table gives one row; the join of single rows moves nothing else
    made = ledger.outputs.agg(F.count_distinct("tx_id").alias("transactions"), F.count_distinct("tx_id", "vout").alias("outputs"), F.count_distinct("address").alias("addresses"))
    gone = ledger.spends.agg(F.count_distinct("prev_tx_id", "prev_vout").alias("spends"), F.count_distinct("address").alias("spending_addresses"))
    return made.join(F.broadcast(gone))
