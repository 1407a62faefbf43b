"""Outputs, spends and their state. One shuffle by outpoint serves every question about single outputs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import address_or_error
from ..schemas import ERR_ADDRESS

OUTPOINT = ("tx_id", "vout")
PREVIOUS = ("prev_tx_id", "prev_vout")


@dataclass(frozen=True)
class Ledger:
    """Confirmed and unconfirmed outputs and spends (see ``schemas``)."""

    outputs: DataFrame
    spends: DataFrame
    mempool_outputs: DataFrame
    mempool_spends: DataFrame

    def of(self, address: str | None) -> Ledger:
        """The rows of one address; equality reaches the scans."""
        if address is None:
            return self
        names = ("outputs", "spends", "mempool_outputs", "mempool_spends")
        return replace(self, **{n: getattr(self, n).filter(F.col("address") == address) for n in names})


def explode_transactions(blocks: DataFrame) -> DataFrame:
    """height, block_time, tx_pos, tx_id, inputs, outputs of raw blocks."""
    rows = blocks.select("height", "block_hash", "block_time", F.posexplode("transactions").alias("tx_pos", "tx"))
    return rows.select("height", "block_hash", "block_time", "tx_pos", "tx.tx_id", "tx.inputs", "tx.outputs")


def explode_outputs(txs: DataFrame, *keep: str) -> DataFrame:
    """One row per output with its position; outputs without an address keep the sentinel."""
    rows = txs.select("tx_id", *keep, F.posexplode("outputs").alias("vout", "o"))
    return rows.select("tx_id", "vout", address_or_error(F.col("o.address")).alias("address"), F.coalesce("o.amount_sat", F.lit(0)).cast("bigint").alias("amount_sat"), *keep)


def explode_inputs(txs: DataFrame, *keep: str) -> DataFrame:
    """One row per input: the outpoint it consumes and the transaction that does."""
    rows = txs.select(F.col("tx_id").alias("spend_tx_id"), *keep, F.explode("inputs").alias("i"))
    return rows.select(F.col("i.prev_tx_id").alias("prev_tx_id"), F.col("i.prev_vout").alias("prev_vout"), "spend_tx_id", *keep)


def resolve_spends(inputs: DataFrame, outputs: DataFrame, *carry: str) -> DataFrame:
    """Inputs with the address (and ``carry``) of the output they consume; inputs whose output is unknown are dropped."""
    known = outputs.select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout"), "address", *carry)
    return inputs.join(known, list(PREVIOUS))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: the one that none precedes. (A rank would make Spark sort the rows
    before the shuffle too, to drop repeated ones early; here almost every row is the only one of its key.)"""
    earlier = F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_earlier", earlier).filter("_earlier is null").drop("_earlier")


def unspent(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """Outputs that no row of ``spends`` consumes."""
    return outputs.join(spends.select(F.col("prev_tx_id").alias("tx_id"), F.col("prev_vout").alias("vout")), list(OUTPOINT), "left_anti")


def spent(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    return outputs.join(spends.select(F.col("prev_tx_id").alias("tx_id"), F.col("prev_vout").alias("vout")), list(OUTPOINT), "left_semi")


def overlay(confirmed: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """Both, where an outpoint that is confirmed hides its unconfirmed row."""
    fresh = unconfirmed.join(confirmed.select(*OUTPOINT), list(OUTPOINT), "left_anti")
    return confirmed.unionByName(fresh, allowMissingColumns=True)


def all_spends(*spends: DataFrame) -> DataFrame:
    """The distinct consumed outpoints of several tables."""
    out = spends[0].select(*PREVIOUS)
    for s in spends[1:]:
        out = out.unionByName(s.select(*PREVIOUS))
    return out.distinct()


def outpoint_states(ledger: Ledger) -> DataFrame:
    """One row per address and outpoint: its confirmed and unconfirmed amount, time and spend.

    The four tables are tagged and grouped once, which takes the place of four semi- and anti-joins; of an outpoint
    that is written twice the first row (by time, then amount) counts.
    """
    amount, time, tx = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")

    def tagged(df: DataFrame, kind: str, own: tuple[str, str], at: str, value: Column, spender: Column) -> DataFrame:
        return df.select("address", F.col(own[0]).alias("tx_id"), F.col(own[1]).alias("vout"), F.lit(kind).alias("kind"), value.alias("amount"), F.col(at).alias("at"), spender.alias("by"))

    rows = (
        tagged(ledger.outputs, "c", OUTPOINT, "block_time", F.col("amount_sat"), tx)
        .unionByName(tagged(ledger.mempool_outputs, "m", OUTPOINT, "seen_time", F.col("amount_sat"), tx))
        .unionByName(tagged(ledger.spends, "s", PREVIOUS, "block_time", amount, F.col("spend_tx_id")))
        .unionByName(tagged(ledger.mempool_spends, "p", PREVIOUS, "seen_time", amount, F.col("spend_tx_id")))
    ).filter(F.col("address") != ERR_ADDRESS)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("at", "amount", "by"))).alias(kind)
    states = rows.groupBy("address", "tx_id", "vout").agg(*(first(k) for k in "cmsp"))
    return states.select(
        "address",
        "tx_id",
        "vout",
        F.col("c.amount").alias("confirmed_sat"),
        F.col("c.at").alias("confirmed_time"),
        F.col("m.amount").alias("mempool_sat"),
        F.col("m.at").alias("mempool_time"),
        F.col("s").isNotNull().alias("is_spent"),
        F.col("s.at").alias("spend_time"),
        F.col("s.by").alias("spend_tx_id"),
        F.col("p").isNotNull().alias("is_mempool_spent"),
        F.col("p.at").alias("mempool_spend_time"),
        F.col("p.by").alias("mempool_spend_tx_id"),
    )
