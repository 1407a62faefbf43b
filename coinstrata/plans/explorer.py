"""The block explorer: headers, lists, transactions and fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bits_value, is_coinbase, milliseconds, miner_tag
from ..operators.ledger import explode_inputs, explode_outputs, explode_transactions
from ..operators.paging import window_below


def block_headers(blocks: DataFrame) -> DataFrame:
    """Headers as the explorer shows them: times in ms, difficulty bits as a number."""
    return blocks.select(
        "height", "block_hash", "prev_hash", "version", "merkle_root", milliseconds(F.col("block_time")).alias("time_ms"),
        milliseconds(F.col("median_time")).alias("median_time_ms"), bits_value(F.col("bits")).alias("bits"), "nonce", "size", "tx_count", "miner", "reward_sat",
    )


def block_info(blocks: DataFrame, block_id: int | str) -> DataFrame:
    """One block by height or by its 64-digit hash."""
    text = str(block_id)
    return blocks.filter(F.col("height") == int(text)) if text.lstrip("-").isdigit() and len(text) < 20 else blocks.filter(F.col("block_hash") == text.lower())


def block_list(blocks: DataFrame, last: int, limit: int = 30) -> DataFrame:
    return window_below(blocks, "height", last, limit)


def chain_info(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.max("height").alias("max_height"), F.count("*").alias("blocks"))


def block_tx_page(raw_blocks: DataFrame, height: int, cursor: int = 0, size: int = 20) -> DataFrame:
    """A slice of a block's transactions by their position."""
    rows = raw_blocks.filter(F.col("height") == height).select("height", F.posexplode("transactions").alias("tx_pos", "tx"))
    inside = (F.col("tx_pos") >= cursor) & (F.col("tx_pos") < cursor + size)
    return rows.filter(inside).select("height", "tx_pos", "tx.tx_id")


def block_all_txs(raw_blocks: DataFrame, height: int) -> DataFrame:
    return raw_blocks.filter(F.col("height") == height).select("height", F.posexplode("transactions").alias("tx_pos", "tx")).select("height", "tx_pos", "tx.tx_id")


def coinbase_info(raw_blocks: DataFrame, script_column: str = "coinbase") -> DataFrame:
    """miner and reward of each block from its first transaction."""
    reward = F.aggregate(F.get("transactions", 0)["outputs"], F.lit(0).cast("bigint"), lambda a, o: a + F.coalesce(o["amount_sat"], F.lit(0)))
    return raw_blocks.select("height", miner_tag(F.col(script_column)).alias("miner"), F.coalesce(reward, F.lit(0)).alias("reward_sat"))


def tx_fees(raw_blocks: DataFrame, outputs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Fee of each transaction: inputs less outputs, where inputs whose output is unknown count as nothing; a coinbase
    has fee 0. ``sizes`` (tx_id, size) adds the rate, cut to a whole number."""
    txs = explode_transactions(raw_blocks).select("height", "tx_pos", "tx_id", "inputs", "outputs", is_coinbase(F.col("inputs")).alias("coinbase"))
    spent = explode_inputs(txs.filter("not coinbase"), "height").join(
        outputs.select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout"), F.col("amount_sat").alias("amount")), ["prev_tx_id", "prev_vout"]
    )
    plus = spent.select(F.col("spend_tx_id").alias("tx_id"), "height", "amount")
    minus = explode_outputs(txs.filter("not coinbase"), "height").select("tx_id", "height", (-F.col("amount_sat")).alias("amount"))
    none = txs.filter("coinbase").select("tx_id", "height", F.lit(0).cast("bigint").alias("amount"))
    fees = plus.unionByName(minus).unionByName(none).groupBy("height", "tx_id").agg(F.sum("amount").cast("bigint").alias("fee_sat"))
    if sizes is None:
        return fees
    return fees.join(sizes.select("tx_id", "size"), "tx_id", "left").withColumn("fee_rate", F.expr("case when size > 0 then fee_sat div size end"))


def block_fees(fees: DataFrame) -> DataFrame:
    return fees.groupBy("height").agg(F.sum("fee_sat").cast("bigint").alias("fees_sat"), F.count("*").alias("tx_count"))
