"""Operational tables: logs of indexing, errors and reorganisations, and block counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import explode_inputs, explode_outputs, explode_transactions
from ..operators.paging import numbered_page
from ..operators.reorg import latest_per_key

LOG_PAGE = 20


def index_log_page(log: DataFrame, page: int = 1, limit: int = LOG_PAGE) -> DataFrame:
    """Logged blocks that no reorganisation has replaced, newest first."""
    return numbered_page(log.filter("reorg = 0"), [F.desc("height"), F.desc("id")], page, limit)


def error_log_page(log: DataFrame, page: int = 1, limit: int = LOG_PAGE) -> DataFrame:
    return numbered_page(log, [F.desc("id")], page, limit)


def reorg_log_page(log: DataFrame, page: int = 1, limit: int = LOG_PAGE) -> DataFrame:
    """Reorganisations with their latest status; each status change is an appended row with a later timestamp."""
    return numbered_page(latest_per_key(log, ["id"], "timestamp"), [F.desc("id")], page, limit)


def cleaned_height(state: DataFrame) -> DataFrame:
    """The last height up to which unconfirmed rows were evicted; state rows are (key, value), appended."""
    return state.filter("key = 'last_mempool_clean_height'").agg(F.max(F.col("value").try_cast("bigint")).alias("height"))


def block_counts(raw_blocks: DataFrame) -> DataFrame:
    """Transactions, inputs, outputs and addresses of each block."""
    txs = explode_transactions(raw_blocks).select("height", "tx_id", "inputs", "outputs")
    made = explode_outputs(txs, "height").groupBy("height").agg(F.count("*").alias("outputs"), F.count_distinct("address").alias("addresses"))
    gone = explode_inputs(txs, "height").groupBy("height").agg(F.count("*").alias("inputs"))
    base = txs.groupBy("height").agg(F.count("*").alias("tx_count"))
    joined = base.join(gone, "height", "left").join(made, "height", "left")
    return joined.select("height", "tx_count", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("inputs", "outputs", "addresses")))
