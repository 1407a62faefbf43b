"""The registered queries over the order tables (see ``sources.star``) and their twins in SQL.

Dust and floor are 200000, as no price in these tables is below the defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cache
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import reorg, tokens
from ..operators.paging import numbered_page
from ..sources.star import StarLedger
from . import base, explorer, ft, nft, ops

DUST = FLOOR = 200_000
#: Fixed arguments of queries for one key.
ADDRESS, TX, TOKEN, LAST_BLOCK, BLOCK, FORK = "7", "7", ("Brand#1", "STANDARD"), 2000, 1000, 1500

PRELUDE = """
WITH o AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS address,
         CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS nxt
  FROM orders),
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS tx_id, CAST(l_linenumber AS INTEGER) AS vout, address, nxt,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_sat, l_shipdate AS t,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS height,
         l_linestatus AS st, l_returnflag AS rf, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS amount,
         l_discount, l_tax, p_brand AS code_hash, p_type AS genesis,
         CASE WHEN l_partkey % 7 = 0 THEN 'unique' ELSE 'ft' END AS contract_type
  FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
li AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY tx_id, vout, st ORDER BY t, amount_sat, l_partkey, l_suppkey, rf) = 1),
outs AS (SELECT * FROM li WHERE st = 'F'),
mouts AS (SELECT * FROM li WHERE st = 'O'),
gone AS (
  SELECT * REPLACE (t + INTERVAL 30 DAY AS t, height + 30 AS height) FROM li WHERE rf = 'R'
  QUALIFY row_number() OVER (PARTITION BY tx_id, vout ORDER BY t, amount_sat, l_partkey, l_suppkey, st) = 1),
mgone AS (
  SELECT * REPLACE (t + INTERVAL 30 DAY AS t, height + 30 AS height) FROM li WHERE rf = 'A'
  QUALIFY row_number() OVER (PARTITION BY tx_id, vout ORDER BY t, amount_sat, l_partkey, l_suppkey, st) = 1)
"""


@cache
def _star(spark: SparkSession, sf_dir: str) -> StarLedger:
    return StarLedger(spark, sf_dir)


def _outpoints(spark: SparkSession, star: StarLedger) -> DataFrame:
    """Outpoints to check: those of all lines, and one that doesn't exist."""
    point = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    every = star.table("lineitem").select(point.alias("outpoint"))
    return every.unionByName(spark.range(1).select(F.lit("0:99").alias("outpoint"))).distinct()


def _lineage(s: StarLedger) -> DataFrame:
    """Confirmed token outputs by status and reason, tested against the tokens' genesis rows."""
    checked = tokens.validate_lineage(*s.lineage)
    return checked.groupBy("status", "reason").agg(F.count("*").alias("n"), F.sum("amount").cast("bigint").alias("amount"))


def _checked(s: StarLedger) -> DataFrame:
    return tokens.validate_lineage(*s.lineage)


def _inputs(spends: DataFrame) -> DataFrame:
    return spends.filter("spend_tx_id is not null").select("prev_tx_id", "prev_vout", "spend_tx_id")


def _unconfirmed_tokens(s: StarLedger) -> DataFrame:
    """Token spends of the unconfirmed transactions, made from their inputs."""
    empty = replace(s.tokens, mempool_outputs=s.tokens.mempool_outputs.limit(0), mempool_spends=s.tokens.mempool_spends.limit(0))
    now = tokens.apply_unconfirmed(empty, s.tokens.mempool_outputs, _inputs(s.ledger.mempool_spends))
    return now.mempool_spends.select("prev_tx_id", "prev_vout", "used_tx_id", "contract_type", "address", *tokens.TOKEN, F.col("amount").cast("bigint").alias("amount"))


def _unconfirmed_nfts(s: StarLedger) -> DataFrame:
    """Where the parents of unconfirmed NFT inputs are found: confirmed (0), unconfirmed (1), or only as listings (2)."""
    held = s.nfts.mempool_outputs.filter("vout < 6")
    found = tokens.resolve_tokens(_inputs(s.ledger.mempool_spends), s.nfts.outputs, held, s.sales.mempool_listings)
    return found.groupBy(*tokens.TOKEN, "source").agg(F.count("*").alias("n"), F.sum("token_index").cast("bigint").alias("indexes"))


def _nft_spends(s: StarLedger, kind: str) -> DataFrame:
    return tokens.nft_spends(_inputs(s.ledger.spends), s.nfts.outputs, s.sales.listings)[kind]


def _sizes(s: StarLedger) -> DataFrame:
    """Sizes of transactions as usual ones have them: 10 bytes, 148 for each input, 34 for each output."""
    txs = L.explode_transactions(s.raw_blocks)
    return txs.groupBy("tx_id").agg(F.sum(F.size("inputs") * 148 + F.size("outputs") * 34 + 10).alias("size"))


def _fee_rates(s: StarLedger) -> DataFrame:
    one_block = s.raw_blocks.filter(F.col("height") <= LAST_BLOCK)
    return explorer.tx_fees(one_block, s.ledger.outputs, _sizes(s)).select("height", "tx_id", "fee_sat", "size", "fee_rate")


def _reorg_tables(s: StarLedger) -> tuple[DataFrame, DataFrame]:
    stored = s.blocks.select("height", "block_hash")
    changed = F.when(F.col("height") >= FORK, F.concat(F.lit("x"), "block_hash")).otherwise(F.col("block_hash"))
    return stored, stored.select("height", changed.alias("block_hash"))


def _rolled_back(s: StarLedger) -> DataFrame:
    fork = reorg.fork_height(*_reorg_tables(s), last=5000)
    kept = reorg.keep_below(s.ledger.outputs, fork).select(F.lit("outputs").alias("kind"), "height", "amount_sat")
    gone = reorg.keep_below(s.ledger.spends, fork).select(F.lit("spends").alias("kind"), "height", F.lit(0).cast("bigint").alias("amount_sat"))
    return kept.unionByName(gone).groupBy("kind").agg(F.count("*").alias("n"), F.max("height").alias("max_height"), F.sum("amount_sat").cast("bigint").alias("amount_sat"))


def _evicted(s: StarLedger) -> DataFrame:
    left = reorg.evict(s.ledger)
    a = left.mempool_outputs.select(F.lit("outputs").alias("kind"), "address")
    return a.unionByName(left.mempool_spends.select(F.lit("spends").alias("kind"), "address")).groupBy("kind", "address").agg(F.count("*").alias("n"))


def _miners(s: StarLedger) -> DataFrame:
    from ..functions.columns import miner_tag

    script = F.concat(F.lit("\x03/"), F.translate("p_name", " ", "/"), F.lit("/"), "p_brand", F.lit("\x01."), "p_type")
    return s.table("part").select(F.col("p_partkey").alias("part"), miner_tag(script).alias("miner"))


def _daily(s: StarLedger) -> DataFrame:
    """Events by day and type, as the stream job counts them; windows of time are an extension."""
    return s.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _stream_final(s: StarLedger) -> DataFrame:
    from ..streaming.replay import replayed_balance

    return replayed_balance(s)


QUERIES: dict[str, Callable[[SparkSession, StarLedger], DataFrame]] = {
    "balance_all": lambda sp, s: base.balance(s.ledger, None, DUST),
    "balance_one": lambda sp, s: base.balance(s.ledger, ADDRESS, DUST),
    "utxos_unspent": lambda sp, s: base.utxos(s.ledger, None, FLOOR),
    "spent_outpoints": lambda sp, s: base.spent_outpoints(s.ledger),
    "utxo_by_tx": lambda sp, s: base.utxo_by_tx(s.ledger, TX),
    "mempool_utxos": lambda sp, s: base.mempool_utxos(s.ledger),
    "history_tx": lambda sp, s: base.history(s.ledger),
    "history_page": lambda sp, s: base.history_page(s.ledger, None, 2, 5),
    "history_utxo_events": lambda sp, s: base.history_utxos(s.ledger),
    "check_outpoints": lambda sp, s: base.check_outpoints(s.ledger, _outpoints(sp, s)),
    "ledger_totals": lambda sp, s: base.totals(s.ledger),
    "dedup_first_wins": lambda sp, s: s.lines.select("tx_id", "vout", F.col("l_linestatus").alias("status"), "address", "amount_sat", "height"),
    "ft_balance": lambda sp, s: ft.ft_balance(s.tokens),
    "ft_utxos": lambda sp, s: ft.ft_utxos(s.tokens),
    "ft_unique_utxos": lambda sp, s: ft.ft_unique_utxos(s.tokens),
    "ft_info": lambda sp, s: ft.ft_info(s.tokens),
    "ft_summary_page": lambda sp, s: ft.ft_summary(s.tokens, 10, 20),
    "ft_supply": lambda sp, s: ft.ft_supply(s.issues, s.burns),
    "ft_owners": lambda sp, s: ft.ft_owners(s.tokens),
    "ft_owners_topk": lambda sp, s: ft.ft_top_owners(s.tokens, 10),
    "ft_owner_tx_data": lambda sp, s: ft.ft_owner_tx_data(s.tokens),
    "ft_address_history": lambda sp, s: ft.ft_address_history(s.tokens, None, size=5),
    "ft_genesis_history": lambda sp, s: ft.ft_genesis_history(s.tokens),
    "ft_supply_list": lambda sp, s: ft.ft_listed(s.issues),
    "ft_burn_list": lambda sp, s: ft.ft_listed(s.burns, cursor=20, size=50),
    "ft_db_address_history": lambda sp, s: ft.ft_db_address_history(s.tokens),
    "ft_used": lambda sp, s: ft.used_by(s.tokens.spends).groupBy("used_tx_id").agg(F.count("*").alias("n"), F.sum("amount").cast("bigint").alias("amount")),
    "ft_lineage_valid": lambda sp, s: _lineage(s),
    "ft_unchecked": lambda sp, s: ft.unchecked(_checked(s)).select("tx_id", "vout", *tokens.TOKEN, F.col("amount").cast("bigint").alias("amount")),
    "ft_unchecked_total": lambda sp, s: ft.unchecked_total(_checked(s)),
    "ft_invalid": lambda sp, s: ft.invalid(_checked(s)).select("tx_id", "vout", *tokens.TOKEN, "reason"),
    "ft_utxos_of_token": lambda sp, s: ft.ft_utxos(s.tokens, None, *TOKEN),
    "ft_balance_one": lambda sp, s: ft.ft_balance(s.tokens, ADDRESS),
    "ft_genesis_rows": lambda sp, s: s.lineage[2].select("tx_id", "vout", *tokens.TOKEN, "height"),
    "ft_issue_authorities": lambda sp, s: tokens.issue_authorities(*s.with_authorities).select("tx_id", "vout", *tokens.TOKEN, "is_spent"),
    "ft_spends_resolved": lambda sp, s: tokens.token_spends(_inputs(s.ledger.spends), s.tokens.outputs)[0].select("prev_tx_id", "prev_vout", "used_tx_id", "address", *tokens.TOKEN, F.col("amount").cast("bigint").alias("amount")),
    "unique_spends_resolved": lambda sp, s: tokens.token_spends(_inputs(s.ledger.spends), s.tokens.outputs)[1].select("prev_tx_id", "prev_vout", "used_tx_id", *tokens.TOKEN, "custom_data"),
    "ft_mempool_spends": lambda sp, s: _unconfirmed_tokens(s),
    "nft_mempool_parents": lambda sp, s: _unconfirmed_nfts(s),
    "nft_spends_by_address": lambda sp, s: _nft_spends(s, "by_address"),
    "nft_sell_spends_by_address": lambda sp, s: _nft_spends(s, "sell_by_address"),
    "nft_utxos_by_address": lambda sp, s: nft.nft_utxos_by_address(s.nfts),
    "nft_holder_fast": lambda sp, s: nft.nft_holder(s.nfts),
    "nft_utxos_by_token_range": lambda sp, s: nft.nft_utxos_by_token(s.nfts, least=10, most=150),
    "nft_sell_by_address": lambda sp, s: nft.nft_sell_by_address(s.sales, s.nfts),
    "nft_sell_by_token": lambda sp, s: nft.nft_sell_by_token(s.sales, s.nfts, least=1, most=100, cursor=0, size=50),
    "nft_count": lambda sp, s: nft.nft_count(s.nfts),
    "nft_address_summary": lambda sp, s: nft.nft_address_summary(s.nfts),
    "nft_summary": lambda sp, s: nft.nft_collections(s.nfts.outputs),
    "nft_info": lambda sp, s: nft.nft_info(s.nfts.outputs, s.nfts.mempool_outputs.withColumn("height", F.lit(-1).cast("bigint"))),
    "nft_owners": lambda sp, s: nft.nft_owners(s.nfts),
    "nft_owners_topk": lambda sp, s: nft.nft_top_owners(s.nfts, 5),
    "nft_history": lambda sp, s: nft.nft_history(s.nfts),
    "block_list": lambda sp, s: explorer.block_list(s.blocks, LAST_BLOCK, 30),
    "block_tx_page": lambda sp, s: explorer.block_tx_page(s.raw_blocks, BLOCK, 2, 5),
    "block_fees": lambda sp, s: explorer.block_fees(explorer.tx_fees(s.raw_blocks, s.ledger.outputs)),
    "block_info": lambda sp, s: explorer.block_info(s.blocks, BLOCK),
    "block_info_by_hash": lambda sp, s: explorer.block_info(s.blocks, sha256(str(BLOCK).encode()).hexdigest()),
    "block_all_txs": lambda sp, s: explorer.block_all_txs(s.raw_blocks, BLOCK),
    "fee_rates": lambda sp, s: _fee_rates(s),
    "block_counts": lambda sp, s: ops.block_counts(s.raw_blocks),
    "chain_info": lambda sp, s: explorer.chain_info(s.blocks),
    "miner_tag": lambda sp, s: _miners(s),
    "reorg_detect": lambda sp, s: reorg.fork_height(*_reorg_tables(s), last=5000),
    "reorg_rollback": lambda sp, s: _rolled_back(s),
    "mempool_evict": lambda sp, s: _evicted(s),
    "events_daily": lambda sp, s: _daily(s),
    "log_page": lambda sp, s: numbered_page(s.blocks, [F.desc("height")], 3, 20),
    "stream_ledger_final": lambda sp, s: _stream_final(s),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(spark, _star(spark, sf_dir))

    return {name: bind(f) for name, f in QUERIES.items()}
