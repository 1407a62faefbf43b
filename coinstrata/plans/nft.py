"""Queries on non-fungible tokens and their sale listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, outpoint, sensible_id_parts
from ..operators.ledger import all_spends, first_per, unspent
from ..operators.paging import CAP, cursor_page, page_for_each
from ..operators.tokens import TOKEN, TokenLedger, first_events, history_events, issue_authorities
from ..schemas import UNCONFIRMED_HEIGHT, ZERO_SENSIBLE_ID, ZERO_TXID

#: Tasks that the rows of one token index are dealt to by ``nft_info``.
SHARES = 8


def confirmed_first() -> list[Column]:
    return [F.col("height") < 0, F.asc("height")]


@dataclass(frozen=True)
class Listings:
    """Sale listings and what ended them, confirmed and not."""

    listings: DataFrame
    spends: DataFrame
    mempool_listings: DataFrame
    mempool_spends: DataFrame


def live(tokens: TokenLedger, strict_compat: bool = False) -> DataFrame:
    """Unspent NFT outputs, confirmed (validated, where known) and not. ``strict_compat`` keeps unconfirmed outputs that
    are already spent unconfirmed, as the old list queries did."""
    columns = ("tx_id", "vout", "address", *TOKEN, "sensible_id", "token_index", "token_supply", "meta_tx_id", "meta_vout", "value_sat", "height")
    confirmed = tokens.counted.select(*columns)
    waiting = tokens.mempool_outputs.withColumn("height", F.lit(UNCONFIRMED_HEIGHT).cast("bigint")).select(*columns)
    gone = all_spends(tokens.spends, tokens.mempool_spends)
    if strict_compat:
        rows = unspent(confirmed, gone).unionByName(unspent(waiting, tokens.spends))
    else:
        rows = unspent(confirmed.unionByName(waiting), gone)
    return first_per(rows, ["tx_id", "vout"], confirmed_first()).withColumn("flag", flag())


def _index_range(rows: DataFrame, index: int | None, least: int | None, most: int | None) -> DataFrame:
    for test, value in ((lambda c, v: c == v, index), (lambda c, v: c >= v, least), (lambda c, v: c <= v, most)):
        rows = rows.filter(test(F.col("token_index"), value)) if value is not None else rows
    return rows


def _paged(rows: DataFrame, order: list[Column], cursor: int | None, size: int) -> DataFrame:
    return rows if cursor is None else cursor_page(rows, order, cursor, size, CAP)


def nft_utxos_by_address(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    return _paged(live(tokens.where(address, code_hash, genesis)), [F.asc("tx_id"), F.asc("vout")], cursor, size)


def nft_utxos_by_token(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, index: int | None = None, least: int | None = None, most: int | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    """By token in numeric order of the index; bounds are inclusive."""
    rows = _index_range(live(tokens.where(None, code_hash, genesis)), index, least, most)
    return _paged(rows, [F.asc("token_index"), F.asc("tx_id"), F.asc("vout")], cursor, size)


def nft_holder(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, index: int | None = None) -> DataFrame:
    """The current holder of each token index: of its unspent outputs an unconfirmed one first, then the newest."""
    rows = _index_range(live(tokens.where(None, code_hash, genesis)), index, None, None)
    order = F.struct(F.col("height") < 0, F.col("height"), F.col("tx_id"), F.col("vout"))
    held = rows.groupBy(*TOKEN, "token_index").agg(F.max_by(F.struct("address", "tx_id", "vout", "height"), order).alias("h"))
    return held.select(*TOKEN, "token_index", "h.address", "h.tx_id", "h.vout", "h.height")


def nft_sells(sales: Listings, tokens: TokenLedger, seller: str | None = None, code_hash: str | None = None, genesis: str | None = None, index: int | None = None, least: int | None = None, most: int | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    """Open listings with is_ready: the token's current holder is the listing's contract address."""
    waiting = sales.mempool_listings.withColumn("height", F.lit(UNCONFIRMED_HEIGHT).cast("bigint"))
    rows = sales.listings.unionByName(waiting.select(*sales.listings.columns))
    for name, value in (("seller", seller), ("code_hash", code_hash), ("genesis", genesis)):
        rows = rows.filter(F.col(name) == value) if value else rows
    rows = unspent(_index_range(rows, index, least, most), all_spends(sales.spends, sales.mempool_spends))
    rows = first_per(rows, ["tx_id", "vout"], confirmed_first())
    held = nft_holder(tokens, code_hash, genesis).select(*TOKEN, "token_index", F.col("address").alias("holder"))
    ready = F.coalesce(F.col("holder") == F.col("contract_address"), F.lit(False))
    joined = rows.join(held, [*TOKEN, "token_index"], "left").withColumn("is_ready", ready).withColumn("flag", flag())
    return _paged(joined, [F.asc("token_index"), F.asc("tx_id"), F.asc("vout")], cursor, size)


def nft_sell_by_address(sales: Listings, tokens: TokenLedger, seller: str | None = None, **rest: object) -> DataFrame:
    return nft_sells(sales, tokens, seller, **rest)


def nft_sell_by_token(sales: Listings, tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, **rest: object) -> DataFrame:
    return nft_sells(sales, tokens, None, code_hash, genesis, **rest)


def nft_count(tokens: TokenLedger, address: str | None = None) -> DataFrame:
    return live(tokens.where(address)).groupBy("address").agg(F.count_distinct("tx_id", "vout").alias("nft_count"))


def nft_address_summary(tokens: TokenLedger, address: str | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    """Collections of an address with the number of tokens held; metadata of the first output by (txid, vout)."""
    rows = live(tokens.where(address))
    first = F.min(F.struct("tx_id", "vout", "sensible_id", "token_supply", "meta_tx_id", "meta_vout")).alias("f")
    out = rows.groupBy("address", *TOKEN).agg(F.count("*").alias("nft_count"), first)
    out = out.select("address", *TOKEN, "f.sensible_id", "f.token_supply", "f.meta_tx_id", "f.meta_vout", "nft_count")
    return _paged(out, [F.asc("sensible_id"), F.asc("code_hash"), F.asc("genesis"), F.asc("address")], cursor, size)


def nft_info(outputs: DataFrame, mempool_outputs: DataFrame | None = None, code_hash: str | None = None, genesis: str | None = None, index: int | None = None) -> DataFrame:
    """Metadata per token index, of confirmed outputs and else of unconfirmed ones.

    The aggregate has to sort its rows, wide ones, before and after its shuffle. They are dealt out before, so that this
    sort doesn't share the memory of a task with those that made the outputs; the rows of one index go to SHARES tasks.
    """
    rows = outputs.withColumn("_late", F.lit(0))
    if mempool_outputs is not None:
        rows = rows.unionByName(mempool_outputs.select(*outputs.columns).withColumn("_late", F.lit(1)))
    for name, value in (("code_hash", code_hash), ("genesis", genesis)):
        rows = rows.filter(F.col(name) == value) if value else rows
    first = F.min(F.struct("_late", "height", "tx_id", "vout", "sensible_id", "token_supply", "meta_tx_id", "meta_vout")).alias("f")
    dealt = _index_range(rows, index, None, None).repartition(*TOKEN, "token_index", F.pmod(F.xxhash64("tx_id"), F.lit(SHARES)))
    out = dealt.groupBy(*TOKEN, "token_index").agg(first)
    return out.select(*TOKEN, "token_index", "f.sensible_id", "f.token_supply", "f.meta_tx_id", "f.meta_vout")


def nft_collections(outputs: DataFrame) -> DataFrame:
    """One row per collection, of the lowest token index with a lineage."""
    rows = outputs.filter(F.col("sensible_id") != ZERO_SENSIBLE_ID)
    first = F.min(F.struct("token_index", "height", "tx_id", "vout", "sensible_id", "token_supply", "meta_tx_id", "meta_vout")).alias("f")
    return rows.groupBy(*TOKEN).agg(first).select(*TOKEN, "f.sensible_id", "f.token_supply", "f.meta_tx_id", "f.meta_vout")


def nft_summary(outputs: DataFrame, cursor: int = 0, size: int = 10) -> DataFrame:
    return cursor_page(nft_collections(outputs), [F.asc("sensible_id"), F.asc("code_hash"), F.asc("genesis")], cursor, size, CAP)


def nft_genesis(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Each collection's genesis outpoint and its first unspent issue authority (an index without metadata)."""
    wanted = nft_collections(tokens.where(None, code_hash, genesis).outputs).withColumn("g", sensible_id_parts(F.col("sensible_id")))
    wanted = wanted.select(*TOKEN, "sensible_id", "token_supply", F.col("g.tx_id").alias("genesis_tx_id"), F.col("g.vout").alias("genesis_vout"))
    free = unspent(issue_authorities(tokens.outputs, tokens.spends, nft=True).filter("not is_spent"), tokens.mempool_spends)
    first = free.filter(F.col("meta_tx_id") == ZERO_TXID).groupBy("sensible_id").agg(F.min(F.struct("height", "tx_id", "vout")).alias("f"))
    return wanted.join(first.select("sensible_id", outpoint("f.tx_id", "f.vout").alias("issue_outpoint")), "sensible_id", "left")


def owner_order() -> list[Column]:
    return [F.desc("nft_count"), F.asc("address")]


def nft_owners(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, cursor: int | None = None, size: int = 10, validated: bool = True) -> DataFrame:
    """Addresses by the number of validated outputs received less those spent."""
    t = tokens.where(None, code_hash, genesis)
    plus = (t.counted if validated else t.outputs).select(*TOKEN, "address", "tx_id", "vout").distinct().withColumn("n", F.lit(1))
    minus = t.spends.select(*TOKEN, "address", "prev_tx_id", "prev_vout").distinct().withColumn("n", F.lit(-1))
    both = plus.select(*TOKEN, "address", "n").unionByName(minus.select(*TOKEN, "address", "n"))
    owners = both.groupBy(*TOKEN, "address").agg(F.sum("n").cast("bigint").alias("nft_count")).filter("nft_count > 0")
    return _paged(owners, [*owner_order(), F.asc("code_hash"), F.asc("genesis")], cursor, size)


def nft_top_owners(tokens: TokenLedger, size: int = 10) -> DataFrame:
    return page_for_each(nft_owners(tokens), list(TOKEN), owner_order(), 1, size)


def nft_history(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Transactions of an address or collection, one row per direction; each output counts as amount 1."""
    one = lambda df: df.withColumn("amount", F.lit(1).cast("decimal(20,0)"))
    t = tokens.where(address, code_hash, genesis)
    counted = TokenLedger(one(t.outputs), one(t.spends), one(t.mempool_outputs), one(t.mempool_spends), t.info)
    return first_events(history_events(counted)).select("address", *TOKEN, "tx_id", "direction", "time", "height")
