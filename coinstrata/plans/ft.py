"""Queries on fungible tokens. Blank code hash or genesis means any; without an address all addresses are answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, outpoint, sensible_id_parts
from ..operators.ledger import all_spends, first_per, unspent
from ..operators.paging import CAP, cursor_page, page_for_each
from ..operators.tokens import TOKEN, TokenLedger, first_events, genesis_outputs, history_events, issue_authorities, of_type
from ..schemas import UNCONFIRMED_HEIGHT, ZERO_SENSIBLE_ID


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast("bigint")


def _with_info(rows: DataFrame, info: DataFrame, how: str = "inner") -> DataFrame:
    """Token metadata; Spark broadcasts it while it is small and joins by token otherwise."""
    return rows.join(info.select(*TOKEN, "sensible_id", "name", "symbol", "decimals"), list(TOKEN), how)


def ft_balance(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Per address and token: unspent confirmed amount, unconfirmed income, unconfirmed spend and where it comes from.

    All rows of an outpoint meet in one group; an unconfirmed income counts unless its outpoint is confirmed and unspent.
    Tokens whose only activity is an unconfirmed spend are not listed.
    """
    t = tokens.where(address, code_hash, genesis)
    low = F.lit(UNCONFIRMED_HEIGHT).cast("bigint")
    tag = lambda df, kind, height: of_type(df, "ft").select("address", "tx_id", "vout", F.lit(kind).alias("kind"), F.struct(height.alias("height"), *TOKEN, F.col("amount").cast("bigint").alias("amount")).alias("r"))
    point = lambda df: df.withColumnsRenamed({"prev_tx_id": "tx_id", "prev_vout": "vout"})
    rows = tag(t.counted, "c", F.col("height")).unionByName(tag(t.mempool_outputs, "m", low))
    rows = rows.unionByName(tag(point(t.spends), "s", F.col("height"))).unionByName(tag(point(t.mempool_spends), "p", low))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("r"))).alias(kind)
    points = rows.groupBy("address", "tx_id", "vout").agg(*(first(k) for k in "cmsp"))
    live = F.when(F.col("s").isNull(), F.col("c"))
    fresh = F.when(live.isNull(), F.col("m"))
    entry = lambda kind, r, source: F.when(r.isNotNull(), F.struct(F.lit(kind).alias("kind"), *(r[k].alias(k) for k in (*TOKEN, "amount")), source.alias("source")))
    origin = F.when(live.isNotNull(), "c").when(fresh.isNotNull(), "m")
    entries = F.array_compact(F.array(entry("c", live, F.lit("")), entry("m", fresh, F.lit("")), entry("p", F.col("p"), F.coalesce(origin, F.lit("")))))
    listed = points.select("address", "tx_id", "vout", F.explode(entries).alias("e")).select("address", "tx_id", "vout", "e.*")
    of = lambda kind, source=None: _sum(F.when((F.col("kind") == kind) & (F.lit(True) if source is None else F.col("source") == source), F.col("amount")))
    income = F.col("kind").isin("c", "m")
    sums = listed.groupBy("address", *TOKEN).agg(
        of("c").alias("confirmed"),
        of("m").alias("unconfirmed_income"),
        of("p").alias("unconfirmed_spend"),
        of("p", "c").alias("unconfirmed_spend_from_confirmed"),
        of("p", "m").alias("unconfirmed_spend_from_unconfirmed"),
        F.count_if(income).alias("utxo_count"),
        F.min(F.when(income, outpoint())).alias("first_outpoint"),
    )
    sums = sums.filter("first_outpoint is not null").withColumn("balance", F.expr("confirmed + unconfirmed_income - unconfirmed_spend"))
    return _with_info(sums, tokens.info)


def ft_utxos(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None, contract_type: str = "ft") -> DataFrame:
    """Unspent token outputs, those not yet confirmed with height -1; metadata of unknown tokens is left blank."""
    t = tokens.where(address, code_hash, genesis)
    gone = all_spends(t.spends, t.mempool_spends)
    columns = ("address", *TOKEN, "tx_id", "vout", F.col("amount").cast("bigint").alias("amount"), "value_sat", "height")
    confirmed = of_type(t.counted, contract_type).select(*columns)
    waiting = of_type(t.mempool_outputs, contract_type).select(*columns[:-1], F.lit(UNCONFIRMED_HEIGHT).cast("bigint").alias("height"))
    order = [F.col("height") < 0, F.asc("height")]
    rows = first_per(unspent(confirmed.unionByName(waiting), gone), ["tx_id", "vout"], order)
    return _with_info(rows, tokens.info, "left").withColumn("flag", flag())


def ft_unique_utxos(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Unspent outputs of the helper contract, by token, with their custom data."""
    t = tokens.where(None, code_hash, genesis)
    columns = (*TOKEN, "tx_id", "vout", "sensible_id", "custom_data", "value_sat", "height")
    waiting = of_type(t.mempool_outputs, "unique").withColumn("height", F.lit(UNCONFIRMED_HEIGHT).cast("bigint"))
    rows = of_type(t.outputs, "unique").select(*columns).unionByName(waiting.select(*columns))
    # the rows come from the window in the order that the join needs
    return unspent(first_per(rows, ["tx_id", "vout"], [F.col("height") < 0, F.asc("height")]), all_spends(t.spends, t.mempool_spends))


def ft_info(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Metadata of tokens; that of tokens seen only unconfirmed comes from their unconfirmed outputs."""
    fresh = tokens.mempool_outputs.groupBy(*TOKEN).agg(F.min(F.struct("tx_id", "vout", "sensible_id", "name", "symbol", "decimals")).alias("f"))
    fresh = fresh.select(*TOKEN, "f.sensible_id", "f.name", "f.symbol", "f.decimals").join(tokens.info, list(TOKEN), "left_anti")
    rows = tokens.info.select(*TOKEN, "sensible_id", "name", "symbol", "decimals").unionByName(fresh)
    for name, value in (("code_hash", code_hash), ("genesis", genesis)):
        rows = rows.filter(F.col(name) == value) if value else rows
    return rows


def summary_order() -> list[Column]:
    return [F.asc("sensible_id"), F.asc("code_hash"), F.asc("genesis")]


def ft_summary(tokens: TokenLedger, cursor: int = 0, size: int = 10) -> DataFrame:
    """A page of all tokens with a lineage, in order of their sensible ids."""
    return cursor_page(tokens.info.filter(F.col("sensible_id") != ZERO_SENSIBLE_ID).select(*TOKEN, "sensible_id", "name", "symbol", "decimals"), summary_order(), cursor, size, CAP)


def ft_genesis_utxo(tokens: TokenLedger) -> DataFrame:
    return issue_authorities(tokens.outputs, tokens.spends)


def ft_genesis(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Each token's genesis outpoint, the outputs that its spending made, and the first unspent issue authority."""
    wanted = ft_info(tokens, code_hash, genesis).withColumn("g", sensible_id_parts(F.col("sensible_id")))
    wanted = wanted.select(*TOKEN, "sensible_id", "name", "symbol", "decimals", F.col("g.tx_id").alias("genesis_tx_id"), F.col("g.vout").alias("genesis_vout"))
    made = genesis_outputs(tokens.outputs, tokens.spends).groupBy(F.col("prev_tx_id").alias("genesis_tx_id"), F.col("prev_vout").cast("bigint").alias("genesis_vout"))
    made = made.agg(F.count("*").alias("genesis_outputs"), F.any_value("tx_id").alias("issue_tx_id"))
    free = unspent(issue_authorities(tokens.outputs, tokens.spends).filter("not is_spent"), tokens.mempool_spends)
    first = free.groupBy("sensible_id").agg(F.min(F.struct("height", "tx_id", "vout")).alias("f")).select("sensible_id", outpoint("f.tx_id", "f.vout").alias("issue_outpoint"))
    return wanted.join(made, ["genesis_tx_id", "genesis_vout"], "left").join(first, "sensible_id", "left")


def ft_supply(issued: DataFrame, burnt: DataFrame, made_at_genesis: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """Issued less burnt amount of each token, at least 0; an outpoint that is listed twice counts once. With what the
    genesis transactions made: whether more may be issued (they made more than one token output), and else the most."""
    signed = issued.select(*TOKEN, "tx_id", "vout", F.col("amount").cast("bigint").alias("amount"), F.lit(1).alias("sign")).unionByName(
        burnt.select(*TOKEN, "tx_id", "vout", F.col("amount").cast("bigint").alias("amount"), F.lit(-1).alias("sign"))
    )
    once = signed.groupBy(*TOKEN, "sign", "tx_id", "vout").agg(F.min("amount").alias("amount"))
    part = lambda sign: _sum(F.when(F.col("sign") == sign, F.col("amount")))
    sums = once.groupBy(*TOKEN).agg(part(1).alias("issued"), part(-1).alias("burned"))
    sums = sums.withColumn("supply", F.greatest(F.col("issued") - F.col("burned"), F.lit(0).cast("bigint")))
    if made_at_genesis is None:
        return sums
    start = info.withColumn("g", sensible_id_parts(F.col("sensible_id"))).select(*TOKEN, F.col("g.tx_id").alias("prev_tx_id"), F.col("g.vout").alias("_v"))
    made = made_at_genesis.select("prev_tx_id", F.col("prev_vout").cast("bigint").alias("_v"), F.col("code_hash").alias("_c"), F.col("genesis").alias("_g"), "vout", "amount")
    own = (F.col("_c") == F.col("code_hash")) & (F.col("_g") == F.col("genesis"))
    rights = start.join(made, ["prev_tx_id", "_v"], "left").groupBy(*TOKEN).agg(F.count("vout").alias("_n"), F.max_by("amount", F.when(own, F.col("vout"))).cast("bigint").alias("_most"))
    more = F.col("_n") > 1
    return sums.join(rights, list(TOKEN), "left").select(*sums.columns, F.coalesce(more, F.lit(False)).alias("allow_increase_issues"), F.when(~more, F.coalesce("_most", F.lit(0))).alias("max_supply"))


def owner_order() -> list[Column]:
    return [F.desc("balance"), F.asc("address")]


def ft_owners(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, cursor: int | None = None, size: int = 10, validated: bool = False) -> DataFrame:
    """Addresses with a positive balance of a token; all confirmed outputs count unless only validated ones are asked for.
    With a cursor: one page of the largest."""
    t = tokens.where(None, code_hash, genesis)
    once = lambda df, a, b: df.groupBy(*TOKEN, "address", a, b).agg(F.min("amount").cast("bigint").alias("amount"))
    plus = once(of_type(t.counted if validated else t.outputs, "ft"), "tx_id", "vout").select(*TOKEN, "address", "amount")
    minus = once(of_type(t.spends, "ft"), "prev_tx_id", "prev_vout").select(*TOKEN, "address", (-F.col("amount")).alias("amount"))
    owners = plus.unionByName(minus).groupBy(*TOKEN, "address").agg(_sum(F.col("amount")).alias("balance")).filter("balance > 0")
    return owners if cursor is None else cursor_page(owners, [*owner_order(), F.asc("code_hash"), F.asc("genesis")], cursor, size)


def ft_top_owners(tokens: TokenLedger, size: int = 10) -> DataFrame:
    """The largest owners of every token at once."""
    return page_for_each(ft_owners(tokens), list(TOKEN), owner_order(), 1, size)


def tx_order() -> list[Column]:
    return [F.desc("time"), F.asc("tx_id")]


def ft_address_history(tokens: TokenLedger, address: str | None, code_hash: str | None = None, genesis: str | None = None, cursor: int = 0, size: int = 10) -> DataFrame:
    """Transactions of an address, newest first; a page is taken of transactions, then each gives one row per token."""
    events = history_events(tokens.where(address, code_hash, genesis))
    amount = lambda d: _sum(F.when(F.col("direction") == d, F.col("amount")))
    facts = lambda confirmed, time, height, income, outcome: (
        F.max(confirmed).alias("confirmed"), F.max(time).alias("time"), F.max(height).alias("height"), F.max(income).alias("is_income"), F.max(outcome).alias("is_outcome"),
    )
    # one shuffle by transaction serves both sums; a transaction carries its few tokens along, so that nothing is joined
    is_ = lambda d: F.col("direction") == d
    rows = events.repartition("address", "tx_id").groupBy("address", "tx_id", *TOKEN).agg(
        amount("income").alias("income"), amount("outcome").alias("outcome"), *facts(F.when(F.col("height") >= 0, F.col("time")), "time", "height", is_("income"), is_("outcome"))
    )
    txs = rows.groupBy("address", "tx_id").agg(*facts("confirmed", "time", "height", "is_income", "is_outcome"), F.collect_list(F.struct(*TOKEN, "income", "outcome")).alias("r"))
    txs = txs.select("address", "tx_id", F.coalesce("confirmed", "time").alias("time"), "height", "is_income", "is_outcome", "r")
    page = page_for_each(txs, ["address"], tx_order(), 1, size) if address is None else cursor_page(txs, tx_order(), cursor, size, CAP)
    return page.select("address", "tx_id", "time", "height", "is_income", "is_outcome", F.explode("r").alias("r")).select("address", "tx_id", "time", "height", "is_income", "is_outcome", "r.*")


def ft_genesis_history(tokens: TokenLedger, code_hash: str | None = None, genesis: str | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    """Transactions of a token, one row per direction, by transaction id descending."""
    events = history_events(tokens.where(None, code_hash, genesis)).filter("height >= 0")
    rows = events.groupBy(*TOKEN, "tx_id", "direction").agg(F.min(F.struct("time", "height")).alias("f")).select(*TOKEN, "tx_id", "direction", "f.time", "f.height")
    order = [F.desc("tx_id"), F.asc("direction"), F.asc("code_hash"), F.asc("genesis")]
    return rows if cursor is None else cursor_page(rows, order, cursor, size)


def ft_listed(rows: DataFrame, code_hash: str | None = None, genesis: str | None = None, cursor: int | None = None, size: int = 10) -> DataFrame:
    """Issues or burns, each outpoint once, in the order of the text codeHash@genesis@txid@vout."""
    for name, value in (("code_hash", code_hash), ("genesis", genesis)):
        rows = rows.filter(F.col(name) == value) if value else rows
    once = rows.groupBy(*TOKEN, "tx_id", "vout").agg(F.min(F.col("amount").cast("bigint")).alias("amount"))
    order = [F.concat_ws("@", "code_hash", "genesis", "tx_id", F.col("vout").cast("string"))]
    return once if cursor is None else cursor_page(once, order, cursor, size, CAP)


def ft_owner_tx_data(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """The deduplicated incomes and spends behind an owner's balance."""
    t = tokens.where(address, code_hash, genesis)
    rows = lambda df, a, b, kind: of_type(df, "ft").groupBy("address", *TOKEN, F.col(a).alias("tx_id"), F.col(b).alias("vout")).agg(F.min("amount").cast("bigint").alias("amount")).withColumn("kind", F.lit(kind))
    return rows(t.outputs, "tx_id", "vout", "income").unionByName(rows(t.spends, "prev_tx_id", "prev_vout", "spend"))


def ft_db_address_history(tokens: TokenLedger, address: str | None = None, code_hash: str | None = None, genesis: str | None = None) -> DataFrame:
    """Confirmed history rows of an address, one per transaction, direction and token."""
    events = history_events(tokens.where(address, code_hash, genesis)).filter("height >= 0")
    return first_events(events).select("address", *TOKEN, "tx_id", "direction", "time", "height")


def dump(rows: DataFrame, order: list[Column], page: int = 1, size: int = 10, **equal: object) -> DataFrame:
    """A page of the rows of a table whose columns have the given values; None means any."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value) if value is not None else rows
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def unchecked(validated: DataFrame) -> DataFrame:
    """Outputs that wait for validation; ``validated`` is what ``validate_lineage`` gives."""
    return validated.filter("status = 'pending'").drop("status", "reason")


def unchecked_total(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if(F.col("status") == "pending").alias("total"))


def invalid(validated: DataFrame) -> DataFrame:
    return validated.filter("status = 'invalid'").drop("status")


def used_by(spends: DataFrame, tx_id: str | None = None) -> DataFrame:
    """Consumed token rows by the transaction that consumed them."""
    rows = spends.filter("used_tx_id is not null")
    return rows if tx_id is None else rows.filter(F.col("used_tx_id") == tx_id)
