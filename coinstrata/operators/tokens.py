"""Derived token tables: info, authority outputs, issues, burns, lineage, and states of token outpoints."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_ft_issue_authority, is_genesis_row, is_nft_issue_authority, sensible_id_parts
from ..schemas import BURN_ADDRESS, NOT_MATCHED, NOT_USED, ZERO_SENSIBLE_ID
from .ledger import first_per

TOKEN = ("code_hash", "genesis")


@dataclass(frozen=True)
class TokenLedger:
    """Confirmed and unconfirmed token outputs and spends; ``valid`` are the confirmed outputs that passed validation."""

    outputs: DataFrame
    spends: DataFrame
    mempool_outputs: DataFrame
    mempool_spends: DataFrame
    info: DataFrame
    valid: DataFrame | None = None

    def where(self, address: str | None = None, code_hash: str | None = None, genesis: str | None = None) -> TokenLedger:
        """Rows of an address and token; blank means any, and equality reaches the scans."""
        wanted = {"address": address, "code_hash": code_hash, "genesis": genesis}

        def only(df: DataFrame | None) -> DataFrame | None:
            for name, value in wanted.items():
                if df is not None and value and name in df.columns:
                    df = df.filter(F.col(name) == value)
            return df

        names = ("outputs", "spends", "mempool_outputs", "mempool_spends", "valid")
        return replace(self, **{n: only(getattr(self, n)) for n in names})

    @property
    def counted(self) -> DataFrame:
        return self.outputs if self.valid is None else self.valid


def of_type(df: DataFrame, *types: str) -> DataFrame:
    return df.filter(F.col("contract_type").isin(*types))


def token_info(outputs: DataFrame) -> DataFrame:
    """One row per token from its first issued output: not the genesis row and not the authority."""
    rows = outputs.filter((F.col("sensible_id") != ZERO_SENSIBLE_ID) & (F.col("amount") != 0))
    first = F.min(F.struct("height", "tx_id", "vout", "sensible_id", "name", "symbol", "decimals")).alias("f")
    return rows.groupBy(*TOKEN).agg(first).select(*TOKEN, "f.sensible_id", "f.name", "f.symbol", "f.decimals")


def genesis_rows(outputs: DataFrame) -> DataFrame:
    return outputs.filter(is_genesis_row(F.col("sensible_id")))


def issue_authorities(outputs: DataFrame, spends: DataFrame, nft: bool = False) -> DataFrame:
    """Outputs that carry the right to issue, with is_spent."""
    test = is_nft_issue_authority(F.col("token_index"), F.col("meta_tx_id")) if nft else is_ft_issue_authority(F.col("sensible_id"), F.col("amount"))
    gone = spends.select(F.col("prev_tx_id").alias("tx_id"), F.col("prev_vout").alias("vout"), F.lit(True).alias("_gone")).distinct()
    rows = outputs.filter(test).join(gone, ["tx_id", "vout"], "left")
    return rows.withColumn("is_spent", F.col("_gone").isNotNull()).drop("_gone")


def burns(outputs: DataFrame) -> DataFrame:
    return outputs.filter((F.col("address") == BURN_ADDRESS) & (F.col("amount") != 0))


def genesis_outputs(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """The outputs of every transaction that spent a genesis row: prev_tx_id, prev_vout and the output's columns."""
    starts = genesis_rows(outputs).select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout")).distinct()
    by = spends.join(starts, ["prev_tx_id", "prev_vout"], "left_semi").select("prev_tx_id", "prev_vout", F.col("used_tx_id").alias("tx_id")).distinct()
    return by.join(outputs, "tx_id")


def issues(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """Outputs that are issues: their transaction spends an authority (or genesis) output. If it makes a new authority
    too, only token outputs before one with the same sensible id count."""
    zero = F.col("sensible_id") == ZERO_SENSIBLE_ID
    authorities = outputs.filter(zero | is_ft_issue_authority(F.col("sensible_id"), F.col("amount")))
    keys = authorities.select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout")).distinct()
    issuing = spends.join(keys, ["prev_tx_id", "prev_vout"], "left_semi").select(F.col("used_tx_id").alias("tx_id")).distinct()
    rows = outputs.join(issuing, "tx_id", "left_semi").filter(F.col("contract_type").isin("ft", "unique") & ~zero)
    authority = F.col("amount") == 0
    in_tx = Window.partitionBy("tx_id")
    after = Window.partitionBy("tx_id", "sensible_id").orderBy("vout").rowsBetween(1, Window.unboundedFollowing)
    flags = rows.withColumns({"_renewed": F.max(authority).over(in_tx), "_later": F.coalesce(F.max(authority).over(after), F.lit(False))})
    return flags.filter(~authority & (~F.col("_renewed") | F.col("_later"))).drop("_renewed", "_later")


def validate_lineage(outputs: DataFrame, spends: DataFrame, genesis: DataFrame, made_at_genesis: DataFrame, last_height: int | None = None, nft: bool = False) -> DataFrame:
    """``outputs`` with status (valid, invalid, pending) and reason.

    ``spends`` are consumed token rows with the transaction that consumed them (used_tx_id), ``genesis`` the genesis
    rows and ``made_at_genesis`` what ``genesis_outputs`` gives. An output counts if one consumed row of its own
    transaction has the same lineage, or that of the token or the authority that the genesis transaction made, or
    comes from the genesis transaction. All four are tested on the array of the distinct rows that a transaction
    consumed, so outputs and consumed rows are not multiplied, and no join has an "or" in its condition. Of repeated
    outpoints one row counts.
    """
    rows = outputs.withColumn("_g", sensible_id_parts(F.col("sensible_id"))).withColumns({"_g_tx": F.col("_g.tx_id"), "_g_vout": F.col("_g.vout")}).drop("_g")
    zero = F.col("sensible_id") == ZERO_SENSIBLE_ID
    started = genesis.select(F.col("tx_id").alias("_g_tx"), F.col("vout").cast("bigint").alias("_g_vout"), F.lit(True).alias("_started")).distinct()
    # what the genesis transaction made: the token row and the authority row, the last of each, and the last of both
    made = made_at_genesis.select(
        F.col("prev_tx_id").alias("_g_tx"),
        F.col("prev_vout").cast("bigint").alias("_g_vout"),
        F.struct("vout", "code_hash", "genesis", "sensible_id", F.col("token_index" if nft else "amount").alias("n")).alias("r"),
    )
    made = made.groupBy("_g_tx", "_g_vout").agg(F.sort_array(F.collect_list("r")).alias("_made"))
    rows = rows.join(started, ["_g_tx", "_g_vout"], "left").join(made, ["_g_tx", "_g_vout"], "left")
    is_token = (lambda r: r["n"] == 0) if nft else (lambda r: r["code_hash"] == F.col("code_hash"))
    is_authority = (lambda r: r["n"] == 1) if nft else (lambda r: r["n"] == 0)
    last = lambda test: F.try_element_at(F.filter("_made", test), F.lit(-1))
    used = spends.filter("used_tx_id is not null").groupBy(F.col("used_tx_id").alias("tx_id")).agg(
        F.collect_set(F.struct(F.col("code_hash").alias("c"), F.col("genesis").alias("g"), F.col("sensible_id").alias("s"), F.col("prev_tx_id").alias("t"))).alias("_used")
    )
    # partitioned and sorted as the join needs it
    earlier = F.lag("vout").over(Window.partitionBy("tx_id").orderBy("vout", "height", "sensible_id"))
    once = rows.withColumn("_earlier", earlier).filter("_earlier is null or _earlier <> vout").drop("_earlier")
    joined = once.join(used, "tx_id", "left")
    joined = joined.withColumns({"_token": last(is_token), "_authority": last(is_authority), "_any": last(lambda r: is_token(r) | is_authority(r))})
    same = lambda u, c, g, s: F.coalesce((u["c"] == F.col(c)) & (u["g"] == F.col(g)) & (u["s"] == F.col(s)), F.lit(False))
    match = F.exists(
        "_used",
        lambda u: same(u, "code_hash", "genesis", "sensible_id")
        | same(u, "_token.code_hash", "_token.genesis", "_any.sensible_id")
        | same(u, "_authority.code_hash", "_authority.genesis", "_any.sensible_id")
        | F.coalesce(u["t"] == F.col("_g_tx"), F.lit(False)),
    )
    gated = F.lit(False) if last_height is None else F.col("height") > last_height
    unused = F.col("_used").isNull()
    status = F.when(gated, "pending").when(unused, "invalid").when(zero, "valid").when(F.col("_started").isNull(), "pending").when(match, "valid").otherwise("invalid")
    done = joined.withColumn("status", status)
    reason = F.when(F.col("status") == "invalid", F.when(unused, NOT_USED).otherwise(NOT_MATCHED))
    return done.withColumn("reason", reason).select(*outputs.columns, "status", "reason")


def resolve_tokens(inputs: DataFrame, *sources: DataFrame) -> DataFrame:
    """Inputs (prev_tx_id, prev_vout, spend_tx_id) with the token columns of the output that they consume and its source.

    An outpoint is looked up in all ``sources`` (token outputs, or listings) at once and the first that knows it counts:
    confirmed outputs, else unconfirmed ones, else unconfirmed listings. Inputs that none knows are not token inputs.
    """
    shared = [c for c in sources[0].columns if all(c in s.columns for s in sources) and c not in ("tx_id", "vout")]
    known = None
    for k, s in enumerate(sources):
        rows = s.select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout"), F.struct(F.lit(k).alias("source"), *shared).alias("o"))
        known = rows if known is None else known.unionByName(rows)
    asked = inputs.select("prev_tx_id", "prev_vout", F.col("spend_tx_id").alias("used_tx_id")).distinct()
    # only the matches are grouped, not the history of outputs
    first = F.min("o").alias("o")
    return asked.join(known, ["prev_tx_id", "prev_vout"]).groupBy("prev_tx_id", "prev_vout", "used_tx_id").agg(first).select("prev_tx_id", "prev_vout", "used_tx_id", "o.*")


def token_spends(inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spends of fungible tokens and of their helper contracts that the inputs of blocks make."""
    rows = resolve_tokens(inputs, outputs).drop("source")
    return of_type(rows, "ft"), of_type(rows, "unique")


def nft_spends(inputs: DataFrame, outputs: DataFrame, listings: DataFrame) -> dict[str, DataFrame]:
    """Spends of NFT outputs by owner and by token, and of listings by seller and by token."""
    own, sold = resolve_tokens(inputs, outputs), resolve_tokens(inputs, listings)
    point, token = ("prev_tx_id", "prev_vout", "used_tx_id"), (*TOKEN, "token_index")
    return {
        "by_address": own.select("address", *token, *point),
        "by_token": own.select(*token, "address", *point),
        "sell_by_address": sold.select("seller", *token, "price", *point),
        "sell_by_token": sold.select(*token, "seller", "price", *point),
    }


def apply_unconfirmed(ledger: TokenLedger, outputs: DataFrame, inputs: DataFrame, listings: DataFrame | None = None) -> TokenLedger:
    """``ledger`` with the decoded token outputs of new unconfirmed transactions and the spends that their inputs make.

    Parents are looked up in the confirmed outputs, then in the unconfirmed ones, new ones among them, then in
    unconfirmed listings. Rows that are already there are not added again, so a batch may run twice.
    """
    point = ["prev_tx_id", "prev_vout"]
    fresh = outputs.join(ledger.mempool_outputs.select("tx_id", "vout"), ["tx_id", "vout"], "left_anti").dropDuplicates(["tx_id", "vout"])
    waiting = ledger.mempool_outputs.unionByName(fresh, allowMissingColumns=True)
    found = resolve_tokens(inputs, ledger.outputs, waiting, *([] if listings is None else [listings])).drop("source")
    found = found.join(ledger.mempool_spends.select(*point), point, "left_anti")
    columns = [c for c in ledger.mempool_spends.columns if c in found.columns]
    return replace(ledger, mempool_outputs=waiting, mempool_spends=ledger.mempool_spends.unionByName(found.select(*columns), allowMissingColumns=True))


def reset_unconfirmed(ledger: TokenLedger, outputs: DataFrame, inputs: DataFrame, listings: DataFrame | None = None) -> TokenLedger:
    """``ledger`` with all unconfirmed rows replaced by those of a snapshot."""
    none = replace(ledger, mempool_outputs=ledger.mempool_outputs.limit(0), mempool_spends=ledger.mempool_spends.limit(0))
    return apply_unconfirmed(none, outputs, inputs, listings)


def with_token_outputs(txs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Transactions that make a token output; the others are dropped."""
    return txs.join(outputs.select("tx_id").distinct(), "tx_id", "left_semi")


def history_events(ledger: TokenLedger) -> DataFrame:
    """address, token, tx_id, direction, time (ms), height, amount: incomes under their own transaction and outcomes
    under the spending one, confirmed and not; spends whose transaction isn't known have none to be listed under."""
    low = F.lit(-1).cast("bigint")

    def income(df: DataFrame, height) -> DataFrame:
        return df.select("address", *TOKEN, "tx_id", "vout", F.lit("income").alias("direction"), F.col("block_time_ms").alias("time"), height.alias("height"), F.col("amount").cast("bigint").alias("amount"))

    def outcome(df: DataFrame, height) -> DataFrame:
        rows = df.filter("used_tx_id is not null")
        return rows.select("address", *TOKEN, F.col("used_tx_id").alias("tx_id"), F.col("prev_vout").alias("vout"), F.lit("outcome").alias("direction"), F.col("block_time_ms").alias("time"), height.alias("height"), F.col("amount").cast("bigint").alias("amount"))

    rows = income(ledger.outputs, F.col("height")).unionByName(outcome(ledger.spends, F.col("height")))
    return rows.unionByName(income(ledger.mempool_outputs, low)).unionByName(outcome(ledger.mempool_spends, low))


def first_events(events: DataFrame) -> DataFrame:
    """One row per address, token, transaction and direction."""
    order = [F.desc("height"), F.asc("time"), F.asc("vout"), F.asc("amount")]
    return first_per(events, ["address", *TOKEN, "tx_id", "direction"], order)
