"""Column expressions: parsing, defaults and formatting. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ERR_ADDRESS, ZERO_SENSIBLE_ID, ZERO_TXID


def outpoint(tx_id: str | Column = "tx_id", vout: str | Column = "vout") -> Column:
    return F.concat_ws(":", tx_id, F.col(vout).cast("string") if isinstance(vout, str) else vout.cast("string"))


def outpoint_parts(text: Column) -> Column:
    """struct(tx_id, vout) of ``txid:vout``, split at the last colon; vout is null if it isn't a number."""
    return F.struct(
        F.regexp_extract(text, "^(.*):[^:]*$", 1).alias("tx_id"), F.substring_index(text, ":", -1).try_cast("int").alias("vout")
    )


def flag(tx_id: str = "tx_id", vout: str = "vout") -> Column:
    return F.concat_ws("_", tx_id, F.col(vout).cast("string"))


def coins(satoshi: Column) -> Column:
    return satoshi / F.lit(1e8)


def to_satoshi(coin_amount: Column) -> Column:
    return F.round(coin_amount * F.lit(1e8)).cast("bigint")


def address_or_error(address: Column) -> Column:
    return F.coalesce(F.nullif(address, F.lit("")), F.lit(ERR_ADDRESS))


def amount_or_zero(amount: Column) -> Column:
    return F.coalesce(F.nullif(amount, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def reversed_hex(text: Column) -> Column:
    """Hex of the bytes in reverse order."""
    pairs = F.transform(F.sequence(F.length(text) - 1, F.lit(1), F.lit(-2)), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_join(pairs, "")).otherwise(F.lit(""))


def sensible_id_parts(sensible_id: Column) -> Column:
    """struct(tx_id, vout) of the genesis outpoint in a sensibleId: reversed hash, then a little-endian number."""
    good = sensible_id.rlike("^[0-9a-fA-F]{72}$")
    text = F.lower(sensible_id)
    vout = F.conv(reversed_hex(F.substring(text, 65, 8)), 16, 10).cast("bigint")
    return F.when(good, F.struct(reversed_hex(F.substring(text, 1, 64)).alias("tx_id"), vout.alias("vout")))


def is_genesis_row(sensible_id: Column) -> Column:
    return sensible_id == ZERO_SENSIBLE_ID


def is_ft_issue_authority(sensible_id: Column, amount: Column) -> Column:
    return (sensible_id != ZERO_SENSIBLE_ID) & (amount == 0)


def is_nft_issue_authority(token_index: Column, meta_tx_id: Column) -> Column:
    return (token_index != 0) & (meta_tx_id == ZERO_TXID)


def is_coinbase(inputs: Column) -> Column:
    """One input without a previous transaction; an index of 0xffffffff reads as -1 in a signed column."""
    first = F.get(inputs, 0)
    return (F.size(inputs) == 1) & (first["prev_tx_id"] == ZERO_TXID) & first["prev_vout"].isin(-1, 4294967295)


def miner_tag(coinbase_script: Column) -> Column:
    """The longest run of letters, digits, dots and hyphens, the first of equally long ones; empty if there is none."""
    runs = F.regexp_extract_all(coinbase_script, F.lit("[0-9a-zA-Z.-]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, F.length))
    return F.coalesce(F.get(F.filter(runs, lambda x: F.length(x) == longest), 0), F.lit(""))


def bits_value(bits: Column) -> Column:
    return F.conv(bits, 16, 10).cast("bigint")


def milliseconds(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def seconds(time: Column) -> Column:
    return F.unix_timestamp(time.cast("timestamp"))


def time_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def is_block_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def shortened(text: Column, head: int = 6, tail: int = 6) -> Column:
    """The middle of long texts replaced by three dots."""
    return F.when(F.length(text) > head + tail, F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(tail)))).otherwise(text)


def padded_index(number: Column, width: int = 30) -> Column:
    """Zero-padded on the left, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def double_sha256(raw: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(F.sha2(raw, 256)), 256))


def split_segments(value: Column, arity: int) -> Column:
    """Rows of a list value ``,a@b@c,a@b@c``: arrays of at least ``arity`` fields; others are dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.split(x, "@")), lambda x: F.size(x) >= arity)
