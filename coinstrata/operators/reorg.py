"""Chain reorganisations, eviction of confirmed rows from the mempool, and removal of keys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import Ledger

CHECKED_BLOCKS = 500


def fork_height(stored: DataFrame, canonical: DataFrame, last: int = CHECKED_BLOCKS) -> DataFrame:
    """The lowest of the ``last`` newest stored heights whose hash differs; one row, null if none does."""
    newest = stored.orderBy(F.desc("height")).limit(last)
    both = newest.select("height", F.col("block_hash").alias("own")).join(canonical.select("height", F.col("block_hash").alias("chain")), "height")
    return both.filter("own <> chain").agg(F.min("height").alias("fork_height"), F.count("*").alias("reorg_size"))


def rollback(ledger: Ledger, fork: int) -> Ledger:
    """The ledger without confirmed rows from ``fork`` on, in outputs and spends alike."""
    below = lambda df: df.filter(F.col("height") < fork)
    return replace(ledger, outputs=below(ledger.outputs), spends=below(ledger.spends))


def keep_below(df: DataFrame, fork: DataFrame) -> DataFrame:
    """As ``rollback`` for a fork that is itself a one-row table: rows below it, or all if it is null."""
    rows = df.join(F.broadcast(fork.select("fork_height")))
    return rows.filter(F.col("fork_height").isNull() | (F.col("height") < F.col("fork_height"))).drop("fork_height")


def evict(ledger: Ledger) -> Ledger:
    """The ledger without unconfirmed rows that blocks have confirmed."""
    waiting = ledger.mempool_outputs.join(ledger.outputs.select("tx_id", "vout"), ["tx_id", "vout"], "left_anti")
    pending = ledger.mempool_spends.join(ledger.spends.select("prev_tx_id", "prev_vout"), ["prev_tx_id", "prev_vout"], "left_anti")
    return replace(ledger, mempool_outputs=waiting, mempool_spends=pending)


def delete_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows without a match in ``keys`` on its columns (whole lists or members of them)."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last writer wins: of rows that were put under one key the one with the highest version."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("n")
    return df.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"n.{c}").alias(c) for c in rest))
