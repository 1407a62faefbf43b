"""Following a chain: block and mempool streams kept as Parquet tables.

Each micro-batch writes into a folder named after its number and overwrites it when it runs again, so a batch that was
interrupted leaves no duplicates, and a stream of blocks in order of height ends in the state of a batch load. Outputs
are written before inputs are resolved, so a block may spend its own outputs; inputs without a known output are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import Ledger, explode_inputs, explode_outputs, explode_transactions, first_per, resolve_spends
from ..operators.reorg import evict, rollback
from ..schemas import MEMPOOL_OUTPUTS, MEMPOOL_SPENDS, OUTPUTS, SPENDS, ZERO_TXID

TABLES = {"outputs": OUTPUTS, "spends": SPENDS, "mempool_outputs": MEMPOOL_OUTPUTS, "mempool_spends": MEMPOOL_SPENDS}


def block_outputs(blocks: DataFrame) -> DataFrame:
    return explode_outputs(explode_transactions(blocks), "block_time", "height").select("tx_id", "vout", "address", "amount_sat", "block_time", "height")


def block_spends(blocks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Spends of the blocks whose outputs are known."""
    inputs = explode_inputs(explode_transactions(blocks), "block_time", "height").filter(F.col("prev_tx_id") != ZERO_TXID)
    # few inputs meet a long history: Spark broadcasts them, and only the matches are sorted for the first output
    known = outputs.withColumn("_at", F.struct("height", "block_time", "address"))
    rows = first_per(resolve_spends(inputs, known, "_at"), ["prev_tx_id", "prev_vout", "spend_tx_id"], [F.col("_at")])
    return rows.select("prev_tx_id", "prev_vout", "address", "spend_tx_id", "block_time", "height")


def first_outputs(outputs: DataFrame) -> DataFrame:
    return first_per(outputs, ["tx_id", "vout"], [F.col(c) for c in ("height", "block_time", "address", "amount_sat") if c in outputs.columns])


def load_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outputs and spends of a whole chain at once."""
    outputs = block_outputs(blocks)
    return outputs, block_spends(blocks, outputs)


@dataclass(frozen=True)
class LedgerStore:
    """The tables of a ledger under one path."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        """A table's rows; the number of their batch is the folder's name and not part of them."""
        try:
            rows = self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*")
        except Exception as e:  # no batch yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])
        return rows.select(*[f.strip().split(" ")[0] for f in TABLES[name].split(",")])

    def put(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def ledger(self) -> Ledger:
        """The ledger as of now: repeated outpoints once, confirmed rows gone from the mempool."""
        outputs = first_outputs(self.read("outputs"))
        spends = first_per(self.read("spends"), ["prev_tx_id", "prev_vout"], [F.col(c) for c in ("height", "block_time", "spend_tx_id")])
        waiting = first_per(self.read("mempool_outputs"), ["tx_id", "vout"], [F.col("seen_time"), F.col("address"), F.col("amount_sat")])
        pending = first_per(self.read("mempool_spends"), ["prev_tx_id", "prev_vout"], [F.col("seen_time"), F.col("spend_tx_id")])
        return evict(Ledger(outputs, spends, waiting, pending))

    def apply_blocks(self, blocks: DataFrame, batch: int) -> None:
        """One micro-batch: append its outputs, then its spends resolved against all outputs."""
        self.put("outputs", batch, block_outputs(blocks))
        self.put("spends", batch, block_spends(blocks, self.read("outputs")))

    def apply_mempool(self, txs: DataFrame, batch: int) -> None:
        """Unconfirmed outputs, then spends resolved against confirmed and unconfirmed outputs."""
        rows = explode_outputs(txs, "seen_time").select("tx_id", "vout", "address", "amount_sat", "seen_time")
        self.put("mempool_outputs", batch, rows)
        known = self.read("outputs").select("tx_id", "vout", "address").unionByName(self.read("mempool_outputs").select("tx_id", "vout", "address"))
        known = first_per(known, ["tx_id", "vout"], [F.col("address")])
        spends = resolve_spends(explode_inputs(txs, "seen_time"), known)
        self.put("mempool_spends", batch, spends.select("prev_tx_id", "prev_vout", "address", "spend_tx_id", "seen_time"))

    def roll_back(self, fork: int, target: LedgerStore) -> None:
        """Write the ledger without blocks from ``fork`` on to another store, which then takes this one's place."""
        kept = rollback(self.ledger(), fork)
        for name in TABLES:
            target.put(name, 0, getattr(kept, name))

    def reset_mempool(self, txs: DataFrame) -> None:
        """Replace all unconfirmed rows by a snapshot."""
        for name in ("mempool_outputs", "mempool_spends"):
            none = self.spark.createDataFrame([], TABLES[name]).withColumn("batch", F.lit(0))
            none.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(f"{self.path}/{name}")
        self.apply_mempool(txs, 0)


def follow_blocks(stream: DataFrame, store: LedgerStore, checkpoint: str) -> StreamingQuery:
    """Apply all blocks there are and stop; started again it goes on where it ended."""
    return stream.writeStream.foreachBatch(lambda df, n: _persisted(df, lambda d: store.apply_blocks(d, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_mempool(stream: DataFrame, store: LedgerStore, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, n: _persisted(df, lambda d: store.apply_mempool(d, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _persisted(df: DataFrame, f) -> None:
    kept = df.persist()
    try:
        f(kept)
    finally:
        kept.unpersist()


def validate_new(outputs: DataFrame, spends: DataFrame, genesis: DataFrame, made_at_genesis: DataFrame, last_height: int, decided: DataFrame) -> DataFrame:
    """One validation round: status of outputs not yet decided, of heights that are indexed; pending ones come again."""
    from ..operators.tokens import validate_lineage

    open_rows = outputs.join(decided.select("tx_id", "vout"), ["tx_id", "vout"], "left_anti")
    return validate_lineage(open_rows, spends, genesis, made_at_genesis, last_height).filter("status <> 'pending'")
