"""Replaying a star ledger as a stream of block files, to hold the stream against the batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RAW_BLOCKS
from ..sources.blocks import stream_blocks
from ..sources.star import StarLedger
from .sync import LedgerStore, follow_blocks

PERIODS = 4
#: The files of a period are one micro-batch: an input is resolved against what its batch or an earlier one holds.
ALL_FILES = 2**31 - 1


def shared_path(spark) -> str:
    """A new folder where all machines see it; on one machine without that setting, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='ledger-')}"
    return f"{root.rstrip('/')}/replay-{uuid.uuid4().hex}"


def stage_blocks(star: StarLedger, path: str) -> Iterator[int]:
    """Put the blocks into the stream's folder, one period of heights after the other, so that a stream which takes all
    there is meets them in order. A period is as many files as tasks read it; the blocks are made only once."""
    bounds = star.heights
    if bounds["lo"] is None:
        return
    width = (bounds["hi"] - bounds["lo"]) // PERIODS + 1
    period = F.floor((F.col("height") - bounds["lo"]) / width).cast("int")
    star.raw_blocks.withColumn("period", period).write.partitionBy("period").parquet(f"{path}-made")
    made = star.spark.read.schema(f"{RAW_BLOCKS}, period INT").parquet(f"{path}-made")
    for k in range(PERIODS):
        made.filter(F.col("period") == k).drop("period").write.mode("append").parquet(path)
        yield k


def replayed_balance(star: StarLedger) -> DataFrame:
    """Confirmed amounts per address after the whole chain went through the stream in several micro-batches."""
    path = shared_path(star.spark)
    store = LedgerStore(star.spark, f"{path}/ledger")
    for _ in stage_blocks(star, f"{path}/blocks"):
        follow_blocks(stream_blocks(star.spark, f"{path}/blocks", ALL_FILES), store, f"{path}/checkpoint").awaitTermination()
    now = store.ledger()
    plus = now.outputs.select("address", "amount_sat", F.lit(1).alias("made"), F.lit(0).alias("spent"))
    amounts = now.outputs.select(F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout"), "amount_sat")
    minus = now.spends.join(amounts, ["prev_tx_id", "prev_vout"]).select("address", (-F.col("amount_sat")).alias("amount_sat"), F.lit(0).alias("made"), F.lit(1).alias("spent"))
    sums = plus.unionByName(minus).groupBy("address")
    return sums.agg(F.sum("amount_sat").cast("bigint").alias("balance_sat"), F.sum("made").cast("bigint").alias("outputs"), F.sum("spent").cast("bigint").alias("spends"))
