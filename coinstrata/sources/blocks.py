"""Block and mempool sources: staged files of raw blocks as a Spark data source, and Parquet archives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.chain import read_block
from ..schemas import MEMPOOL_TXS, RAW_BLOCKS

BUCKET = 1_000_000, 1_000
DECODED = (
    "height BIGINT, block_hash STRING, prev_hash STRING, version BIGINT, merkle_root STRING, time BIGINT, bits STRING, nonce BIGINT,"
    " coinbase STRING, size BIGINT, transactions ARRAY<STRUCT<tx_id: STRING, inputs: ARRAY<STRUCT<prev_tx_id: STRING, prev_vout: BIGINT>>,"
    " outputs: ARRAY<STRUCT<address: STRING, amount_sat: BIGINT>>>>"
)


def decode_blocks(staged: DataFrame, chain: str) -> DataFrame:
    """Raw blocks (height, raw binary) decoded in Arrow batches; one chain of btc, mvc, doge."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DECODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for height, raw in zip(b.column(0).to_pylist(), b.column(1)):
                yield pa.RecordBatch.from_pylist([{"height": height} | read_block(raw.as_py(), chain)], schema)

    return staged.select("height", "raw").mapInArrow(run, DECODED)


def staged_blocks(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """height, raw of staged block files ``<height>.blk`` that hold hex digits; Spark lists and reads them."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.blk").select("value", F.col("_metadata.file_name").alias("name"))
    rows = files.select(F.substring_index("name", ".", 1).try_cast("bigint").alias("height"), F.unhex(F.regexp_replace("value", "[^0-9a-fA-F]", "")).alias("raw")).filter("height is not null and raw is not null")
    return rows.repartition(partitions, "height") if partitions else rows


def read_chain(spark: SparkSession, path: str, chain: str = "btc") -> DataFrame:
    """raw_blocks of staged files."""
    d = decode_blocks(staged_blocks(spark, path), chain)
    return as_raw_blocks(d)


def as_raw_blocks(decoded: DataFrame) -> DataFrame:
    txs = F.transform(
        "transactions",
        lambda t: F.struct(
            t["tx_id"].alias("tx_id"),
            F.transform(t["inputs"], lambda i: F.struct(i["prev_tx_id"].alias("prev_tx_id"), i["prev_vout"].cast("int").alias("prev_vout"))).alias("inputs"),
            t["outputs"].alias("outputs"),
        ),
    )
    return decoded.select("height", "block_hash", F.timestamp_seconds("time").cast("timestamp_ntz").alias("block_time"), txs.alias("transactions"))


class HeightRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class ChainSource(DataSource):
    """``spark.read.format("ledger_chain")`` with options path (a folder that all workers see), chain, first, last and
    parts: hex block files ``<height>.blk``, read and decoded in ranges of heights."""

    @classmethod
    def name(cls) -> str:
        return "ledger_chain"

    def schema(self) -> str:
        return DECODED

    def reader(self, schema) -> ChainReader:
        return ChainReader(self.options)


class ChainReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.chain = options["path"], options.get("chain", "btc")
        self.first, self.last, self.parts = (int(options[k]) for k in ("first", "last", "parts"))

    def partitions(self) -> list[HeightRange]:
        n = self.last - self.first + 1
        width = max(1, -(-n // self.parts))
        return [HeightRange(i, min(i + width - 1, self.last)) for i in range(self.first, self.last + 1, width)]

    def read(self, partition: HeightRange) -> Iterator[tuple]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for height in range(partition.first, partition.last + 1):
            file = f"{root}/{height}.blk"
            if fs.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
                continue
            with fs.open_input_stream(file) as f:
                b = read_block(bytes.fromhex(f.read().decode().strip()), self.chain)
            txs = [(t["tx_id"], [(i["prev_tx_id"], i["prev_vout"]) for i in t["inputs"]], [(o["address"], o["amount_sat"]) for o in t["outputs"]]) for t in b["transactions"]]
            yield (height, b["block_hash"], b["prev_hash"], b["version"], b["merkle_root"], b["time"], b["bits"], b["nonce"], b["coinbase"], b["size"], txs)


def write_archive(raw_blocks: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Append blocks to a Parquet archive in folders by million and thousand of the height."""
    million, thousand = BUCKET
    rows = raw_blocks.withColumns({"million": F.floor(F.col("height") / million), "thousand": F.floor(F.col("height") / thousand)})
    rows.repartition("million", "thousand").sortWithinPartitions("height").write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("million", "thousand").parquet(path)


def read_archive(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks of a range of heights; folders outside it are not read."""
    rows = spark.read.parquet(path)
    for test, value in (((lambda a, b: a >= b), first), ((lambda a, b: a <= b), last)):
        if value is not None:
            rows = rows.filter(test(F.col("height"), value) & test(F.col("thousand"), value // BUCKET[1]) & test(F.col("million"), value // BUCKET[0]))
    return rows.drop("million", "thousand")


def stream_blocks(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of raw blocks from a folder of Parquet files."""
    return spark.readStream.schema(RAW_BLOCKS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_mempool(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of unconfirmed transactions from a folder of Parquet files."""
    return spark.readStream.schema(MEMPOOL_TXS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_legacy(spark: SparkSession, path: str, names: list[str], separator: str = "\t") -> DataFrame:
    """Rows of an exported list store, ``key<separator>,a@b,a@b``: key and one text column per name; segments with
    fewer fields are dropped."""
    from ..functions.columns import split_segments

    lines = spark.read.text(path)
    parts = F.split("value", separator, 2)
    rows = lines.select(F.get(parts, 0).alias("key"), F.explode(split_segments(F.get(parts, 1), len(names))).alias("f"))
    return rows.select("key", *(F.get("f", i).alias(n) for i, n in enumerate(names)))
