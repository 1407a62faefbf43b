"""Reading tables, tables kept in the folder that all machines share, and small pieces that several operators use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one is set, on one machine only: on a
    cluster the executors would each write into a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='coinstrata-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system that Spark wrote it with."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Folders of the tables that results may still read, by application.
_kept: dict[str, list[str]] = {}


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors.

    The table stays as long as results may read it; ``forget_saved`` deletes all of them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_saved(spark: SparkSession) -> None:
    """Delete what ``saved`` wrote in this application: to be called when all results that read it are used up."""
    for path in _kept.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


class Scratch:
    """Tables of one operator that its result doesn't read, deleted together when they have served."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, new_path(spark, name), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.root}/{self.count:03d}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete_path(self.spark, self.root)


def free_name(stem: str, *taken: DataFrame) -> str:
    """A column name that begins with ``stem`` and that none of the tables has; Spark's names are blind to case."""
    used = {c.lower() for df in taken for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


#: Rows that a function works on at a time. Spark bounds the Arrow batches it hands over by bytes; texts are wide, and
#: what Python makes of a batch is a multiple of it.
ROWS_AT_A_TIME = 500


def give_back() -> None:
    """Return what a Python worker has freed to the system. Workers serve many tasks, one after the other, and what
    their allocators hold on to adds up beside the heap of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_in_slices(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, size: int = ROWS_AT_A_TIME) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches of at most ``size`` rows, whatever the session's settings are. A
    task gives back its memory when it ends."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(i, size) for b in batches for i in range(0, b.num_rows, size))
        finally:
            give_back()

    return rows.mapInArrow(sliced, schema)


def parts_for(n_rows: int, rows_per_part: int) -> int:
    return max(1, -(-n_rows // rows_per_part))


#: Bits of the map that ``split_by_keys`` broadcasts: at most BITMAP / 64 rows, whatever the data.
BITMAP = 1 << 23


def flag_keys(rows: DataFrame, column: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: true where ``column`` may be in the single column of ``keys``, false where
    it surely is not. Equal values get equal answers, null among them.

    A bitmap of hashes, of fixed size, is broadcast, so that wide rows are not shuffled to meet the few keys.
    """
    word, bits = free_name("_word", rows), free_name("_bits", rows)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    place = lambda c: F.floor(bit(c) / 64)
    mask = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(c), F.lit(64)).cast("int"))
    own = F.col(keys.columns[0])
    words = keys.groupBy(place(own).alias(word)).agg(F.bit_or(mask(own)).alias(bits))
    joined = rows.join(F.broadcast(words), place(column) == F.col(word), "left")
    inside = F.coalesce(F.col(bits).bitwiseAND(mask(column)) != 0, F.lit(False))
    return joined.withColumn(name, inside).drop(word, bits)


def split_by_keys(rows: DataFrame, column: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be in the single column of ``keys``, and rows where it surely is not. The first part
    still needs an exact join. Null is a key like another."""
    flag = free_name("_inside", rows)
    flagged = flag_keys(rows, column, keys, flag)
    return flagged.filter(F.col(flag)).drop(flag), flagged.filter(~F.col(flag)).drop(flag)


#: Shares that the rows of a hot key are dealt to by ``join_spread``.
SHARES = 32


def if_any(rows: DataFrame) -> DataFrame | None:
    """``rows``, or None if there are none, so that plans need not provide for them."""
    return None if rows.isEmpty() else rows


def join_spread(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """``rows.join(few, key, how)``, inner or left, where the rows of the keys in ``hot`` (one column) are dealt by a hash
    of ``by`` to SHARES tasks. ``few`` has a few rows for each key, which are repeated in each share if the key is hot."""
    if hot is None:
        return rows.join(few, key, how)
    share, inside = free_name("_share", rows, few), free_name("_inside", rows, few)
    drawn = F.when(F.col(inside), F.pmod(F.xxhash64(by), F.lit(SHARES))).otherwise(0).cast("int")
    last = F.when(F.col(inside), SHARES - 1).otherwise(0)
    dealt = flag_keys(rows, F.col(key), hot, inside).withColumn(share, drawn).drop(inside)
    copies = flag_keys(few, F.col(key), hot, inside).withColumn(share, F.explode(F.sequence(F.lit(0), last))).drop(inside)
    return dealt.join(copies, [key, share], how).drop(share)
