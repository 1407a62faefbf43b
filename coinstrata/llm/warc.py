"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by page, into shards of about equal bytes; each shard is written as files that roll over at a
compressed size. Of pages with equal payloads the one with the smallest id is a response and the others are revisit
records that refer to it; headers, lengths and digests are made anew. Files get temporary names until they are whole,
and only files that the manifest lists count, so tasks that are run again change nothing.

Defined results: a null html is the empty payload; pages without id come first and their record ids say ``null``;
pages that share an id are sorted by a hash of url and payload, which may part them into several shards; rows repeated
with the same id and payload are all responses; payloads are written whole however long; an empty table gives an
archive of no files; extra columns are ignored; payloads of fewer than ``least_bytes`` are never revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_any, join_spread, map_in_slices, new_path, parts_for, saved, split_by_keys

#: Bytes of payload in a shard, compressed bytes at which a file is full, compressed bytes that a reading task gets.
SHARD_BYTES, FILE_BYTES, READ_BYTES = 32 << 20, 8 << 20, 8 << 20
#: Shards at most (larger ones beyond), pages drawn for each to find its bounds, bytes that a record has beside its payload.
MOST_SHARDS, DRAWN, RECORD_BYTES = 10_000, 64, 600
#: Copies of a payload from which they are dealt to many tasks; pages without id are sorted before all others.
HOT, NO_ID = 1000, -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard bigint, records bigint, bytes bigint, sha256 string"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record: an HTTP response, or for a revisit its head alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, more, block = "response", [], http + payload
    if refers_to is not None:
        kind, block = "revisit", http
        more = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        *more,
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name: equal data, equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (not null), tie (a hash of the last two), refers_to of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("tie", F.xxhash64("url", "html"))
    digest = F.sha1(F.col("html").cast("binary"))
    repeated = (
        rows.filter(F.octet_length("html") >= least_bytes)
        .groupBy(digest.alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    repeated = saved(repeated, "warc-repeated")
    # only pages that may have a copy meet the table of copies; the others' payloads are not shuffled for it
    maybe, single = split_by_keys(rows, digest, repeated.select("_digest"))
    hot = if_any(repeated.filter(F.col("_n") > HOT).select("_digest"))
    joined = join_spread(maybe.withColumn("_digest", digest), repeated.select("_digest", "_first"), "_digest", hot, F.struct("page_id", "tie"), "left")
    joined = joined.drop("_digest").unionByName(single.withColumn("_first", F.lit(None).cast("long")))
    refers = F.when(F.col("_first") < F.col("page_id"), F.col("_first"))
    return joined.select("page_id", "url", "html", "tie", refers.alias("refers_to"))


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """The first (page_id, tie) of each shard but the first, so that shards have about equal bytes.

    They are taken from a sample in which a page's chance is its share of the bytes, drawn by a hash of the page itself:
    the same pages have the same shards, however they are partitioned. At most MOST_SHARDS x DRAWN pages are expected
    in it, and as many that are larger than that; their ids and hashes are all that reaches the driver.
    """
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    keys = pages.select(page.alias("page"), F.xxhash64(F.col("url").cast("string"), F.coalesce("html", F.lit(""))).alias("tie"), (F.octet_length(F.coalesce("html", F.lit(""))) + RECORD_BYTES).alias("size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    shards = min(MOST_SHARDS, parts_for(total, shard_bytes))
    if shards == 1:
        return []
    step = total / (shards * DRAWN)
    chance = F.pmod(F.xxhash64(F.lit("shard"), "page", "tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.filter(F.col("size") >= chance * step).select("page", "tie", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    drawn = drawn.groupBy("page", "tie").agg(F.sum("weight").alias("weight")).toPandas().sort_values(["page", "tie"], ignore_index=True)
    reached = drawn["weight"].cumsum()
    at = np.searchsorted(reached, reached.iloc[-1] * np.arange(1, shards) / shards) if len(drawn) else []
    return sorted({(int(drawn["page"][i]), int(drawn["tie"][i])) for i in at})


def with_shards(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of their shard; only ids and hashes go through Python."""
    if not bounds:
        return rows.withColumn("shard", F.lit(0))
    kind = np.dtype([("page", np.int64), ("tie", np.int64)])
    shared = rows.sparkSession.sparkContext.broadcast(np.array(bounds, kind))

    @F.pandas_udf("int")
    def shard(page: pd.Series, tie: pd.Series) -> pd.Series:
        keys = np.empty(len(page), kind)
        keys["page"], keys["tie"] = page, tie
        return pd.Series(np.searchsorted(shared.value, keys, side="right").astype(np.int32))

    return rows.withColumn("shard", shard(F.coalesce("page_id", F.lit(NO_ID)), F.col("tie")))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write WARC files under ``path`` and their manifest as JSON under ``path``/manifest; gives the manifest."""
    spark = pages.sparkSession
    bounds = shard_bounds(pages, shard_bytes)
    placed = with_shards(plan_records(pages, least_bytes), bounds)
    # one partition for each shard, which is a range of (page_id, tie)
    tidy = placed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("page_id", "tie")
    tidy = tidy.select("shard", "page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        out = sha = None
        shard = number = size = records = 0
        temporary = ""

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                name = f"part-{shard:06d}-{number:05d}.warc.gz"
                fs.move(temporary, f"{root}/{name}")
                done.append((name, shard, records, size, sha.hexdigest()))
                out = None

        for b in batches:
            for s, page_id, url, html, refers in zip(*(b.column(i) for i in range(5))):
                s = s.as_py()
                if out is None or s != shard or size >= file_bytes:
                    close()
                    number = number + 1 if s == shard and done else 0
                    shard, size, records, sha = s, 0, 0, hashlib.sha256()
                    temporary = f"{root}/.tmp-{shard:06d}-{number:05d}-{attempt}"
                    out = fs.open_output_stream(temporary)
                data = gzip_member(record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers.as_py()))
                out.write(data)
                sha.update(data)
                size, records = size + len(data), records + 1
        close()
        if done:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["file", "shard", "records", "bytes", "sha256"])

    map_in_slices(tidy, write, MANIFEST).write.mode("overwrite").json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed whole."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(chunk)
        if not data:
            break
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("truncated WARC file")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields (lower-case names) and block of one record; its length and block digest must hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if not lines[0].startswith("WARC/1.") or rest[n:] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged WARC record {fields.get('warc-record-id')}")
    return fields, block


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit) of the files that the manifest lists."""
    manifest = read_manifest(spark, path)
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    files = manifest.select("file").repartition(parts_for(size, READ_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != length or digest_of(payload) != digest):
                            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                        refers = page_of(fields.get("warc-refers-to"))
                        rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], refers, length, digest, None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages into the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return read_archive(pages.sparkSession, path)
