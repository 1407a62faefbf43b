"""Best-fit packing of tokenised documents into fixed-length training sequences.

Hierarchical residual packing: every bucket of pieces is packed best-fit decreasing on its own; bins that are
nearly full, or that no other underfull bin could join, are final; the underfull rest are merged in a tree of
ever fewer buckets, each bin being one item of the next best-fit round.

Defined results: a null text counts as empty; an empty document is the separator alone; repeated rows are packed
as often as they occur; of equal lengths the smaller doc_id and piece come first; texts are tokenised whole however
long; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_in_slices, parts_for, saved

CAPACITY = 2048
SEPARATOR = 0
#: Pieces (or bins) that one best-fit task holds: five numbers each, so about 20 MB.
ITEMS_PER_TASK = 100_000
NEARLY_FULL = 0.99
#: Distinct words, and parts of words, in one of the two tables of each that a worker holds (about 50 MB together).
CACHED = 100_000
FLUSH_IDS = 1_000_000


#: The tokenizers that the fast path knows: Unicode composition, one space for white space, lower case; parts split by
#: this expression, bytes as letters. Others tokenise each text whole.
KNOWN = (
    ["NFC", ("Replace", r"\s+", " "), "Lowercase"],
    [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True), ("ByteLevel", False, False)],
)
#: What the fast path may not meet: all but Latin text, whose lower case and normal form are plain, and marks that
#: could be special tokens. Texts of PLAIN bytes alone (but for the capital dotted i) need no closer look.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\|")
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
LOOK = (b"<|", "\u0130".encode())
#: The tokenizer's own split, written for such text: contractions, letters, single digits, other signs.
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, other bytes
    for the letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def settings_of(tokenizer) -> tuple[list, list]:
    """Normaliser and split of a tokenizer, in the form of KNOWN. Only these two are read, not the vocabulary."""

    def steps(part, inner: str) -> list[dict]:
        spec = None if part is None else json.loads(part.__getstate__())
        return [] if spec is None else spec[inner] if spec["type"] == "Sequence" else [spec]

    def named(x: dict):
        if x["type"] == "Replace":
            return "Replace", x["pattern"].get("Regex"), x["content"]
        if x["type"] == "Split":
            return "Split", x["pattern"].get("Regex"), x["behavior"], x["invert"]
        return (x["type"], x["add_prefix_space"], x["use_regex"]) if x["type"] == "ByteLevel" else x["type"]

    return [named(x) for x in steps(tokenizer.normalizer, "normalizers")], [named(x) for x in steps(tokenizer.pre_tokenizer, "pretokenizers")]


class Recent(dict):
    """A bounded table: when it is full it becomes the old one, in which misses are looked up before ``make``."""

    old: dict = {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHED:
            self.old = {}  # gone before the copy is made
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class PartIds(Recent):
    """Ids (little-endian, 32 bits each) of one part of a word, merged by the tokenizer's model."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def make(self, part: str) -> bytes:
        raw = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(Recent):
    """Ids of words by way of bounded tables.

    A tokenizer as in KNOWN lower-cases, splits into parts and merges inside each part alone, so the ids of a text of
    plain words are the ids of their parts in order. Texts that aren't plain, and all texts of other tokenizers, go to
    it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = PartIds(self.tokenizer.model)
        self.known = settings_of(self.tokenizer) == KNOWN

    def make(self, word: bytes) -> bytes:
        if word.isalpha():  # of ASCII alone: one part
            return self.parts[word.decode()]
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word.decode().lower())))

    def ids(self, raw: bytes) -> bytes:
        """Ids of a text in UTF-8."""
        if not self.known or ((raw.translate(None, PLAIN) or any(x in raw for x in LOOK)) and UNUSUAL.search(raw.decode())):
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, raw.lower().split()))


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. Only documents over
    ``capacity`` ids are cut."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def batch(keys, rows, key_type) -> pa.RecordBatch:
        piece, start, crc, ids = zip(*rows)
        sizes = [len(x) for x in ids]
        columns = [pa.array(keys, key_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordIds(tokenizer_path), np.array([separator], "<u4").tobytes()
        for b in batches:
            keys, rows, held = [], [], 0
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = np.frombuffer(words.ids(raw or b"") + last, "<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    keys.append(key)
                    rows.append((k, start, zlib.crc32(part), part))
                held += len(ids)
                if held > FLUSH_IDS:
                    yield batch(keys, rows, b.schema.field(0).type)
                    keys, rows, held = [], [], 0
            if rows:
                yield batch(keys, rows, b.schema.field(0).type)

    return map_in_slices(docs.select("doc_id", "text"), run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of items taken in the order given: bin and offset of each, fill of each bin.

    ``room`` has one bit for each free space that some open bin has; the fullest bin that still fits is the lowest
    set bit at or above the length.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0
    for i, n in enumerate(lengths.tolist()):
        fits = room >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            k = by_room[free].pop()
            if not by_room[free]:
                room &= ~(1 << free)
        else:
            k, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        left = free - n
        if left:
            by_room[left].append(k)
            room |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _round(items: DataFrame, length: str, level: int, buckets: int, capacity: int) -> DataFrame:
    """Pack each of ``buckets`` hash buckets on its own; adds _bin, _at (offset in it) and _fill (of the bin)."""
    names = items.columns
    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_bin", "_at", "_fill"))])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        others = [(c, "ascending") for c in names if c != length]
        rows = rows.select(names).sort_by([(length, "descending"), *others])
        bins, at, fill = best_fit(rows[length].to_numpy(), capacity)
        bins_id = bins + (level << 56 | key[0].as_py() << 24)
        for name, values in (("_bin", bins_id), ("_at", at), ("_fill", fill[bins])):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    # the number of the row as it is read keeps equal rows out of one bucket
    bucket = F.pmod(F.xxhash64(F.lit(level), F.monotonically_increasing_id(), *names), F.lit(buckets))
    return items.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(pack, schema)


def pack(
    items: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    items_per_task: int = ITEMS_PER_TASK,
    nearly_full: float = NEARLY_FULL,
) -> DataFrame:
    """Add sequence_id and offset to items whose ``length`` is 1 to ``capacity``. Items should be narrow."""
    n = items.count()
    local = saved(_round(items, length, 0, parts_for(n, items_per_task), capacity), "pack-0")
    bins = local.filter("_at = 0").select(F.col("_bin").alias("bin"), F.col("_fill").alias("fill"))
    moved = None  # where each underfull bin of the first round is now: bin, cur, base
    level = 1
    while level < 100:
        under = saved(_mergeable(bins, capacity, nearly_full), f"pack-under-{level}")
        n = under.count()
        if n < 2:
            break
        buckets = parts_for(n, items_per_task)
        merged = saved(_round(under, "fill", level, buckets, capacity), f"pack-{level}")
        bins = merged.filter("_at = 0").select(F.col("_bin").alias("bin"), F.col("_fill").alias("fill"))
        step = merged.select(F.col("bin").alias("cur"), F.col("_bin").alias("next"), F.col("_at").alias("add"))
        if moved is None:
            moved = step.select(F.col("cur").alias("bin"), F.col("next").alias("cur"), F.col("add").alias("base"))
        else:
            moved = saved(
                moved.join(step, "cur", "left").select(
                    "bin", F.coalesce("next", "cur").alias("cur"), (F.col("base") + F.coalesce("add", F.lit(0))).alias("base")
                ),
                f"pack-moved-{level}",
            )
        if buckets == 1 or bins.count() > 0.99 * n:
            break
        level += 1
    if moved is None:
        return local.withColumns({"sequence_id": F.col("_bin"), "offset": F.col("_at")}).drop("_bin", "_at", "_fill")
    moved = moved.withColumnsRenamed({"bin": "_bin", "cur": "_cur", "base": "_base"})
    return (
        local.join(moved, "_bin", "left")
        .withColumns({"sequence_id": F.coalesce("_cur", "_bin"), "offset": F.col("_at") + F.coalesce("_base", F.lit(0))})
        .drop("_bin", "_at", "_fill", "_cur", "_base")
    )


def _mergeable(bins: DataFrame, capacity: int, nearly_full: float) -> DataFrame:
    """Underfull bins that could still take, or be taken by, the emptiest one."""
    under = bins.filter(F.col("fill") < nearly_full * capacity)
    least = under.agg(F.min("fill").alias("_least"))
    return under.join(F.broadcast(least), F.col("fill") + F.col("_least") <= capacity).select("bin", "fill")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id, ids. ``packed`` has doc_id, piece, sequence_id, offset."""
    placed = pieces.select("doc_id", "piece", "ids").join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise and pack: one row per piece with its place. The ids are not kept; ``sequences`` joins them again."""
    pieces = saved(tokenise(docs, tokenizer_path, capacity, with_ids=False), "pieces")
    return pack(pieces, "length", capacity, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
