"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes proposes boundaries; chunking is normalised: a strict test before the normal
chunk size and a loose one after it, so sizes gather around it. A fingerprint is the set of the chunks' digests with
their lengths. As boundaries depend on nearby bytes only, an insertion changes few chunks, and the length-weighted
share of one document's chunks found in another measures containment.

Defined results: a null text counts as empty; the empty text has the empty fingerprint, contained in another empty
one (1) and in nothing else (0); equal texts have equal fingerprints; documents are ordered by doc_id descending (nulls
last), then by a hash of the text, and each repeated row is a document of its own; the only document of a table is its
own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_in_slices, parts_for, saved

WINDOW, LEAST, NORMAL, MOST = 16, 16, 64, 256
STRICT, LOOSE = 7, 5
GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)
ROWS_PER_PART = 20_000


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    n = 1
    while n < WINDOW:
        h[n:] += h[:-n] << np.uint32(n)
        n *= 2
    marks = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = (h[marks] < np.uint32(1 << (32 - STRICT))).tolist()
    cuts, start = [], 0
    for p, sure in zip(marks.tolist(), strict):
        size = p + 1 - start
        while size > MOST:
            start += MOST
            cuts.append(start)
            size = p + 1 - start
        if size >= (LEAST if sure else NORMAL):
            start = p + 1
            cuts.append(start)
    while len(raw) - start > MOST:
        start += MOST
        cuts.append(start)
    if start < len(raw):
        cuts.append(len(raw))
    return cuts


def chunk_set(text: str) -> dict[bytes, int]:
    """Length by digest (64 bits) of the distinct chunks of a text's UTF-8 bytes."""
    raw, start, out = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in boundaries(raw) if raw else ():
        out[xxhash.xxh3_64_digest(raw[start:end])] = end - start
        start = end
    return out


CHUNK_BYTES = 9


def packed(chunks: dict[bytes, int]) -> bytes:
    """Nine bytes for each chunk, its digest and its length less one, in order of the digests."""
    return b"".join(d + bytes([n - 1]) for d, n in sorted(chunks.items()))


def to_text(chunks: dict[bytes, int]) -> str:
    """``packed`` as base64, twelve characters for each chunk."""
    return base64.urlsafe_b64encode(packed(chunks)).decode()


def difference(own: dict[bytes, int], changed: dict[bytes, int]) -> tuple[bytes, bytes]:
    """``changed`` as a bit for each chunk of ``own`` and what only it has: most of an edited text's chunks are its own."""
    bits = np.packbits([changed.get(d) == n for d, n in sorted(own.items())]).tobytes() if own else b""
    return bits, packed({d: n for d, n in changed.items() if own.get(d) != n})


def restored(own: bytes, bits: bytes, extra: bytes) -> tuple[str, str]:
    """Both fingerprints as text."""
    cut = lambda raw: [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
    rows = cut(own)
    same = [r for r, bit in zip(rows, np.unpackbits(np.frombuffer(bits, np.uint8)).tolist()) if bit]
    return base64.urlsafe_b64encode(own).decode(), base64.urlsafe_b64encode(b"".join(sorted(same + cut(extra)))).decode()


def contained(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [to_text(chunk_set(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return map_in_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string")


#: Columns of the stored comparisons, and those that only the edges of a partition have.
STORED = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "own": pa.binary(), "shared": pa.binary(), "extra": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
EDGE = {"edge": pa.string(), "tie": pa.int64(), "text": pa.string()}
SQL_TYPES = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}


def _schema(kind: str, columns: dict[str, pa.DataType]) -> str:
    return ", ".join([f"doc_id {kind}", *(f"{k} {SQL_TYPES[t]}" for k, t in columns.items())])


class _Rows:
    """Results gathered for one Arrow batch."""

    def __init__(self, key_type: pa.DataType, columns: dict[str, pa.DataType]):
        self.columns, self.rows = {"doc_id": key_type, **columns}, []

    def pair(self, key, text: str, own: dict, following: str, other: dict) -> None:
        new = edited(text, following)
        changed = chunk_set(new) if new != text else own
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        self.rows.append((key, len(text), sha, packed(own), *difference(own, changed), contained(own, changed), contained(own, other), None, None, None))

    def edge(self, kind: str, key, order: int, text: str) -> None:
        self.rows.append((key, *[None] * len(STORED), kind, order, text))

    def batch(self) -> pa.RecordBatch:
        values = list(zip(*self.rows)) if self.rows else [()] * len(self.columns)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, self.columns.values())], names=list(self.columns))


def compare_with_next(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Fingerprints of each text and of its edited text (see ``edited``) and their likeness, and that to the next one's.

    The texts are range-partitioned once, so neighbours meet in one task; only the first and last document of each
    partition are joined afterwards. What is stored between has an edited text's fingerprint as its difference only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(docs.count(), rows_per_part)
    tie = F.xxhash64("text").alias("tie")
    rows = rows.select("doc_id", tie, "text")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, None
        for b in batches:
            out = out or _Rows(b.schema.field(0).type, {**STORED, **EDGE})
            for key, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                now = (key, text, chunk_set(text))
                if before:
                    out.pair(*before, text, now[2])
                else:
                    out.edge("first", key, t, text)
                before, last_tie = now, t
                if len(out.rows) >= 2000:
                    yield out.batch()
        if before:
            out.edge("last", before[0], last_tie, before[1])
            yield out.batch()

    made = saved(map_in_slices(ranged, run, _schema(kind, {**STORED, **EDGE})), "fingerprints")
    edges = made.filter("edge is not null")
    # two rows for each partition, without their texts, in order: first, last, first, last ...
    keys = edges.select("doc_id", "tie", "edge")
    line = Window.orderBy(F.col("doc_id").desc_nulls_last(), "tie", "edge")
    placed = keys.select("*", F.lead(F.struct("doc_id", "tie")).over(line).alias("nx"), F.first(F.struct("doc_id", "tie")).over(line).alias("top"))
    placed = placed.filter("edge = 'last'").select(F.col("doc_id").alias("l_id"), F.col("tie").alias("l_tie"), F.coalesce("nx", "top").alias("nx"))
    last, first = edges.filter("edge = 'last'").alias("l"), edges.filter("edge = 'first'").alias("f")
    both = (
        placed.join(last, F.col("l.doc_id").eqNullSafe(F.col("l_id")) & (F.col("l.tie") == F.col("l_tie")))
        .join(first, F.col("f.doc_id").eqNullSafe(F.col("nx.doc_id")) & (F.col("f.tie") == F.col("nx.tie")))
        .select(F.col("l.doc_id").alias("doc_id"), F.col("l.text").alias("text"), F.col("f.text").alias("following"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows(b.schema.field(0).type, {**STORED, **EDGE})
            for key, text, following in zip(*(c.to_pylist() for c in b.columns)):
                out.pair(key, text, chunk_set(text), following, chunk_set(following))
            yield out.batch().select(["doc_id", *STORED])

    whole = made.filter("edge is null").select("doc_id", *STORED).unionByName(both.mapInArrow(finish, _schema(kind, STORED)))
    shown = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restored(*x) for x in zip(*(b.column(k).to_pylist() for k in ("own", "shared", "extra")))]
            own, changed = zip(*texts) if texts else ((), ())
            columns = {"fingerprint": pa.array(own, pa.string()), "edited_fingerprint": pa.array(changed, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[k] if k in columns else b.column(k) for k in ("doc_id", *shown)], names=["doc_id", *shown])

    return map_in_slices(whole, spell_out, _schema(kind, shown))
