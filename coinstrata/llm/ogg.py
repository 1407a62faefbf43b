"""Ogg media columns: multiplexed logical streams written to and read from binary values.

The encoder deals 8-bit samples to one or more channels, each a logical stream of its own. A stream's packets are laid
into pages one after the other, so that a page holds several packets and a packet may go on in the next page; a page's
granule position is the end sample of the last packet that ends on it. The decoder verifies page checksums, reassembles
packets from lacing values, demultiplexes by serial number, and derives the time of every packet backwards from the
granule position of the page on which it ends (RFC 3533).

Defined results: a null value is treated as empty by ``encode_texts``; damaged or truncated media raise OggError in
``decode`` and become a null payload with the reason in ``error`` in ``decode_media``; values are stored whole however
long; repeated, equal and empty values are values like others, equal ones with equal media; the empty table gives the
empty table; other columns may have any names but ``media``, ``payload``, ``feature`` and ``error``, which are made anew.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_in_slices

#: Samples in a second, samples in a packet, logical streams, lacing values in a page at most, bytes of padding.
RATE, PACKET, STREAMS, LACING, BLOCK = 8000, 1000, 2, 17, 64
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC = b"\x80pcm8\x00"  # head of a stream's identification packet: then rate, channel, channels, samples
HEAD = struct.Struct("<4sBBqIII B")
IDENT = struct.Struct("<6sIBBQ")
NO_GRANULE = -1
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, most significant bit first, from 0, not inverted: zlib's, all bits reversed."""
    reflected = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    made = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return made[:22] + struct.pack("<I", checksum(made)) + made[26:]


def logical_stream(serial: int, head: bytes, packets: list[bytes], lacing: int = LACING) -> list[bytes]:
    """The pages of one stream: one for its head, then packets end to end, ``lacing`` values to a page."""
    values = [(n, i) for i, p in enumerate(packets) for n in (*[255] * (len(p) // 255), len(p) % 255)]
    ends = np.cumsum([len(p) for p in packets]).tolist()
    body, at = b"".join(packets), 0
    out = [page(serial, 0, 0, FIRST | (0 if values else LAST), bytes([len(head)]), head)]
    for k in range(0, len(values), lacing):
        part = values[k : k + lacing]
        ended = [i for n, i in part if n < 255]
        flags = (CONTINUED if k and values[k - 1][0] == 255 else 0) | (LAST if k + lacing >= len(values) else 0)
        size = sum(n for n, _ in part)
        out.append(page(serial, len(out), ends[ended[-1]] if ended else NO_GRANULE, flags, bytes(n for n, _ in part), body[at : at + size]))
        at += size
    return out


def encode(payload: bytes, rate: int = RATE, streams: int = STREAMS, packet: int = PACKET, lacing: int = LACING) -> bytes:
    """Samples of one byte; sample k belongs to channel k mod ``streams``. Pages of the streams alternate, heads first."""
    made = []
    for s in range(streams):
        own = payload[s::streams]
        parts = [own[i : i + packet] for i in range(0, len(own), packet)]
        made.append(logical_stream(s + 1, IDENT.pack(MAGIC, rate, s, streams, len(payload)), parts, lacing))
    return b"".join(pages[k] for k in range(max(map(len, made))) for pages in made if k < len(pages))


@dataclass
class Packet:
    """``granule`` is that of the page on which the packet ends, ``after`` the bytes of later packets that end there."""

    serial: int
    data: bytes
    granule: int
    after: int
    first: bool


def packets(media: bytes) -> list[Packet]:
    """All packets of all logical streams in the order in which they end."""
    out: list[Packet] = []
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27:
            raise OggError("truncated page header")
        magic, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("lost capture pattern")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("truncated page")
        if crc != checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]):
            raise OggError("checksum differs")
        if number != expected.get(serial, 0):
            raise OggError("page missing")
        expected[serial] = number + 1
        open_part = parts.setdefault(serial, [])
        if bool(kind & CONTINUED) != bool(open_part):
            raise OggError("packet broken between pages")
        pos = begun = at + 27 + n
        ended = []
        for x in lacing:
            pos += x
            if x < 255:
                ended.append(b"".join([*open_part, media[begun:pos]]))
                open_part.clear()
                begun = pos
        if lacing and lacing[-1] == 255:
            open_part.append(media[begun:pos])
        after = sum(map(len, ended))
        for data in ended:
            after -= len(data)
            out.append(Packet(serial, data, granule, after, bool(kind & FIRST)))
        at = end
    if any(parts.values()):
        raise OggError("last packet is not complete")
    return out


@dataclass
class Decoded:
    payload: bytes
    rate: int
    streams: int
    packets: int
    seconds: float
    starts: dict[int, list[float]]  # by stream, the times at which its packets begin


def decode(media: bytes) -> Decoded:
    """The samples of all logical streams in order of time."""
    rate = streams = samples = count = 0
    channel: dict[int, int] = {}
    known: dict[int, list[bytes]] = {}
    begun: dict[int, list[float]] = {}
    at: dict[int, int] = {}
    for p in packets(media):
        if p.first and p.serial not in known:
            if len(p.data) != IDENT.size or not p.data.startswith(MAGIC):
                raise OggError("unknown stream type")
            _, rate, channel[p.serial], streams, samples = IDENT.unpack(p.data)
            known[p.serial], begun[p.serial], at[p.serial] = [], [], 0
        elif p.serial not in known or p.granule < 0:
            raise OggError("packet without stream or position")
        else:
            end = p.granule - p.after
            if end - len(p.data) != at[p.serial]:
                raise OggError("gap in time")
            begun[p.serial].append(at[p.serial] / max(1, rate))
            known[p.serial].append(p.data)
            at[p.serial], count = end, count + 1
    if sum(at.values()) != samples or len(known) != streams or sorted(channel.values()) != list(range(streams)):
        raise OggError("samples missing")
    payload = np.empty(samples, np.uint8)
    for serial, parts in known.items():
        own = np.frombuffer(b"".join(parts), np.uint8)
        if len(own) != len(payload[channel[serial] :: streams]):
            raise OggError("samples missing")
        payload[channel[serial] :: streams] = own
    return Decoded(payload.tobytes(), rate, streams, count, samples / (streams * rate) if rate else 0.0, begun)


def features(d: Decoded) -> str:
    """Duration and shape of the samples taken as unsigned 8-bit around 128."""
    x = np.frombuffer(d.payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    thirds = [int(np.abs(p).sum()) // max(1, len(p)) for p in np.array_split(x, 4)]
    return (
        f"rate={d.rate};streams={d.streams};packets={d.packets};ms={round(d.seconds * 1000)};"
        f"mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) // n};peak={int(np.abs(x).max(initial=0))};"
        f"crossings={crossings};envelope={','.join(map(str, thirds))}"
    )


def encode_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with 0 to a positive multiple of ``block``, as Ogg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8") for t in b.column(1)]
            media = [encode(x + bytes(max(block, -(-len(x) // block) * block) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_in_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes bigint, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """The columns of ``media`` and payload, feature, error: what is read back from the column media."""
    rows = media.drop("payload", "feature", "error")
    at = rows.columns.index("media")
    schema = T.StructType([*rows.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, feats, errors = [], [], []
            for m in b.column(at):
                try:
                    d = decode(m.as_py() or b"")
                    payloads.append(d.payload), feats.append(features(d)), errors.append(None)
                except OggError as e:
                    payloads.append(None), feats.append(None), errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(payloads, pa.binary()), pa.array(feats, pa.string()), pa.array(errors, pa.string())],
                names=[*b.schema.names, "payload", "feature", "error"],
            )

    return map_in_slices(rows, run, schema)


def media_digest(media: bytes) -> str:
    return hashlib.sha256(media).hexdigest()
