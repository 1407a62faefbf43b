"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles is reduced to minima under ``HASHES`` hash functions. Bands of ``ROWS`` minima
propose candidates; the packed low bits of the minima estimate the similarity, corrected for accidental agreement
of bits, by counting bits; links are confirmed on the full sets. Equal sets are one node from the start, and a
bucket of n nodes is first compared with one hub, then with others, rather than with itself, so that large groups of
copies cost n comparisons; a hub that has met its bucket leaves it, so no pair is compared again there; what is left in different components of one bucket is compared in full, by long signatures
and then whole sets in blocks that are dealt pair by pair, so no link is given up to save work and no bucket is one
task's; such a task gives at most one link for each component that it joins to another, not all pairs.

Defined results: words are runs of bytes other than ASCII white space, with A-Z lower-cased; a document of fewer
words than a shingle is one shingle; a null text or one without words has the empty set and no links; rows that
repeat a doc_id are one document, which has the links of all its texts, in whatever order the rows come; rows with a
null doc_id are kept and never linked; texts are taken whole however long; empty tables give empty results; other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, if_any, join_spread, map_in_slices, saved, split_by_keys
from .graph import components

BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Low bits kept of each minimum; SIGNED minima make LANES 64-bit words.
BITS, SIGNED = 2, 128
LANES = BITS * SIGNED // 64
#: Documents whose buckets stay in several components get long signatures: as many minima as make the standard error of
#: an estimate ERROR at a similarity of 0.8, where values agree by a chance of AGREE; whole 64-bit words.
ERROR = 0.008
AGREE = 2.0**-BITS + (1 - 2.0**-BITS) * 0.8
LONG = 64 // BITS * ceil(AGREE * (1 - AGREE) / ((1 - 2.0**-BITS) * ERROR) ** 2 * BITS / 64)
#: Nodes of NODE bytes in a block of a bucket, where nodes with larger sets count as more and with smaller ones as less
#: (SIGNS bytes are for all but the set); rows from which a key counts as hot and is dealt to many tasks.
BLOCK, NODE, SIGNS, HOT = 2048, 4096, 1024, 1000
#: Standard errors by which an estimate may fall short of the threshold before a candidate is given up.
SLACK = 5.0
FEWER, CACHED_WORDS, CHUNK = 0x9E3779B97F4A7C15, 100_000, 512
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of each word, as bytes; a bounded table."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh64_digest(word)
        if len(word) <= 40:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``n`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join(map(hashes.__getitem__, words)), ">u8").astype(np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, FEWER + (n - k), np.uint64)
    for j in range(k):
        h = _mix(h * MIX_2 + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def _functions(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` hash functions x * a + b mod 2**32, each a permutation of 32-bit numbers."""
    rng = np.random.default_rng([20240229, n])
    a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 2**32 - 1, np.uint32)
    short = shingles.astype(np.uint32)
    for i in range(0, len(short), CHUNK):
        h = short[None, i : i + CHUNK] * a
        h += b
        np.minimum(low, h.min(axis=1), out=low)
    return _mix(low.astype(np.uint64))


def pack_bits(low: np.ndarray, n: int = SIGNED) -> np.ndarray:
    """The low BITS bits of ``n`` minima as signed 64-bit words."""
    values = (low[:n] & np.uint64(2**BITS - 1)).reshape(n * BITS // 64, -1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return (values << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (of the whole set), sig (packed low bits), bands (a hash for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _functions()
        salt = np.arange(BANDS, dtype=np.uint64) * MIX_1
        for batch in batches:
            n, keys, sigs, bands = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words, hashes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    sigs.append([]), bands.append([])
                    continue
                low = minima(s, a, b)
                sigs.append(pack_bits(low))
                h = salt.copy()
                for row in low.reshape(BANDS, ROWS).T:
                    h = _mix(h * MIX_2 + row)
                bands.append(h.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, longs), pa.array(bands, longs)],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "sig", "bands"],
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    return map_in_slices(ids, run, "doc_id long, text_hash long, n_shingles long, set_key binary, sig array<long>, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, set: the whole shingle set of each row of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, hashes).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return map_in_slices(texts, run, "node long, set array<long>", 200)


def agreeing(a: Column, b: Column) -> Column:
    """How many of the SIGNED packed values agree, by bit counts."""
    odd = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for i in range(LANES):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return F.lit(SIGNED) - differ


def least_agreement(similarity: float, n: int = SIGNED) -> int:
    """Of two sets this similar, values agree with p = C + (1 - C) * similarity, C = 2 ** -BITS by accident."""
    c = 2.0**-BITS
    p = c + (1 - c) * similarity
    return int(n * p - SLACK * (n * p * (1 - p)) ** 0.5)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures, corrected for accidental agreement."""
    c = 2.0**-BITS
    return F.greatest(F.lit(0.0), (agreeing(a, b) / SIGNED - c) / (1 - c))


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, where rows that repeat an id and a text are one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    if repeated.isEmpty():
        return texts
    maybe, others = split_by_keys(texts, F.col("doc_id"), repeated.select("doc_id"))
    return others.unionByName(maybe.dropDuplicates(["doc_id", "text_hash"]))


def _same_id(known: DataFrame, groups: DataFrame, several: DataFrame) -> DataFrame:
    """a, b: nodes that one doc_id with several texts belongs to."""
    hot = if_any(several.filter(F.col("n") > HOT).select("doc_id"))
    rows = join_spread(known.select("doc_id", "set_key"), several.select("doc_id"), "doc_id", hot, F.col("set_key"))
    named = rows.join(groups.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
    first = named.groupBy("doc_id").agg(F.min("node").alias("a"))
    return join_spread(named, first, "doc_id", hot, F.col("node")).filter("a <> node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_copies (rows with the same set)."""
    return _classified(docs, words, percent)[0]


def _classified(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What ``near_duplicates`` gives, and the ids that rows repeat (doc_id, n)."""
    with Scratch(docs.sparkSession, "minhash") as kept:
        sigs = kept.save(signatures(docs, words), "sigs")
        known = sigs.filter("n_shingles > 0 and doc_id is not null")
        # equal sets are one node, numbered as it is written; its text is that of the row with the smallest id
        head = F.min(F.struct("doc_id", "text_hash", "sig", "bands")).alias("h")
        grouped = known.groupBy("set_key").agg(head, F.count("*").alias("n_copies")).select(F.monotonically_increasing_id().alias("node"), "set_key", "h.*", "n_copies")
        groups = kept.save(grouped, "groups")
        by_id = sigs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), *(f(F.xxhash64("set_key")).alias(k) for k, f in (("x", F.min), ("y", F.max))))
        repeated = saved(by_id.filter("n > 1"), "minhash-repeated")
        several = if_any(repeated.filter("x < y"))
        label = _linked(_once(docs, repeated), groups, several and _same_id(known, groups, several), words, percent, kept)

        # the smallest id of each component, then of each set
        least = label.join(groups.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
        least = kept.save(least, "least")
        named = join_spread(label, least.drop("n"), "comp", if_any(least.filter(F.col("n") > HOT).select("comp")), F.col("node")).select("node", "component_id")
        sets = groups.select("node", "set_key", "doc_id", "n_copies").join(named, "node", "left")
        sets = kept.save(sets.select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"), "n_copies"), "classes")
        copied = if_any(sets.filter(F.col("n_copies") > HOT).select("set_key"))
        full = join_spread(known.select("doc_id", "n_shingles", "set_key"), sets, "set_key", copied, F.col("doc_id")).drop("set_key")
        alone = sigs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
        out = full.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_copies")
        return saved(out, "near-duplicates"), repeated


def _linked(texts: DataFrame, groups: DataFrame, same_id: DataFrame | None, words: int, percent: int, kept: Scratch) -> DataFrame:
    """node, comp of all nodes that have a link."""
    sig = groups.select("node", "sig")
    bands = groups.select("node", F.explode("bands").alias("band"))
    sets = lambda ids: _sets_of(texts, groups, ids, words)

    # buckets that hold more than one node, with the smallest as hub
    hubs = kept.save(bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    hot = if_any(hubs.filter(F.col("n") > HOT).select("band"))
    shared = kept.save(join_spread(bands, hubs.select("band", "hub"), "band", hot, F.col("node")), "shared")
    pairs = shared.select(F.col("hub").alias("lo"), F.col("node").alias("hi")).filter("lo < hi").distinct()
    found = _confirm(kept.save(pairs, "pairs"), sig, sets, percent, kept)
    edges = found.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    label = components(edges if same_id is None else edges.unionByName(same_id))

    # a hub has met all of its bucket that it isn't joined with, so only the others still have to meet there
    left = shared.filter("node <> hub")
    for turn in (1, 2, 3):
        live = kept.save(_unsettled(left, label, hot), f"live-{turn}")
        if live.isEmpty():
            break
        if turn < 3:
            # another hub, drawn anew in each bucket, for the nodes of its other components
            order = F.xxhash64("node", "band", F.lit(turn))
            drawn = live.groupBy("band").agg(F.min_by(F.struct("node", "comp"), order).alias("h"))
            met = kept.save(join_spread(live, drawn, "band", hot, F.col("node")).filter("node <> h.node"), f"met-{turn}")
            left = met
            pairs = met.filter("comp <> h.comp").select(F.col("h.node").alias("lo"), F.col("node").alias("hi"), F.col("h.comp").alias("a"), F.col("comp").alias("b")).distinct()
            more = _confirm(kept.save(pairs, "pairs"), sig, sets, percent, kept)
        else:
            more = kept.save(_across(texts, groups, live, words, percent, kept), "links")
        merged = if_any(components(more.select("a", "b")))
        if merged is None:
            continue
        step = merged.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        large = if_any(label.groupBy("comp").count().filter(F.col("count") > HOT).select("comp"))
        moved = join_spread(label, step, "comp", large, F.col("node"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        # nodes that had no link before
        label = kept.save(moved.unionByName(merged.join(label, "node", "left_anti")), f"label-{turn}")
    return label


def long_signatures(texts: DataFrame, words: int) -> DataFrame:
    """node, bits (the low BITS bits of LONG minima, packed), set (the whole one) and bytes, for the few documents that
    need close estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _functions(LONG)
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, hashes) for t in batch.column(1)]
            bits = [pack_bits(minima(s, a, b), LONG).tobytes() for s in sets]
            arrays = [pa.array(bits, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([SIGNS + s.nbytes for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["node", "bits", "set", "bytes"])

    return map_in_slices(texts, run, "node long, bits binary, set binary, bytes long", 200)


def _across(texts: DataFrame, groups: DataFrame, live: DataFrame, words: int, percent: int, kept: Scratch) -> DataFrame:
    """lo, hi, a, b: links between nodes that share a bucket but no component (a, b), enough to join all components
    that links join.

    Buckets are cut into blocks of about BLOCK * NODE bytes. Each pair of blocks of a bucket is a key of its own, so that a
    large bucket is spread over all tasks. A task compares two blocks at a time: pairs with close long signatures, each
    in the first bucket that its nodes share, by their whole sets. Nodes that the task has joined by links are not
    compared again, so it gives fewer links than its blocks have nodes. Where one of two nodes has left the first bucket
    that they share, it was a hub there and they have been compared.
    """
    ids = live.select("node").distinct()
    named = _texts_of(texts, groups.select("node", "doc_id", "text_hash").join(ids, "node", "left_semi"))
    signed = kept.save(long_signatures(named, words), "long")
    sized = live.join(signed.select("node", "bytes"), "node")
    blocks = sized.groupBy("band").agg(F.ceil(F.sum("bytes") / (BLOCK * NODE)).cast("int").alias("blocks"))
    short = groups.select("node", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands"))
    # buckets without a row in ``many`` are one block
    many = blocks.filter("blocks > 1")
    rows = join_spread(live, many, "band", if_any(many.select("band")), F.col("node"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("node", "band", "comp", "block", other).select("node", "band", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(signed.drop("bytes").join(short, "node"), "node")
    tiles = rows.repartition("band", "i", "j").groupBy("band", "i", "j")
    tiles = tiles.agg(F.collect_list(F.struct("node", "comp", "bits", "bands", "set", (F.col("block") == F.col("i")).alias("left"))).alias("n"))
    least = least_agreement(percent / 100, LONG)

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        same = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * same >= percent * (len(x) + len(y) - same)

    def columns(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(rows), -1)
        bands = rows.field("bands").flatten().to_numpy().reshape(len(rows), -1)
        return rows.field("node").to_numpy(), rows.field("comp").to_numpy(), bits, bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, one = np.uint64(0x5555555555555555), np.uint64(1)
        for batch in batches:
            found = []
            for band, i, j, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                nodes, comps, bits, bands = columns(rows.values)
                sets, now = rows.values.field("set"), comps.copy()
                whole = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
                # one block with itself, or the rows of one block with those of the other
                own = np.arange(len(nodes)) if i == j else np.flatnonzero(rows.values.field("left").to_numpy(zero_copy_only=False))
                rest = own if i == j else np.setdiff1d(np.arange(len(nodes)), own)
                for k, x in enumerate(own):
                    others = rest[k + 1 :] if i == j else rest
                    others = others[now[others] != now[x]]
                    differ = bits[x] ^ bits[others]
                    differ = np.bitwise_count((differ | (differ >> one)) & odd).sum(axis=1, dtype=np.int64)
                    for y in others[LONG - differ >= least]:
                        first = bands[x][np.flatnonzero(bands[x] == bands[y])[0]]
                        if now[x] != now[y] and first == band & 0x7FFFFFFF and linked(whole(x), whole(y)):
                            now[now == now[y]] = now[x]
                            a, b = (x, y) if nodes[x] < nodes[y] else (y, x)
                            found.append((nodes[a], nodes[b], comps[a], comps[b]))
            yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], pa.int64()) for f in range(4)], names=["lo", "hi", "a", "b"])

    return map_in_slices(tiles, run, "lo long, hi long, a long, b long", 1).distinct()


def _unsettled(left: DataFrame, label: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows of ``left`` (node, band) in buckets whose nodes there are in more than one component: node, band, comp."""
    now = left.select("node", "band").join(label, "node", "left").select("node", "band", F.coalesce("comp", "node").alias("comp"))
    split = now.groupBy("band").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l < h").select("band")
    return join_spread(now, split, "band", hot, F.col("node"))


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of ``nodes`` (node, doc_id, text_hash): the row of each that has its id and text."""
    maybe, _ = split_by_keys(texts, F.col("doc_id"), nodes.select("doc_id"))
    return maybe.join(nodes, ["doc_id", "text_hash"]).select("node", "text")


def _sets_of(texts: DataFrame, groups: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, set of the nodes in ``ids``."""
    return shingle_sets(_texts_of(texts, groups.select("node", "doc_id", "text_hash").join(ids, "node", "left_semi")), words)


def _confirm(pairs: DataFrame, sig: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, kept: Scratch) -> DataFrame:
    """Of candidate pairs (lo, hi and other columns) those whose whole sets reach the threshold; the estimate rules out
    most others. Pairs of a node that is in many are dealt to several tasks, each with a copy of its set."""
    extra = [c for c in pairs.columns if c not in ("lo", "hi")]

    busy = pairs.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node").count().filter(F.col("count") > HOT).select("node")
    busy = if_any(kept.save(busy, "busy"))

    def attach(rows: DataFrame, few: DataFrame, key: str, name: str, by: str) -> DataFrame:
        return join_spread(rows, few.toDF(key, name), key, busy, F.col(by))

    both = attach(attach(pairs, sig, "lo", "s", "hi"), sig, "hi", "t", "lo")
    close = both.filter(agreeing(F.col("s"), F.col("t")) >= least_agreement(percent / 100))
    close = kept.save(close.select("lo", "hi", *extra), "close")
    needed = close.select(F.col("lo").alias("node")).unionByName(close.select(F.col("hi").alias("node"))).distinct()
    full = kept.save(sets(needed), "sets")
    both = attach(attach(close, full, "lo", "s", "hi"), full, "hi", "t", "lo")
    same = F.size(F.array_intersect("s", "t"))
    both = both.select("lo", "hi", *extra, same.alias("same"), (F.size("s") + F.size("t") - same).alias("either"))
    return kept.save(both.filter(F.col("same") * 100 >= F.col("either") * percent).select("lo", "hi", *extra), "links")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay.

    Of rows that repeat the id that stays, the one that is first as JSON stays; rows with a null doc_id all stay.
    """
    found, repeated = _classified(docs, words, percent)
    gone_id = free_name("_gone", docs)
    gone = saved(found.filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "minhash-gone")
    own = F.col("doc_id").cast("long")
    maybe, clear = split_by_keys(docs, own, gone)
    rows = clear.unionByName(maybe.join(gone, own == F.col(gone_id), "left_anti"))
    if repeated.isEmpty():
        return rows
    maybe, clear = split_by_keys(rows, own, repeated.select("doc_id"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = maybe.filter("doc_id is not null").groupBy(own.alias("_key")).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return clear.unionByName(maybe.filter("doc_id is null")).unionByName(one)
