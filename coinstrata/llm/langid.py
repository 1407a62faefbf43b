"""Language identification with averaged hashed subword embeddings and a linear softmax.

The byte n-grams of a lower-cased text are hashed into a table of embeddings; their average goes through a linear
softmax. Both are trained here by stochastic gradient descent in numpy on a bounded sample of labelled rows. A
temperature fitted on rows kept out of the descent calibrates the scores, and the rejection threshold is taken from
the same rows. Scoring needs no embeddings: embedding times weights is one table of scores per n-gram, at most
BUCKETS x MAX_LANGUAGES numbers, which is what the workers get.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if no
labelled row was learned from; ties between languages go to the first in alphabetical order; texts are scored whole
however long; repeated rows get the same result each; an empty table gives an empty result; the columns added take the
place of columns of the same names, which the caller chooses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_in_slices

UNKNOWN = "und"
BUCKETS, DIMENSIONS, GRAMS = 2**15, 16, (2, 3, 4)
#: The bounds on what training collects: documents of each language, languages, documents, bytes of their texts.
DOCS_PER_LANGUAGE, MAX_LANGUAGES, MAX_DOCS, MAX_BYTES = 300, 500, 20_000, 64 << 20
#: Training runs over segments of this many bytes of the whole texts, at most MAX_SEGMENTS of them in a pass.
SEGMENT, MAX_SEGMENTS, PASSES, RATE = 256, 20_000, 2, 0.5
#: Share of clean documents that may fall under the rejection threshold, and how far under their scores it is put.
REJECTED_SHARE, MARGIN = 0.001, 0.8
MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams; white space of any length is one boundary byte."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1].copy()
            for j in range(1, n):
                h = (h << np.uint32(8)) | raw[j : len(raw) - n + 1 + j]
            h *= np.uint32(MULTIPLIERS[n])
            out.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.uint16))
    return np.concatenate(out) if out else np.empty(0, np.uint16)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        g = grams(text)
        return self.table[g].sum(axis=0, dtype=np.float64) / max(1, len(g)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, whether it is rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Fit on (text, language) rows; one in five is kept out of the descent for calibration."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    languages = sorted({y for _, y in rows})
    k = len(languages)
    if k < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, k), np.float32), np.zeros(k))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept_out, used = order[::5], np.setdiff1d(order, order[::5])
    segments: list[tuple[np.ndarray, int]] = []
    for i in used:
        text, y = rows[i]
        g = grams(text)
        # the n-grams of one length follow those of another, so segments take every so-manieth gram
        parts = max(1, len(text) // SEGMENT)
        segments += [(g[j::parts].copy(), languages.index(y)) for j in range(parts)]
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    counts = np.bincount([y for _, y in segments], minlength=k)
    scale = np.minimum(5.0, len(segments) / np.maximum(1, k * counts))
    step = 0
    total = PASSES * min(len(segments), MAX_SEGMENTS)
    for _ in range(PASSES):
        for s in rng.permutation(len(segments))[:MAX_SEGMENTS]:
            g, y = segments[s]
            if not len(g):
                continue
            rate = RATE * (1 - step / total) * scale[y]
            step += 1
            ids, times = np.unique(g, return_counts=True)
            share = (times / len(g)).astype(np.float32)
            h = share @ embedding[ids]
            z = h @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            # an average over many n-grams hands each a small part; scale it back as for sparse features
            embedding[ids] -= np.outer(rate * np.sqrt(share), back)
    model = LanguageModel(languages, (embedding @ weights).astype(np.float32), bias.astype(np.float64))
    # calibrated on short segments of the rows kept out, where doubt is: whole texts are nearly all certain
    z, y = [], []
    for i in kept_out:
        g = grams(rows[i][0])
        parts = max(1, len(rows[i][0]) // SEGMENT)
        for j in range(min(parts, 20)):
            if len(g[j::parts]):
                z.append(model.table[g[j::parts]].mean(axis=0, dtype=np.float64) + model.bias)
                y.append(languages.index(rows[i][1]))
    z, y = np.array(z), np.array(y)

    def probabilities(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    def loss(temperature: float) -> float:
        return float(-np.log(probabilities(temperature)[np.arange(len(y)), y] + 1e-12).mean())

    model.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
    p = probabilities(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    if len(right):
        model.threshold = float(MARGIN * np.quantile(right, REJECTED_SHARE))
    return model


def training_rows(docs: DataFrame, where: Column, per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MAX_LANGUAGES, most_bytes: int = MAX_BYTES) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: of each language the ``per_language`` distinct texts with the smallest hashes
    (fewer if MAX_DOCS does not reach so far), or all texts if it has no more. Copies count once.

    Each language has an equal part of ``most_bytes``: of the texts so found, those are taken in order of their hashes
    that fit in what is left of it, and the shortest if none does, so no language is lost. More than ``most_languages``
    labels are an error, as a model that leaves some out would never find them.
    """
    labelled = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u"), "text")
    # how many hashes of a language have so many bits: the fewest bits that hold enough hold about twice as many at most
    levels = rows.select("lang", "u").distinct().groupBy("lang", F.length(F.bin("u")).alias("bits")).count()
    levels = levels.limit(64 * (most_languages + 1)).collect()
    languages = sorted({r["lang"] for r in levels})
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages are labelled; raise most_languages, which bounds what training collects")
    if not languages:
        return []
    each = max(1, min(per_language, MAX_DOCS // len(languages)))
    spark = docs.sparkSession
    bounds = []
    for lang in languages:
        held, of = 0, {r["bits"]: r["count"] for r in levels if r["lang"] == lang}
        for bits in sorted(of):
            held += of[bits]
            if held >= each:
                break
        bounds.append((lang, (1 << bits) - 1))
    # one row for each language
    under = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    near = rows.join(under, "lang").filter("u <= bound")
    sizes = near.groupBy("lang", "u").agg(F.min(F.octet_length("text")).alias("size")).collect()
    chosen = []
    for lang in languages:
        first = sorted((r["u"], r["size"]) for r in sizes if r["lang"] == lang)[:each]
        left, own = most_bytes // len(languages), []
        for u, size in first:
            if size <= left:
                own.append((lang, u))
                left -= size
        chosen += own or [(lang, min(first, key=lambda x: (x[1], x[0]))[0])]
    # at most MAX_DOCS rows; many copies of a text come down to one before the shuffle
    wanted = F.broadcast(spark.createDataFrame(chosen, "lang string, u long"))
    drawn = rows.join(wanted, ["lang", "u"], "left_semi").groupBy("lang", "u").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(drawn, key=lambda r: (r["u"], r["lang"]))]


FOUND = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = FOUND) -> DataFrame:
    """All columns of ``docs`` but those of the same names, and the language, its score, and whether it is rejected."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=[*b.schema.names, *names],
            )

    return map_in_slices(docs, run, schema)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 4; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4))
