import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coinstrata.llm import packing
from coinstrata.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, sequence_id string"


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


LETTERS = ["'s", "'", "S", "It's", "don'T", " ", "\n", "\t", "_", "a_b", "12", "²", "½", "é", "É", "ß", "İ", "ſ", "Σ", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "...", "好", "é", "ª", "µ", "\x1c", "\x00", "😀", "'LL", "word"]


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids = packing.WordIds(tokenizer_path())
    assert [np.frombuffer(ids.ids(t.encode()), "<u4").tolist() for t in texts] == whole(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_places_without_overlap(lengths):
    bins, at, fill = packing.best_fit(np.array(lengths, np.int64), 50)
    used = defaultdict(list)
    for b, a, n in zip(bins, at, lengths):
        used[b].append((a, a + n))
    for b, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == fill[b] <= 50
    # any two bins together hold more than one, or they had been one
    assert sum(2 * f <= 50 for f in fill) <= 1


def test_best_fit_takes_the_fullest_bin():
    bins, _, _ = packing.best_fit(np.array([60, 70, 30, 35]), 100)
    assert bins.tolist() == [0, 1, 1, 0]


@pytest.mark.parametrize("per_task", [100_000, 7])
def test_whole_contract_and_rounds(spark, per_task):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma's", "été"]) for _ in range(rng.choice([0, 3, 40, 200, 1500]))), "x") for i in range(60)]
    data += [(60, None, None), (61, "", None), (62, "word " * 5000, None), (5, "again", None), (None, "no id", None), (None, "no id", None)]
    got = packing.pack_documents(spark.createDataFrame(data, DOCS), tokenizer_path(), items_per_task=per_task).collect()
    ids = defaultdict(list)
    for key, e in zip([d[0] for d in data], whole([d[1] or "" for d in data])):
        e = np.array([*e, 0], "<u4")
        for k, s in enumerate(range(0, len(e), 2048)):
            ids[key].append((k, s, len(e[s : s + 2048]), zlib.crc32(e[s : s + 2048].tobytes())))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in ids.items()}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        at = 0
        for offset, n in p:
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + (2 if per_task > 100 else 6)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two", ""), (2, "three", "")], DOCS)
    pieces = packing.tokenise(docs, tokenizer_path())
    packed = packing.pack(pieces.drop("ids"), "length")
    out = packing.sequences(pieces, packed).collect()
    assert len(out) == 1 and sorted(out[0].ids) == sorted([x for e in whole(["one two", "three"]) for x in [*e, 0]])


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
