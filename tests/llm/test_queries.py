"""Every opN query that has no SQL, over its whole test table, against its contract computed plainly."""

import base64
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from coinstrata.llm import queries

from .test_minhash import brute
from .test_packing import whole
from .test_texts import base_spans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op2(spark, docs):
    got = defaultdict(list)
    places = defaultdict(list)
    for r in result(spark, "op2_packing"):
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for key, ids in zip(docs, whole([d.text or "" for d in docs.values()])):
        ids = np.array([*ids, 0], "<u4")
        cut = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        assert sorted(got[key]) == [(k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(cut)]
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(n for p in places.values() for _, n in p)
    assert len(got) == len(docs) and len(places) <= -(-total // 2048) + 1


def test_op4(spark, docs):
    order = sorted(docs.values(), key=lambda d: -d.doc_id)
    out = {r.doc_id: r for r in result(spark, "op4_fingerprints")}
    assert out.keys() == docs.keys()
    by_text = {}
    for d, following in zip(order, [*order[1:], order[0]]):
        text, r = d.text or "", out[d.doc_id]
        new = text[: len(text) - len(text) // 3] + (following.text or "")[: len(text) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(new.encode()))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_op6(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html or ""] = min(p.page_id, first.get(p.html or "", p.page_id))
    expected = []
    for p in pages:
        raw, refers = (p.html or "").encode(), first[p.html or ""]
        same = refers == p.page_id
        expected.append((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else refers))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in result(spark, "op6_warc")]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_op7(spark, docs):
    out = {r.doc_id: r for r in result(spark, "op7_ogg")}
    assert out.keys() == docs.keys()
    for key, d in docs.items():
        raw, r = (d.text or "").encode(), out[key]
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-64:]))
        assert r.media_bytes > len(full)


def test_op8(spark, docs):
    out = {r.doc_id: r for r in result(spark, "op8_secrets")}
    assert out.keys() == docs.keys()
    for key, d in docs.items():
        spans, r = base_spans(d.text or ""), out[key]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        joined = [":".join(map(str, s)) for s in spans]
        assert r.base_sha256 == sha(",".join(joined).encode()) and set(joined) <= {*r.spans.split(","), ""}


def test_op9(spark, docs):
    out = {r.doc_id: r for r in result(spark, "op9_language")}
    assert out.keys() == docs.keys()
    right = seen = 0
    for key, d in docs.items():
        r = out[key]
        assert r.held_out == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = d.text is not None and any(map(str.isalpha, d.text))
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and d.lang:
            seen, right = seen + 1, right + (r.lang_pred == d.lang)
    assert seen > 20 and right >= 0.95 * seen


def test_op10(spark, docs):
    expected = brute([(k, d.text) for k, d in docs.items()], queries.NEAR_DUPLICATE_WORDS, queries.NEAR_DUPLICATE_PERCENT)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op10_minhash")}
    assert got == expected
