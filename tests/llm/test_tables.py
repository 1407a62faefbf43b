"""Mixing, URL lists, WARC and the pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.fs
import pytest

from coinstrata.llm import mixing, urls, warc
from coinstrata.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, prob string"


def documents(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, "x" * rng.choice([50, 900, 3000]), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 6 + ["a", "b", None]), "p") for i in range(n)]


def fitted(cells, targets, rounds=200):
    w = dict(cells)
    for _ in range(rounds):
        for d, t in enumerate(targets):
            sums = Counter()
            for k, v in w.items():
                sums[k[d]] += v
            total = sum(t[x] for x in sums)
            w = {k: v * t[k[d]] / total / sums[k[d]] for k, v in w.items()}
    return w


def test_raked_weights_equal_a_plain_fit(spark):
    docs = documents()
    df = spark.createDataFrame(docs, DOCS)
    topic = lambda t: "note" if len(t) < 400 else "short" if len(t) < 2000 else "article"
    cells = Counter()
    for _, t, lang, source, _ in docs:
        cells[(source or "", lang or "", topic(t))] += max(1, -(-len(t) // 4))
    targets = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = Counter()
        for k, v in cells.items():
            sums[k[d]] += v
        targets.append({k: v ** mixing.TEMPER[name] for k, v in sums.items()})
    expected = fitted(cells, targets)
    got = {(r.source, r.lang, r.topic): r for r in mixing.probabilities(df, budget_share=0.4).collect()}
    assert got.keys() == expected.keys()
    for k, r in got.items():
        assert r.weight == pytest.approx(expected[k], rel=1e-6)
    assert sum(r.prob * r.tokens for r in got.values()) == pytest.approx(0.4 * sum(cells.values()), rel=1e-6)
    assert all(0 <= r.prob <= 1 for r in got.values())


def test_mix_draws_by_probability_and_keeps_columns(spark):
    df = spark.createDataFrame(documents(3000, 2), DOCS)
    out = mixing.mix(df, budget_share=0.5)
    assert out.columns == df.columns
    drawn = {r.doc_id for r in out.collect()}
    assert drawn == {r.doc_id for r in mixing.mix(df, budget_share=0.5).collect()}
    share = sum(max(1, len(t) // 4) for i, t, *_ in documents(3000, 2) if i in drawn) / sum(max(1, len(t) // 4) for _, t, *_ in documents(3000, 2))
    assert 0.45 < share < 0.55


def test_mix_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0
    same = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "a" * 100, "en", "s", "q")] * 2, DOCS)
    assert mixing.mix(same, budget_share=1.0).count() == 5


def test_targets_for_absent_values_are_ignored(spark):
    df = spark.createDataFrame(documents(), DOCS)
    goal = spark.createDataFrame([("hot", 1.0), ("a", 3.0), ("nowhere", 5.0)], "value string, target double")
    got = mixing.probabilities(df, {"source": goal}).collect()
    total = defaultdict(float)
    for r in got:
        total[r.source] += r.weight
    assert total["a"] == pytest.approx(0.75) and total["hot"] == pytest.approx(0.25) and total["b"] == total[""] == 0


ENTRIES = [("l", "example.org", "block", 100), ("l", "example.org", "remove", 200), ("l", "a.example.org", "allow", 150), ("m", "a.example.org/x", "block", 160), ("m", "TLD", "block", 0), (None, None, "block", 5), ("m", "q.com", "block", 300), ("m", "q.com", "allow", 300)]


def slow_judge(url, at, entries):
    from urllib.parse import urlsplit

    if url is None or at is None:
        return None, False
    p = urlsplit(url)
    host = (p.hostname or "").lower()
    labels, steps = host.split("."), p.path.lower()[1:].split("/") if p.path else []
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {f"{host}/{'/'.join(steps[:i])}" for i in range(1, len(steps) + 1)}
    best = None
    for name in {(e[0], e[1].lower()) for e in entries if e[1]}:
        seen = [e for e in entries if e[1] and (e[0], e[1].lower()) == name and e[3] <= at]
        if name[1] in keys and seen:
            last = max(seen, key=lambda e: (e[3], {"block": 2, "allow": 1}.get(e[2], 0)))[2]
            if last != "remove":
                best = max([b for b in (best, (len(name[1]), last == "block", *name)) if b])
    return best and f"{best[2]}:{best[3]}", bool(best and best[1])


def test_captures_are_judged_as_of_their_time(spark):
    links = ["http://example.org/", "https://A.Example.org/x/y?q=1#f", "http://a.example.org/xy", "http://b.tld", "ftp://user:pw@q.com:8/z", "nonsense", None, "http://other.net/a/b/"]
    data = [(i, u, t, "x") for i, (u, t) in enumerate((u, t) for u in links for t in (None, 50, 100, 155, 165, 199, 200, 300, 10**9))] * 2
    caps = spark.createDataFrame(data, "capture_id long, url string, fetched long, host string")
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, at long")
    for period in (30, urls.PERIOD):
        out = urls.judge(caps, entries, period).collect()
        assert len(out) == len(data)
        for r in out:
            assert (r.decided_by, r.blocked) == slow_judge(r.url, r.fetched, ENTRIES), (r.url, r.fetched)
    assert urls.judge(caps.limit(0), entries).count() == 0
    assert not any(r.blocked for r in urls.judge(caps, entries.limit(0)).collect())
    assert urls.allowed(caps, entries).count() == sum(not slow_judge(u, t, ENTRIES)[1] for _, u, t, _ in data)


PAGES = "page_id long, url string, html string, shard string"


def page_rows():
    rng = random.Random(9)
    texts = ["", "same", "<p>é</p>" * 50, "a" * 300_000]
    rows = [(i, f"http://h{i % 5}.example/{i} x", rng.choice([*texts, f"page {i}", None]), "z") for i in range(200)]
    return [*rows, (None, None, "no id", "z"), (7, "http://h/7", "other", "z")]


def test_archive_round_trip(spark):
    rows = page_rows()
    path = new_path(spark, "warc-test")
    manifest = warc.write_archive(spark.createDataFrame(rows, PAGES), path, shard_bytes=200_000, file_bytes=30_000)
    assert manifest.count() > 3 and sum(r.records for r in manifest.collect()) == len(rows)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in warc.read_archive(spark, path).collect())
    first, expected = {}, Counter()
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        refers = first[html or ""] if i is not None and first[html or ""] < i else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[(i, "response" if refers is None else "revisit", refers, len(raw), digest, raw if refers is None else None)] += 1
    assert {(*k[:5], k[5] or None) for k in got} == {(*k[:5], k[5] or None) for k in expected} and got.total() == expected.total()


def test_archive_is_the_same_bytes_again(spark):
    made = []
    for parts in (1, 5):
        path = new_path(spark, "warc-test")
        warc.write_archive(spark.createDataFrame(page_rows(), PAGES).repartition(parts), path, shard_bytes=200_000, file_bytes=30_000)
        made.append(sorted((r.file, r.sha256) for r in warc.read_manifest(spark, path).collect()))
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        names = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root))}
        assert names == {x[0] for x in made[-1]} | {"manifest"}
    assert made[0] == made[1]


def test_empty_archive(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_can_stay_whole(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")]
    got = sorted((r.page_id, r.record_type) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES), least_bytes=3).collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(3)
    names = {"en": "the of and to in that was with", "de": "der die und den von mit ist nicht"}
    docs = []
    for i in range(80):
        y = rng.choice(list(names))
        docs.append((i, " ".join(rng.choice(names[y].split()) + str(rng.randrange(30)) for _ in range(80)), y, f"s{i % 3}"))
    docs += [(80, docs[3][1], "en", "s1"), (81, docs[4][1] + " end", "de", "s1"), (82, "12 34", "en", "s0"), (83, None, None, None), (84, docs[5][1] + " token = abcdef12", "en", "s2")]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        seen[name] = df.collect()
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen["language_id"]} == set(range(85)) - {82, 83}
    assert {r.doc_id for r in seen["near_dedup"]} == set(range(80))
    assert len(seen["secret_scan"]) == len(seen["near_dedup"])
    assert {r.doc_id for r in seen["mixing"]} == {r.doc_id for r in seen["packing"]}
