import random

import numpy as np
import pytest

from coinstrata.llm import minhash
from coinstrata.llm.graph import components

DOCS = "doc_id long, text string, node string"


def words_of(text):
    return (text or "").encode().lower().split()


def set_of(text, n):
    w = words_of(text)
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(data, n, percent=80):
    """component and set size of each document by all pairs."""
    sets = {i: set_of(t, n) for i, t in data}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in base.split())


def corpus(seed, groups=6, copies=25):
    rng = random.Random(seed)
    data = []
    for _ in range(groups):
        base = " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150])))
        data += [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1])) for _ in range(copies)]
    data += ["", "  ", "one", "ONE", "one two", "One  Two\n", "Ünï Two", "ünï two", "x " * 3000, None]
    return list(enumerate(data))


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    data = corpus(words)
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "n") for i, t in data], DOCS), words).collect()
    expected = brute(data, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_is_one_component_though_its_ends_differ(spark):
    base = [f"a{i}" for i in range(100)]
    data = [(k, " ".join([f"b{i}" for i in range(6 * k)] + base[6 * k :])) for k in range(6)]
    data = [(10 - k, t) for k, t in data]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in data], DOCS), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(data, 2).items()}


def test_blocks_find_what_hubs_leave(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    data = corpus(11, groups=3, copies=30)
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in data], DOCS), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(data, 2)


def test_pairs_that_met_their_hub_are_not_compared_again(spark, monkeypatch):
    """Pairs that share buckets with nobody else and are too far apart for a link: one comparison settles them."""
    compared = []

    def confirm(pairs, *rest, was=minhash._confirm):
        compared.append(pairs.count())
        return was(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirm", confirm)
    monkeypatch.setattr(minhash, "_across", lambda *a: pytest.fail("what was compared already is compared in full"))
    rng = random.Random(3)
    texts = []
    for k in range(40):
        own = [f"p{k}w{i}" for i in range(100)]
        texts += [" ".join(own), " ".join(own[:84] + [f"q{k}w{rng.random()}" for _ in range(16)])]
    data = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in data], DOCS), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(data, 2) == {i: (99, i) for i, _ in data}
    assert len(compared) == 1 and 30 <= compared[0] <= 40


def test_nodes_that_lost_their_hub_still_meet(spark):
    """One bucket whose links are all between nodes that the first hubs are not linked with."""
    core = [f"c{i}" for i in range(70)]
    data = [(i, " ".join(core + [f"own{100 + i // 2 if i > 11 else i}x{j}" for j in range(30 if i <= 11 else 28)] + [f"end{i}"])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in data], DOCS), 2).collect()}
    assert got == brute(data, 2) and len({c for _, c in got.values()}) == 26


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f", "n"), (1, "a b c d e f", "n"), (None, "a b c d e f", "n"), (2, None, "n")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), 2).count() == 0


def test_drop_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (None, "zz", "z"), (5, "other words entirely here", "w")]
    out = minhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS), 5)
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "5", "None"]


def test_estimate_is_corrected_for_chance(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    a, b = minhash._functions()
    rows = []
    for share in (0.0, 0.5, 0.9):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 2**63, (1000 - len(common)) // 2, dtype=np.uint64)])) for _ in range(2)]
        rows.append((share, *(minhash.pack_bits(minhash.minima(x, a, b)).tolist() for x in own)))
    df = spark.createDataFrame(rows, "share double, s array<long>, t array<long>")
    for r in df.select("share", minhash.estimate(F.col("s"), F.col("t")).alias("e")).collect():
        assert abs(r.e - r.share) < 0.2


def test_graph_components(spark):
    edges = [(1, 2), (3, 2), (4, 3), (9, 8), (8, 9), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(31)}
