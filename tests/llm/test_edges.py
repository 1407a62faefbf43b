"""Clashing names, repeated ids, hot keys, targets that can't be met, foreign media and tokenizers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinstrata.llm import langid, minhash, mixing, ogg, packing, secrets, urls, warc
from coinstrata.llm.common import new_path, split_by_keys
from coinstrata.llm.queries import tokenizer_path

NAMES = ["_word", "_bits", "__word", "_mix_source", "_rules", "_doc", "_gone", "_lang", "node", "share"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_columns_with_any_names_stay(spark):
    rows = [(i, f"token = abcdef{i} and then words {i} {i * 7} {i * 13} more {i}", "en", "s", 9) for i in range(6)]
    docs = clashing(spark, [*rows, (9, rows[0][1], "en", "s", 9), (None, None, None, None, None)])
    results = [minhash.drop_near_duplicates(docs), secrets.redact(docs), mixing.mix(docs, budget_share=1.0), split_by_keys(docs, F.col("doc_id"), docs.select("doc_id"))[0]]
    for out, n in zip(results, (7, 8, 8, 8)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == n
        assert all(r[c] == f"own {c}" for r in got for c in NAMES)


def test_repeated_ids_have_all_links_in_any_order(spark):
    a, b, c = ("a b c d e f g h", "q r s t u v w x", "other words that no text here has at all")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c)]
    made = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        made.append(sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()))
        left = sorted(r.doc_id for r in minhash.drop_near_duplicates(docs, 2).collect())
        assert left == [1, 4]
    assert made[0] == made[1] == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)])


def test_hot_keys_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 3)
    monkeypatch.setattr(urls, "BUSY", 3)
    docs = [(i, "one two three four five six seven " + " ".join(f"w{j}" for j in range(i % 3))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    from .test_minhash import brute

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2)
    week = spark.range(60).select(F.col("id").alias("capture_id"), F.concat(F.lit("http://h"), F.col("id") % 5, F.lit(".com/")).alias("url"), (F.lit(1_700_000_000) + F.col("id") * 60 % 120).alias("fetched"))
    lists = spark.createDataFrame([("l", "com", "block", -(10**11)), ("l", "h3.com", "allow", 0)], "list string, pattern string, action string, at long")
    out = urls.judge(week, lists).collect()
    assert len(out) == 60 and all(r.blocked == (not r.url.startswith("http://h3")) and r.n_active == (2 if "h3" in r.url else 1) for r in out)


def test_targets_that_cannot_be_met_raise(spark):
    docs = spark.createDataFrame([(i, "x" * 40, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(10)], "doc_id long, text string, lang string, source string")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, target double")
    goals = {"source": share(a=0.9, b=0.1), "lang": share(en=0.1, de=0.9)}
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(docs, goals)
    assert mixing.mix(docs, goals, accept=1.0).columns == docs.columns
    drawn = mixing.mix(docs, {"topic": share(x=1.0)}, budget_share=1.0, topic=F.when(F.col("doc_id") < 4, "x").otherwise("y"), tokens=F.lit(5))
    assert {r.doc_id for r in drawn.collect()} == {0, 1, 2, 3}


def test_a_page_of_several_packets_made_by_hand():
    head = ogg.IDENT.pack(ogg.MAGIC, 100, 0, 1, 128)
    media = ogg.page(7, 0, 0, ogg.FIRST, bytes([len(head)]), head) + ogg.page(7, 1, 128, ogg.LAST, bytes([64, 64]), bytes(range(128)))
    d = ogg.decode(media)
    assert d.payload == bytes(range(128)) and d.packets == 2 and d.starts == {7: [0.0, 0.64]}
    # pages of the encoder hold several packets, and packets go on over pages
    made = ogg.encode(bytes(i % 251 for i in range(50_000)))
    flags = [made[i + 5] for i in range(len(made) - 5) if made[i : i + 4] == b"OggS"]
    assert any(f & ogg.CONTINUED for f in flags) and ogg.decode(made).packets > len(flags)


def test_other_tokenizers_are_not_taken_for_the_known_one():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Hello World  it's", "a\tb\n\nC", "ÉTÉ 12"]
    expected = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    ids = packing.WordIds(path)
    assert [np.frombuffer(ids.ids(t.encode()), "<u4").tolist() for t in texts] == expected
    assert packing.WordIds(tokenizer_path()).known and not ids.known


def test_outlying_ids_do_not_fill_one_shard(spark):
    pages = spark.range(2000).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("x" * 900), "id").alias("html"))
    path = new_path(spark, "warc-outlier")
    warc.write_archive(pages, path, shard_bytes=100_000, file_bytes=1 << 20)
    shards = [r["n"] for r in warc.read_manifest(spark, path).groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(shards) == 2000 and len(shards) > 20 and max(shards) <= 2 * 2000 / len(shards)
    assert warc.read_archive(spark, path).count() == 2000


def test_training_keeps_every_language_and_bounds_bytes(spark):
    rows = [("aa", "x" * 5000 + str(i)) for i in range(50)] + [("bb", "y" * 100 + str(i)) for i in range(50)] + [("cc", "z" * 90_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = langid.training_rows(docs, F.lit(True), 30, most_bytes=60_000)
    assert {y for _, y in got} == {"aa", "bb", "cc"} and sum(len(t) for t, y in got if y == "aa") <= 20_000
    with pytest.raises(ValueError, match="languages"):
        langid.training_rows(docs, F.lit(True), most_languages=2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert langid.identify(empty, langid.train([])).count() == 0


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
