"""Training rows of language identification: every language has its share, however often its texts are copied."""

from pyspark.sql import functions as F

from coinstrata.llm import langid


def test_copies_do_not_thin_a_language(spark):
    copied = spark.range(3 * 200).select(F.lit("aa").alias("lang"), F.concat(F.lit("copied "), F.col("id") % 3).alias("text"))
    half = spark.range(1000).select(F.lit("bb").alias("lang"), F.lit("the one text").alias("text"))
    half = half.unionByName(spark.range(40).select(F.lit("bb").alias("lang"), F.concat(F.lit("other "), "id").alias("text")))
    plain = spark.range(500).select(F.lit("cc").alias("lang"), F.concat(F.lit("plain "), "id").alias("text"))
    nothing = spark.createDataFrame([("dd", None), (None, "no label")], "lang string, text string")
    docs = copied.unionByName(half).unionByName(plain).unionByName(nothing).repartition(5)
    got = langid.training_rows(docs, F.lit(True), 30)
    assert len(set(got)) == len(got)
    assert {y: sum(x == y for _, x in got) for y in ("aa", "bb", "cc")} == {"aa": 3, "bb": 30, "cc": 30} and len(got) == 63
    assert langid.training_rows(docs.repartition(2), F.lit(True), 30) == got
    hashes = {r.text: r.u for r in docs.filter("lang = 'cc'").select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u")).collect()}
    assert {t for t, y in got if y == "cc"} == set(sorted(hashes, key=hashes.get)[:30])
