"""From documents to packed training sequences: five stages, each of them one operator of ``coinstrata.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinstrata.llm import langid, minhash, mixing, packing, secrets
from coinstrata.llm.common import free_name, saved, table
from coinstrata.llm.queries import configure, tokenizer_path

#: Share of its input's tokens that the mixing stage draws.
MIXED_SHARE = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes the language found."""
    configure(spark)
    model = langid.train(langid.training_rows(docs, F.lit(True)))
    names = tuple(free_name(n, docs) for n in ("_lang", "_score", "_rejected"))
    found = langid.identify(docs, model, names).filter(~F.col(names[2]))
    return found.withColumn("lang", F.col(names[0])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    return minhash.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds."""
    configure(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and forms have tempered token weights."""
    return mixing.mix(docs, budget_share=MIXED_SHARE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    configure(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID and MinHash cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
