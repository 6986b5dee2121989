"""From raw documents to token ids: five stages, each one operator of weftgraph.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, langid, mixing, secret_scan, simhash
from weftgraph.llm.common import cut, table
from weftgraph.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or alike to two languages, go."""
    model = langid.learn(docs)
    found = langid.identify(docs, model)
    return found.where("lang_pred <> 'und' and score > 0.01").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and the length set anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to bring the sources to their weights, in random order."""
    return mixing.mix(docs, alpha=0.5, epochs=1.0, seed=17).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, vocabulary()).select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", near_dedup),
    ("secret_scan", scan_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: No SQL: fingerprint components and tokens can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
