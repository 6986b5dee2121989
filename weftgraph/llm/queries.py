"""Registered queries: each applies one operator, as it is used, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_main, langid, mixing, passages, secret_scan, simhash, suffix_dedup, topk, vectors
from .common import table


def vocabulary() -> str:
    """Where the public word BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0, seed=17)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.find(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("passages", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select("doc_id", "n_passages", listed.alias("passages"), "n_words", "class_id")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"
    )


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_bpe": op3_bpe,
        "op4_topk": op4_topk,
        "op5_passages": op5_passages,
        "op6_html": op6_html,
        "op7_secrets": op7_secrets,
        "op8_simhash": op8_simhash,
        "op9_langid": op9_langid,
        "op10_vectors": op10_vectors,
    }


_MIXING = """
WITH s AS (SELECT source, sum(CAST(length(coalesce(text, '')) AS DOUBLE)) AS chars FROM documents GROUP BY source),
t AS (SELECT sum(chars) AS c, sum(pow(chars, 0.5)) AS w FROM s),
m AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE pow(chars, 0.5) / w * c / chars END AS mean FROM s, t),
d AS (SELECT source, mean, CAST(greatest(ceil(mean / 8.0), 1) AS INTEGER) AS draws FROM m),
f AS (SELECT source, mean, draws, list_transform(range(0, 64), lambda k: exp(-(mean / draws) + k * ln(mean / draws) - lgamma(k + 1))) AS terms FROM d),
g AS (SELECT source, mean, draws, list_transform(range(1, 65), lambda k: list_sum(terms[1:k])) AS cdf FROM f),
n AS (SELECT x.*, list_sum(list_transform(range(1, draws + 1), lambda i: len(list_filter(cdf, lambda y:
  y <= CAST('0x' || substr(md5('17|' || doc_id || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS k
  FROM documents x JOIN g ON x.source IS NOT DISTINCT FROM g.source),
c AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, CAST(k AS BIGINT) + 1)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('17|' || doc_id || '|' || copy || '|order'), 1, 13) AS BIGINT) AS shuffle_key FROM c
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator."""
    return {"op1_mixing": _MIXING, "op4_topk": _TOPK}
