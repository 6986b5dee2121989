"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Mean up to which one inverted Poisson draw is used; larger means are sums of such draws.
CHUNK = 8.0
_TERMS = 64
#: Sources up to which their table of rates is broadcast (64 numbers each); beyond it the join shuffles.
BROADCAST_SOURCES = 20_000


def uniform(*parts):
    """A number in [0, 1) from the md5 of the parts, the same on every engine."""
    return hashed(*parts) / F.lit(2.0**52)


def hashed(*parts):
    """52 bits of the md5 of the parts as a long."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """For each source its mean repetition and the Poisson distribution function of one draw.

    With ``weights`` a source gets that share of the characters put out (0 where it
    is not named); else its share is in proportion to its characters to the power
    ``alpha``. A source without characters keeps the mean ``epochs``.
    """
    by_source = docs.select(F.col(source).alias("_source"), F.col(text).alias("_text")).groupBy("_source").agg(
        F.sum(F.length(F.coalesce(F.col("_text"), F.lit(""))).cast("double")).alias("chars")
    )
    by_source, _ = cut(by_source)
    if weights is None:
        share = F.pow("chars", F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(share)
    by_source = by_source.withColumn("share", share)
    total = by_source.agg(F.sum("chars").alias("chars"), F.sum("share").alias("share")).first()
    chars, shares = total["chars"] or 0.0, total["share"] or 0.0
    mean = F.when(F.col("chars") == 0, F.lit(float(epochs))).otherwise(
        F.col("share") / F.lit(shares or 1.0) * F.lit(chars * epochs) / F.col("chars")
    )
    out = by_source.withColumn("mean", mean).withColumn("draws", F.greatest(F.ceil(F.col("mean") / CHUNK), F.lit(1)).cast("int"))
    one = F.col("mean") / F.col("draws")
    terms = [F.exp(-one + F.lit(float(k)) * F.ln(one) - F.lit(math.lgamma(k + 1))) for k in range(_TERMS)]
    out = out.withColumn("terms", F.when(F.col("mean") > 0, F.array(*terms)))
    cdf = F.transform(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        lambda k: F.aggregate(F.slice("terms", F.lit(1), k), F.lit(0.0), lambda a, x: a + x),
    )
    return out.select("_source", "mean", "draws", F.when(F.col("mean") > 0, cdf).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Repeat each document by a Poisson count and shuffle all of them.

    The count is the inverted Poisson distribution, with the mean of the document's
    source, at a uniform number hashed from seed and key: rows with one key get one
    count wherever they are, and a rerun gives the same rows. Adds ``copy`` (from 1)
    and ``shuffle_key``; every partition holds a random share of the rows in random
    order. A null source is a source; a null key draws as the text 'null'; columns
    named as the new ones are replaced, all others pass through, whatever their names;
    repeated rows are drawn alike; an empty table gives none.

    Documents are never grouped by source: the rates come from a partial aggregation
    and are joined to the rows, by broadcast while the sources number at most
    ``BROADCAST_SOURCES`` and else by a join that adaptive execution may split.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    table, _ = cut(rates(docs, source, text, weights, alpha, epochs))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(source).alias("_of"), F.col(key).alias("_key"))
    rows = rows.join(table, F.col("_of").eqNullSafe(F.col("_source")), "inner")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")),
        F.lit(0),
        lambda n, d: n + F.size(F.filter("cdf", lambda x: x <= uniform(F.lit(seed), F.col("_key"), d))),
    )
    rows = rows.withColumn("_n", F.when(F.col("mean") > 0, count).otherwise(0)).where("_n > 0")
    rows = rows.select("_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    rows = rows.select(*[F.col("_row")[c].alias(c) for c in names], "copy", hashed(F.lit(seed), F.col("_key"), F.col("copy"), F.lit("order")).alias("shuffle_key"))
    return rows.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "copy")
