"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count, sum and exclusive or of the rows' hashes; the sum is a decimal, so no number of rows overflows it."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return row["n"], row["s"], row["x"]


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Label every vertex of ``edges`` (``a``, ``b``, both long) with the least one it reaches.

    Returns ``id``, ``root`` for the vertices that occur in an edge; others are
    their own roots. Loops and repeated edges are ignored. Every round is two
    star operations (group minima, never a whole neighbourhood in one task) and
    one written table, so the lineage stays short and a lost executor costs one
    round at most. An edge list without rows gives no rows.
    """
    spark = edges.sparkSession
    now, path = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _digest(now)
    for _ in range(most):
        if not seen[0]:
            break
        new, new_path = cut(_small(_large(now)))
        digest = _digest(new)
        forget(spark, path)
        now, path = new, new_path
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("id"), F.col("b").alias("root"))
    )
