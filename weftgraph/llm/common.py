"""Helpers that the operators share: durable cuts of lineage and streamed groups."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names; only where that is unset
    (tests on one machine) a folder beside the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    return named.rstrip("/")


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back.

    Returns the table and its path. A lost executor costs nothing afterwards, as
    the rows no longer depend on shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`cut` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions_for(df: DataFrame) -> int:
    """How many shuffle partitions the session uses."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_array(batch, name: str) -> np.ndarray:
    """A column of an Arrow batch as a numpy array (objects for binary)."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.to_numpy(zero_copy_only=False)


def groups(batches: Iterator, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Yield ``(key, {column: array})`` for each run of equal keys in sorted batches.

    Only one group is held at a time beside the batch it came in.
    """
    held: dict[str, list] | None = None
    held_key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ks = [column_array(batch, k) for k in keys]
        cs = {c: column_array(batch, c) for c in columns}
        change = np.zeros(n, dtype=bool)
        for k in ks:
            change[1:] |= k[1:] != k[:-1]
        starts = np.concatenate(([0], np.nonzero(change)[0], [n]))
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(k[a] for k in ks)
            if held_key is not None and key == held_key:
                for c in columns:
                    held[c].append(cs[c][a:b])
            else:
                if held_key is not None:
                    yield held_key, {c: v[0] if len(v) == 1 else np.concatenate(v) for c, v in held.items()}
                held_key, held = key, {c: [cs[c][a:b]] for c in columns}
    if held_key is not None:
        yield held_key, {c: v[0] if len(v) == 1 else np.concatenate(v) for c, v in held.items()}


def hot_groups(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Keys and number of rows (``_rows``) of the groups over ``cap`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > cap)


def split_hot(df: DataFrame, keys: list[str], salt, cap: int, large: DataFrame | None = None) -> DataFrame:
    """Deal groups over ``cap`` rows out as pairs of blocks.

    Adds ``_b0`` and ``_b1``: a group within the cap gets (0, 0); a larger one is
    cut into ``ceil(rows / cap)`` blocks by ``salt`` and each row is sent to every
    pair that its block takes part in, so any two rows of the group still meet
    in exactly one task-sized group unless they share a block, where they meet
    in the pair of that block with itself (and in the others too).
    ``_own`` is true in the block's pair with itself. ``large`` may give the groups
    over the cap (the keys and ``_rows``) where they are known already.
    """
    if large is None:
        large = hot_groups(df, keys, cap)
    out = df.join(large, keys, "left")
    n = F.ceil(F.coalesce(F.col("_rows"), F.lit(1)) / cap).cast("int")
    out = out.withColumn("_n", n).withColumn("_b", F.pmod(salt, F.col("_n")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return (
        out.withColumn("_b0", F.least("_b", "_o"))
        .withColumn("_b1", F.greatest("_b", "_o"))
        .drop("_rows", "_n", "_o")
    )
