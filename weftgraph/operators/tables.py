"""Operations on whole tables: scans, upserts, schema changes, samples and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(
    df: DataFrame, columns: list[str] | dict[str, str] | None = None, where: str | None = None, order_by: list[tuple[str, bool, bool]] | None = None,
    limit: int | None = None, offset: int = 0, with_row_id: bool = False,
) -> DataFrame:
    """Filter, order, slice, project - in this order.

    ``columns``: names, or new names with SQL expressions. ``order_by``: (column,
    ascending, nulls first). ``with_row_id`` adds ``_rowid``, unique but not dense.
    """
    rows = df.withColumn("_rowid", F.monotonically_increasing_id()) if with_row_id else df
    if where:
        rows = rows.where(where)
    if order_by:
        def key(c, up, first):
            c = F.col(c)
            return (c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last())

        rows = rows.orderBy(*[key(*o) for o in order_by])
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    if columns is None:
        return rows
    extra = [F.col("_rowid")] if with_row_id else []
    if isinstance(columns, dict):
        return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()], *extra)
    return rows.select(*columns, *extra)


def merge_insert(
    target: DataFrame, source: DataFrame, on: list[str], when_matched: str = "update_all", update_if: str | None = None,
    when_not_matched: str = "insert_all", not_matched_by_source: str = "keep", delete_if: str | None = None,
) -> DataFrame:
    """The target after an upsert by key.

    ``when_matched``: update_all, do_nothing, or update_if (a condition over
    ``target.x`` and ``source.x``). ``when_not_matched``: insert_all or do_nothing.
    ``not_matched_by_source``: keep, delete, or delete_if (a condition on the target).
    Null keys match nothing; several source rows of one key are an error. One full
    outer join on the keys.
    """
    twice = source.groupBy(*on).count().where("count > 1").where(" and ".join(f"`{k}` is not null" for k in on))
    if not twice.isEmpty():
        raise ValueError("several source rows have one key")
    t = target.select(F.struct(*target.columns).alias("target"), *[F.col(k).alias(f"t_{k}") for k in on])
    s = source.select(F.struct(*source.columns).alias("source"), *[F.col(k).alias(f"s_{k}") for k in on])
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"t_{k}") == F.col(f"s_{k}"))
    both = t.join(s, cond, "full_outer")
    in_t, in_s = F.col("target").isNotNull(), F.col("source").isNotNull()
    if when_matched == "update_all":
        take = in_t & in_s
    elif when_matched == "do_nothing":
        take = F.lit(False)
    else:
        take = in_t & in_s & F.coalesce(F.expr(update_if), F.lit(False))
    keep = in_t & in_s
    if when_not_matched == "insert_all":
        keep = keep | (~in_t & in_s)
    alone = in_t & ~in_s
    if not_matched_by_source == "keep":
        keep = keep | alone
    elif not_matched_by_source == "delete_if":
        keep = keep | (alone & ~F.coalesce(F.expr(_prefixed(delete_if, target.columns)), F.lit(False)))
    new = take | ~in_t
    cols = []
    for c in target.columns:
        fresh = F.col(f"source.{c}").cast(target.schema[c].dataType) if c in source.columns else F.when(in_t, F.col(f"target.{c}"))
        cols.append(F.when(new, fresh).otherwise(F.col(f"target.{c}")).alias(c))
    return both.where(keep).select(*cols)


def _prefixed(condition: str, columns: list[str]) -> str:
    import re

    return re.sub(r"\b(" + "|".join(map(re.escape, columns)) + r")\b(?!\s*\()", r"target.\1", re.sub(r"\btarget\.", "", condition))


def merge_columns(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Add the right's columns by key; rows without a partner get nulls."""
    r = right.withColumnRenamed(right_on or left_on, "@on")
    return left.join(r, F.col(left_on) == F.col("@on"), "left").drop("@on")


def add_columns(df: DataFrame, new: dict[str, str] | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SQL expressions by name, or a function of batches (an iterator of pandas frames), whose columns are added."""
    if callable(new):
        return new(df)
    return df.select("*", *[F.expr(e).alias(n) for n, e in new.items()])


def alter_columns(df: DataFrame, *changes: dict) -> DataFrame:
    """Each change has ``path`` and may have ``name`` (rename) and ``data_type`` (cast)."""
    for c in changes:
        if "data_type" in c:
            df = df.withColumn(c["path"], F.col(c["path"]).cast(c["data_type"]))
        if "name" in c:
            df = df.withColumnRenamed(c["path"], c["name"])
    return df


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def take(df: DataFrame, positions: list[int], order: list[str]) -> DataFrame:
    """Rows at positions (from 0) of the given order.

    Ranks come from per-partition counts after a range partitioning, so no single
    task sees all rows.
    """
    rows = numbered(df, order)
    wanted = df.sparkSession.createDataFrame([(p,) for p in positions], "_position long")
    return rows.join(F.broadcast(wanted), "_position").drop("_position")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_position``, its place in the order (ties in any order)."""
    from ..sources.durable import cut

    parts, _ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("@part", F.spark_partition_id()))
    counts = parts.groupBy("@part").agg(F.count(F.lit(1)).alias("@n"))
    before = counts.select("@part", (F.sum("@n").over(Window.orderBy("@part")) - F.col("@n")).alias("@before"))
    w = Window.partitionBy("@part").orderBy(*order)
    ranked = parts.withColumn("@rank", F.row_number().over(w))
    return ranked.join(F.broadcast(before), "@part").withColumn("_position", F.col("@before") + F.col("@rank") - 1).drop("@part", "@rank", "@before")


def shard(df: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """The rows of one of ``count`` shards, by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def reservoir(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A uniform sample of exactly n rows (all, if fewer): those with the least hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def statistics(df: DataFrame) -> DataFrame:
    """For each column: nulls, distinct values (approximate), least and greatest as text, bytes as text."""
    aggs = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        simple = df.schema[c].dataType.typeName() not in ("array", "map", "struct", "variant", "binary")
        text = x.cast("string") if simple else F.to_json(F.struct(x))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.sum(x.isNull().cast("long")).alias("nulls"),
                (F.approx_count_distinct(x) if simple else F.approx_count_distinct(text)).alias("distinct"),
                (F.min(x).cast("string") if simple else F.lit(None).cast("string")).alias("min"),
                (F.max(x).cast("string") if simple else F.lit(None).cast("string")).alias("max"),
                F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("x")).select("x.*")


def has_all(column: str, labels: list[str]) -> Column:
    return F.size(F.array_intersect(F.col(column), F.array(*map(F.lit, labels)))) == len(set(labels))


def has_any(column: str, labels: list[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, labels)))
