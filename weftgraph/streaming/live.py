"""Graph views kept current from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import live
from ..sources.snapshot import VersionedTable


class SequenceConflict(ValueError):
    """An append that expected another last sequence."""


class AppendLog:
    """A log with dense sequences from 1; appends may say what they expect to be last."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.table, self.schema = spark, VersionedTable(spark, path), schema

    def last_seq(self) -> int:
        if not self.table.versions():
            return 0
        return self.table.read().agg(F.max("seq")).first()[0] or 0

    def append(self, rows: DataFrame, order: list[str], expected_last_seq: int | None = None) -> int:
        from ..operators.tables import numbered

        last = self.last_seq()
        if expected_last_seq is not None and expected_last_seq != last:
            raise SequenceConflict(f"expected {expected_last_seq}, the last is {last}")
        self.table.write(numbered(rows, order).withColumn("seq", F.col("_position") + last + 1).drop("_position"))
        return self.last_seq()

    def read_from(self, seq: int) -> DataFrame:
        return self.table.read().where(F.col("seq") >= seq).orderBy("seq")


def live_view(spark: SparkSession, log_path: str, schema: str, keys: list[str], view: VersionedTable, checkpoint: str, files_per_batch: int = 1000):
    """Start a query that folds new log files into a versioned view of the last row of each key.

    Tombstones stay in the view until it is compacted, so that a late older put does
    not bring a deleted row back; a batch that is run again gives the same view.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)

    def fold(batch: DataFrame, _: int) -> None:
        rows = batch
        if view.versions():
            rows = view.read().select(*batch.columns).unionByName(batch)
        rest = [c for c in batch.columns if c not in (*keys, "timestamp_ms", "seq")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct("timestamp_ms", "seq", *rest), F.struct("timestamp_ms", "seq")).alias("x"))
        view.write(last.select(*keys, "x.*").select(*batch.columns), "overwrite", operation="fold")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(view: VersionedTable, keys: list[str]) -> DataFrame:
    """The live rows of a view."""
    return live(view.read(), keys)


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value by type and window; works on streams (late rows up to ``late``) and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_graph(events: DataFrame, path: str, checkpoint: str):
    """Write User and Event nodes and DID relationships of a stream of events, batch by batch, idempotently by batch."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.select("event_id", "ts", "event_type", "value").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        batch.select(F.col("user_id").alias("src"), F.col("event_id").alias("dst")).write.mode("overwrite").parquet(f"{path}/did/batch={number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def object_refs(events: DataFrame, refs: str = "object_refs") -> DataFrame:
    """One row for each object that an event draft names, with its role."""
    return events.select("*", F.explode(refs).alias("ref")).drop(refs).select("*", "ref.*").drop("ref")
