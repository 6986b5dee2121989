"""Records by label with a sequence: training traces, experts, embeddings and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import as_vector, distance
from .snapshot import VersionedTable

SCHEMA = "label string, seq long, id string, payload string, vector array<float>"


class TraceStore:
    """A versioned table of records; reads are by label in sequence order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def _rows(self) -> DataFrame:
        return self.table.read() if self.table.versions() else self.spark.createDataFrame([], SCHEMA)

    def ingest(self, label: str, records: DataFrame) -> int:
        """Append records (``id``, ``payload``, ``vector``) in the order of their ids; returns the version."""
        last = self._rows().where(F.col("label") == label).agg(F.max("seq")).first()[0]
        from ..operators.tables import numbered

        rows = numbered(records, ["id"]).withColumn("seq", F.col("_position") + F.lit(0 if last is None else last + 1))
        rows = rows.withColumn("label", F.lit(label))
        for c, t in (("payload", "string"), ("vector", "array<float>")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(t))
        return self.table.write(rows.select("label", "seq", "id", "payload", F.col("vector").cast("array<float>").alias("vector")))

    def read(self, label: str, offset: int, batch: int) -> DataFrame:
        return self._rows().where((F.col("label") == label) & F.col("seq").between(offset, offset + batch - 1)).orderBy("seq")

    def count(self, label: str | None = None) -> int:
        return self._rows().where(F.col("label") == label).count() if label is not None else self._rows().count()

    def labels(self) -> DataFrame:
        return self._rows().select("label").distinct().orderBy("label")

    def stats(self) -> DataFrame:
        return self._rows().groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq")).orderBy("label")

    def vectors(self, label: str, ids: list[str], dim: int) -> DataFrame:
        """The vectors of ids in the order asked; unknown ids get zeros."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "place int, id string")
        have = self._rows().where(F.col("label") == label).select("id", "vector")
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return F.broadcast(asked).join(have, "id", "left").select("place", "id", F.coalesce("vector", zeros).alias("vector")).orderBy("place")

    def route(self, label: str, query: list[float], k: int) -> DataFrame:
        """The k records of a label with the largest inner product."""
        rows = self._rows().where((F.col("label") == label) & (F.size("vector") == len(query)))
        rows = rows.withColumn("score", 1.0 - distance(F.col("vector"), as_vector(query), "dot"))
        return rows.select("id", "score").orderBy(F.desc("score"), "id").limit(k)
