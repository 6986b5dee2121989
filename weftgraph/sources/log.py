"""Append-only logs of vertices and edges, and what is live in them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import EdgeTable, NodeTable, PropertyGraph

VERTICES = "op tinyint, label string, pk_value string, timestamp_ms long, seq long, repo string, owner_did string, name string, app_id string, rkey string, val_json string"
EDGES = "op tinyint, edge_label string, eid string, src_vid string, dst_vid string, src_label string, dst_label string, timestamp_ms long, seq long, app_id string, val_json string"
PROMOTED = ("repo", "owner_did", "name", "app_id", "rkey")


def live(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by time and sequence, unless it is a tombstone.

    One partial aggregation (no sort, no window): the newest row is kept as the
    maximum of a struct that starts with time and sequence.
    """
    rest = [c for c in log.columns if c not in (*keys, "timestamp_ms", "seq")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("timestamp_ms", "seq", *rest), F.struct("timestamp_ms", "seq")).alias("x"))
    return last.where("x.op = 0").select(*keys, "x.timestamp_ms", "x.seq", *[f"x.{c}" for c in rest])


def live_vertices(log: DataFrame) -> DataFrame:
    return live(log, ["label", "pk_value"])


def live_edges(log: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Live edges; with ``vertices``, those of which both ends are live."""
    out = live(log, ["edge_label", "eid"])
    if vertices is None:
        return out
    ids = vertices.select("pk_value").distinct()
    out = out.join(ids.withColumnRenamed("pk_value", "src_vid"), "src_vid", "left_semi")
    return out.join(ids.withColumnRenamed("pk_value", "dst_vid"), "dst_vid", "left_semi")


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key, raw_rows, live_rows, dead_rows, dead_ratio for each label and type."""
    out = None
    for kind, log, key, now in (("vertex", vertices, "label", live_vertices(vertices)), ("edge", edges, "edge_label", live_edges(edges))):
        raw = log.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("raw_rows"))
        alive = now.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("live_rows"))
        rows = raw.join(alive, "key", "left").select(F.lit(kind).alias("kind"), "key", "raw_rows", F.coalesce("live_rows", F.lit(0).cast("long")).alias("live_rows"))
        out = rows if out is None else out.unionByName(rows)
    dead = F.col("raw_rows") - F.col("live_rows")
    return out.select("*", dead.alias("dead_rows"), F.when(F.col("raw_rows") > 0, dead / F.col("raw_rows")).otherwise(0.0).alias("dead_ratio"))


class LogStore:
    """The two logs as Parquet folders; writing appends, reading takes what is live."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def vertices(self) -> DataFrame:
        return self._read("vertices", VERTICES)

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES)

    def _append(self, name: str, schema: str, rows) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _stamp(self) -> tuple[int, int]:
        now = time.time_ns()
        return now // 1_000_000, now

    def merge_record(self, label: str, pk_key: str, pk_value: str, props: dict) -> None:
        """Put a record; with the key ``eid`` it is an edge, its ends in ``_src``, ``_dst``, ``_src_label``, ``_dst_label``."""
        at, seq = self._stamp()
        if pk_key == "eid":
            rest = {k: v for k, v in props.items() if k not in ("_src", "_dst", "_src_label", "_dst_label", "app_id")}
            row = (0, label, pk_value, props.get("_src"), props.get("_dst"), props.get("_src_label"), props.get("_dst_label"), at, seq, props.get("app_id"), json.dumps(rest))
            self._append("edges", EDGES, [row])
            return
        rest = {k: v for k, v in props.items() if k not in PROMOTED} | ({pk_key: pk_value} if pk_key not in PROMOTED else {})
        self._append("vertices", VERTICES, [(0, label, pk_value, at, seq, *[props.get(k) for k in PROMOTED[:4]], props.get("rkey", pk_value if pk_key == "rkey" else None), json.dumps(rest))])

    def delete_record(self, label: str, pk_key: str, pk_value: str) -> bool:
        """Append a tombstone; false if there is no such live vertex (edges: always true)."""
        at, seq = self._stamp()
        if pk_key == "eid":
            self._append("edges", EDGES, [(1, label, pk_value, None, None, None, None, at, seq, None, None)])
            return True
        here = live_vertices(self.vertices().where((F.col("label") == label) & (F.col("pk_value") == pk_value)))
        if here.isEmpty():
            return False
        self._append("vertices", VERTICES, [(1, label, pk_value, at, seq, None, None, None, None, None, None)])
        return True

    def write_all(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Append many records at once, as one set of files by label."""
        if vertices is not None:
            vertices.write.mode("append").parquet(f"{self.path}/vertices")
        if edges is not None:
            edges.write.mode("append").parquet(f"{self.path}/edges")

    def compact(self) -> None:
        """Rewrite both logs to what is live, sorted by key within files, and swap them in."""
        for name, schema, rows, keys in (
            ("vertices", VERTICES, live_vertices(self.vertices()), ["label", "pk_value"]),
            ("edges", EDGES, live_edges(self.edges()), ["edge_label", "eid"]),
        ):
            new = f"{self.path}/_{name}-{uuid.uuid4().hex}"
            order = T._parse_datatype_string(schema).names
            rows.select(*order).repartition(*keys).sortWithinPartitions(*keys).write.parquet(new)
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            old, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{self.path}/{name}", new))
            fs = old.getFileSystem(conf)
            fs.delete(old, True)
            fs.rename(fresh, old)

    def should_compact(self, merges: int) -> bool:
        """After every 8 merges; with 64 dead rows; or with a fifth of the rows dead."""
        s = statistics(self.vertices(), self.edges()).agg(F.sum("dead_rows").alias("d"), F.sum("raw_rows").alias("r")).first()
        dead, raw = s["d"] or 0, s["r"] or 0
        return merges % 8 == 0 and merges > 0 or dead >= 64 or (raw > 0 and dead / raw >= 0.2)

    def graph(self, props: list[str] = ()) -> PropertyGraph:
        """The live graph: promoted columns, and of the JSON the named properties, as text."""
        v = live_vertices(self.vertices())
        e = live_edges(self.edges(), v)
        extra = [F.get_json_object("val_json", f"$.{p}").alias(p) for p in props if p not in PROMOTED]
        nodes = v.select(F.col("pk_value").alias("id"), F.array("label").alias("labels"), "repo", "owner_did", "name", "app_id", F.coalesce("rkey", "pk_value").alias("rkey"), *extra)
        edges = e.select(F.col("eid").alias("id"), F.col("edge_label").alias("type"), F.col("src_vid").alias("src"), F.col("dst_vid").alias("dst"), *[F.get_json_object("val_json", f"$.{p}").alias(p) for p in props])
        return PropertyGraph([NodeTable(nodes, None)], [EdgeTable(edges, None)])


def encode_global_id(partition, local):
    """16 bits of partition and 48 bits of local id in one long."""
    return F.shiftleft(partition.cast("long"), 48).bitwiseOR(local.cast("long").bitwiseAND(F.lit((1 << 48) - 1)))


def decode_global_id(gid):
    return F.shiftrightunsigned(gid, 48).cast("int"), gid.bitwiseAND(F.lit((1 << 48) - 1))
