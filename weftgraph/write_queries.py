"""Registered queries that write: graphs, versioned tables and logs, read back whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.graph import EdgeTable, NodeTable, PropertyGraph
from .session import GraphSession
from .sources import log as logs
from .sources.durable import shared_dir
from .sources.snapshot import VersionedTable
from .sources.tables import read


def _session(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Customers and nations as one node table, and where customers live as one edge table."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    key = F.concat(F.lit("c"), F.col("c_custkey"))
    nodes = c.select(key.alias("id"), F.array(F.lit("Customer")).alias("labels"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("bal"))
    nodes = nodes.unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("bal"))
    )
    edges = c.select(F.concat(F.lit("e"), F.col("c_custkey")).alias("id"), F.lit("LIVES").alias("type"), key.alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"))
    return GraphSession(PropertyGraph([NodeTable(nodes, None)], [EdgeTable(edges, None)]))


def written(statements: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last statement reads after the others have written."""
    return _session(spark, sf_dir).query_batch(statements)[-1]


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and price of four versions: written, appended to, overwritten, and the second restored."""
    o, t = _orders(spark, sf_dir), VersionedTable(spark, _place(spark))
    t.write(o.where("o_orderstatus = 'F'"), "create")
    t.write(o.where("o_orderstatus = 'O'"))
    t.tag("both")
    t.write(o.where("o_orderstatus = 'P'"), "overwrite")
    t.restore(2)
    parts = [t.checkout(v).read().agg(F.lit(str(v)).alias("v"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s")) for v in (1, "both", 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = _orders(spark, sf_dir), VersionedTable(spark, _place(spark))
    for status in "FOP":
        t.write(o.where(F.col("o_orderstatus") == status))
    t.compact()
    t.cleanup()
    return t.read()


def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = VersionedTable(spark, _place(spark))
    t.write(_orders(spark, sf_dir))
    t.update({"o_totalprice": "-o_totalprice"}, "o_orderstatus = 'F'")
    return t.read()


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = VersionedTable(spark, _place(spark))
    t.write(_orders(spark, sf_dir).withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")))
    t.delete("o_orderstatus = 'F'")
    return t.read()


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = _orders(spark, sf_dir), VersionedTable(spark, _place(spark))
    t.write(o.where("o_orderstatus <> 'P'"))
    t.merge_insert(o.where("o_orderstatus <> 'F'").withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"])
    return t.read()


def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of puts and tombstones, compacted: records of raw and live kind."""
    o = read(spark, sf_dir, "orders")
    store = logs.LogStore(spark, _place(spark))

    def rows(op: int, at: int, some: DataFrame) -> DataFrame:
        given = {"op": F.lit(op), "label": F.lit("Order"), "pk_value": F.col("o_orderkey"), "timestamp_ms": F.lit(at), "seq": F.col("o_orderkey"), "repo": F.col("o_orderstatus")}
        return some.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], logs.VERTICES).schema])

    store.write_all(vertices=rows(0, 1, o))
    store.write_all(vertices=rows(1, 2, o.where("o_orderkey % 3 = 0")))
    store.write_all(vertices=rows(0, 3, o.where("o_orderkey % 6 = 0")))
    store.compact()
    return store.vertices().select("pk_value", "repo", "timestamp_ms")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records put and deleted one by one for each region."""
    store = logs.LogStore(spark, _place(spark))
    for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").toLocalIterator():
        store.merge_record("Region", "rkey", str(r["r_regionkey"]), {"name": "old"})
        store.merge_record("Region", "rkey", str(r["r_regionkey"]), {"name": r["r_name"]})
        if r["r_regionkey"] % 2:
            store.delete_record("Region", "rkey", str(r["r_regionkey"]))
    return GraphSession(store.graph()).query("MATCH (r:Region) RETURN r.rkey AS k, r.name AS n")


_GRAPH = {
    "write_create": (
        ["MATCH (c:Customer) WHERE c.name = 'BUILDING' CREATE (t:Task {owner: c.k, half: c.bal / 2})-[:FOR {since: c.k}]->(c)", "MATCH (t:Task)-[f:FOR]->(c:Customer) RETURN c.k AS k, t.owner AS owner, t.half AS half, f.since AS since"],
        "SELECT c_custkey AS k, c_custkey AS owner, c_acctbal / 2 AS half, c_custkey AS since FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "write_create_rel": (
        ["MATCH (c:Customer)-[:LIVES]->(n:Nation) WHERE c.bal < 0 CREATE (n)-[:OWED_BY]->(c)", "MATCH (n:Nation)-[:OWED_BY]->(c) RETURN n.name AS name, count(c) AS n"],
        "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY n_name",
    ),
    "write_merge": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.name}) ON CREATE SET s.fresh = 1", "MERGE (s:Segment {name: 'BUILDING'}) ON MATCH SET s.seen = 7", "MATCH (s:Segment) RETURN s.name AS name, s.fresh AS fresh, s.seen AS seen"],
        "SELECT DISTINCT c_mktsegment AS name, CAST(1 AS BIGINT) AS fresh, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(7 AS BIGINT) END AS seen FROM customer",
    ),
    "write_set": (
        ["MATCH (c:Customer) WHERE c.bal < 0 SET c.bal = c.bal * 2, c.owes = true", "MATCH (c:Customer) RETURN c.k AS k, c.bal AS bal, c.owes AS owes"],
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS bal, CASE WHEN c_acctbal < 0 THEN true END AS owes FROM customer",
    ),
    "write_set_map": (
        ["MATCH (n:Nation) SET n += {name: 'N', size: n.k * 2}, n:Land", "MATCH (n:Land) RETURN n.k AS k, n.name AS name, n.size AS size, size(labels(n)) AS l"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, 'N' AS name, CAST(n_nationkey * 2 AS BIGINT) AS size, CAST(2 AS BIGINT) AS l FROM nation",
    ),
    "write_remove": (["MATCH (c:Customer) WHERE c.bal < 0 REMOVE c.bal", "MATCH (c:Customer) RETURN c.k AS k, c.bal AS bal"], "SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer"),
    "write_delete_rel": (
        ["MATCH (c:Customer)-[r:LIVES]->(n:Nation) WHERE n.k < 5 DELETE r", "MATCH (c:Customer)-[r:LIVES]->(n:Nation) RETURN n.k AS k, count(*) AS n"],
        "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY c_nationkey",
    ),
    "write_detach_delete": (
        ["MATCH (n:Nation) WHERE n.k % 2 = 0 DETACH DELETE n", "MATCH (c:Customer) OPTIONAL MATCH (c)-[r:LIVES]->(n:Nation) RETURN c.k AS k, n.k AS n"],
        "SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 1 THEN CAST(c_nationkey AS BIGINT) END AS n FROM customer",
    ),
    "write_foreach": (["MATCH (n:Nation) FOREACH (v IN [1, 2, n.k] | CREATE (:Mark {v: v, of: n.name}))", "MATCH (m:Mark) RETURN m.of AS name, sum(m.v) AS s, count(*) AS n"], "SELECT n_name AS name, CAST(n_nationkey + 3 AS BIGINT) AS s, CAST(3 AS BIGINT) AS n FROM nation"),
    "write_unwind": (["UNWIND ['x', 'y', 'x'] AS v MERGE (t:Tag {name: v})", "UNWIND [1, 2] AS v CREATE (:Tag {name: 'n', v: v})", "MATCH (t:Tag) RETURN t.name AS name, t.v AS v"], "SELECT * FROM (VALUES ('x', CAST(NULL AS BIGINT)), ('y', NULL), ('n', 1), ('n', 2)) t(name, v)"),
}

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {n: (partial(written, statements), sql) for n, (statements, sql) in _GRAPH.items()}
QUERIES |= {
    "store_versions": (
        store_versions,
        "WITH o AS (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders) SELECT v, count(*) AS n, round(sum(p), 2) AS s FROM o JOIN (VALUES ('1', 'F'), ('both', 'F'), ('both', 'O'), ('3', 'P'), ('4', 'F'), ('4', 'O')) t(v, x) ON o.s = x GROUP BY v",
    ),
    "store_compact": (store_compact, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "store_update": (store_update, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders"),
    "store_delete": (store_delete, "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"),
    "store_merge": (store_merge, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 1.0 END AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"),
    "log_compact": (log_compact, "SELECT CAST(o_orderkey AS VARCHAR) AS pk_value, o_orderstatus AS repo, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 3 ELSE 1 END AS BIGINT) AS timestamp_ms FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0"),
    "log_records": (log_records, "SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS n FROM region WHERE r_regionkey % 2 = 0"),
}
