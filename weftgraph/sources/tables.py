"""The TPC-H-like tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import EdgeTable, NodeTable, PropertyGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ITEM = {f"l_{x}": x for x in ("quantity", "extendedprice", "discount", "tax", "linenumber", "returnflag", "linestatus", "shipdate")}


def tables_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes for each table and relationships for its foreign keys.

    A table is opened when a query first touches it. Relationships are projections
    of the tables that hold the key, so they cost no join until a query follows
    them; parallel ones (line items) are kept.
    """
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = read(spark, sf_dir, name)
        return opened[name]

    def turn(number: str = "turn"):
        return F.concat_ws("/", F.col("conv_id").cast("string"), F.col(number).cast("string"))

    def node(label: str, name: str, key, rows=None) -> NodeTable:
        def make():
            df = table(name) if rows is None else rows(table(name))
            return df.select((F.col(key) if isinstance(key, str) else key()).alias("id"), *df.columns)

        return NodeTable(make, label)

    def edge(kind: str, name: str, src: str, dst: str, a: str, b: str, key: str | None = None, rows=None, items: bool = False, own: str | None = None) -> EdgeTable:
        def make():
            df = table(name) if rows is None else rows(table(name))
            if items:  # a line item has no key of its own: all its columns are it
                ident = F.xxhash64(*[F.col(c) for c in df.columns])
            else:
                ident = F.col(key or src)
            return df.select(ident.alias("id"), F.col(src).alias("src"), F.col(dst).alias("dst"), *[F.col(x).alias(y) for x, y in (_ITEM if items else {}).items()])

        return EdgeTable(make, kind, a, b, list(_ITEM.values()) if items else [], own)

    def chain(events: DataFrame) -> DataFrame:
        by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return events.select("event_id", "user_id", "ts").withColumn("next", F.lead("event_id").over(by_user)).where("next is not null")

    def following(turns: DataFrame) -> DataFrame:
        rows = turns.select("conv_id", "turn").withColumn("after", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
        return rows.select(turn().alias("from"), turn("after").alias("to"))

    nodes = [
        node("Region", "region", "r_regionkey"),
        node("Nation", "nation", "n_nationkey"),
        node("Customer", "customer", "c_custkey"),
        node("Supplier", "supplier", "s_suppkey"),
        node("Part", "part", "p_partkey"),
        node("Order", "orders", "o_orderkey"),
        node("User", "events", "user_id", lambda e: e.select("user_id").distinct()),
        node("Event", "events", "event_id"),
        node("Doc", "documents", "doc_id"),
        node("Vec", "embeddings", "vec_id"),
        node("Page", "pages", "page_id"),
        node("Item", "benchmark", "item_id"),
        node("Label", "labels", "doc_id"),
        node("Turn", "conversations", turn),
    ]
    edges = [
        edge("IN_REGION", "nation", "n_nationkey", "n_regionkey", "Nation", "Region", own="src"),
        edge("IN_NATION", "customer", "c_custkey", "c_nationkey", "Customer", "Nation", own="src"),
        edge("IN_NATION", "supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation", own="src"),
        edge("PLACED", "orders", "o_custkey", "o_orderkey", "Customer", "Order", "o_orderkey", own="dst"),
        edge("CONTAINS", "lineitem", "l_orderkey", "l_partkey", "Order", "Part", items=True),
        edge("SUPPLIES", "lineitem", "l_suppkey", "l_partkey", "Supplier", "Part", items=True),
        edge("SHIPPED_BY", "lineitem", "l_orderkey", "l_suppkey", "Order", "Supplier", items=True),
        edge("DID", "events", "user_id", "event_id", "User", "Event", "event_id", own="dst"),
        edge("NEXT_EVENT", "events", "event_id", "next", "Event", "Event", rows=chain),
        edge("NEXT", "conversations", "from", "to", "Turn", "Turn", rows=following),
        edge("HAS_LABEL", "labels", "doc_id", "doc_id", "Doc", "Label"),
    ]
    return PropertyGraph(nodes, edges, spark)
