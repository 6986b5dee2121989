"""A property graph laid over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Table:
    """A table that is made when it is first touched; it may be given as a function."""

    reserved: tuple[str, ...] = ()

    def __init__(self, df: DataFrame | Callable[[], DataFrame], props: list[str] | None = None):
        self._df, self._props = df, props

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @property
    def props(self) -> list[str]:
        if self._props is None:
            self._props = [c for c in self.df.columns if c not in self.reserved]
        return self._props


class NodeTable(_Table):
    """Nodes in columns ``id`` and properties; labels are fixed, or (None) in an array column ``labels``."""

    reserved = ("id", "labels")

    def __init__(self, df, label: str | None, props: list[str] | None = None):
        super().__init__(df, props)
        self.label = label


class EdgeTable(_Table):
    """Relationships in columns ``id``, ``src``, ``dst`` and properties; the type is fixed, or (None) in a column ``type``.

    A label of an end may be fixed; None is any. ``own`` names the end (``src`` or
    ``dst``) whose node table the relationships are made from: each of its nodes has
    one at most, and each relationship that end.
    """

    reserved = ("id", "src", "dst", "type")

    def __init__(self, df, type: str | None, src_label: str | None = None, dst_label: str | None = None, props: list[str] | None = None, own: str | None = None):
        super().__init__(df, props)
        self.type, self.src_label, self.dst_label, self.own = type, src_label, dst_label, own


class PropertyGraph:
    """Node and relationship tables, looked up by label and type.

    Tables stay ordinary DataFrames with typed columns, so filters and column
    choices reach their files. Ids are native to a table; where a variable may range
    over several tables, ids are text made of label and id.
    """

    def __init__(self, nodes: list[NodeTable], edges: list[EdgeTable], spark=None):
        self.nodes, self.edges, self._spark = nodes, edges, spark
        self.indexes: dict[str, dict] = {}
        self.constraints: dict[str, dict] = {}

    @classmethod
    def untyped(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """A graph of one node table (``id``, ``labels``, ...) and one edge table (``id``, ``type``, ``src``, ``dst``, ...)."""
        return cls([NodeTable(nodes, None)], [EdgeTable(edges, None)])

    @property
    def spark(self):
        return self._spark or self.nodes[0].df.sparkSession

    def tables_for(self, labels: list[str]) -> list[int]:
        """Node tables that may hold nodes with all the labels (at most one fixed label each)."""
        out = []
        for i, t in enumerate(self.nodes):
            if t.label is None or all(x == t.label for x in labels):
                out.append(i)
        return out

    def edge_tables_for(self, types: list[str]) -> list[int]:
        return [i for i, e in enumerate(self.edges) if e.type is None or not types or e.type in types]

    def joins(self, edge: int, node: int, side: str) -> bool:
        label = getattr(self.edges[edge], f"{side}_label")
        mine = self.nodes[node].label
        return label is None or mine is None or label == mine

    def global_id(self, node: int, column):
        label = self.nodes[node].label
        return column.cast("string") if label is None else F.concat(F.lit(label + ":"), column.cast("string"))

    # -- catalog
    def labels(self) -> DataFrame:
        """All labels that nodes bear, sorted."""
        out = None
        for t in self.nodes:
            rows = t.df.select(F.explode("labels").alias("label")) if t.label is None else t.df.limit(1).select(F.lit(t.label).alias("label"))
            out = rows if out is None else out.unionByName(rows)
        return out.distinct().orderBy("label")

    def types(self) -> DataFrame:
        out = None
        for t in self.edges:
            rows = t.df.select(F.col("type").alias("relationshipType")) if t.type is None else t.df.limit(1).select(F.lit(t.type).alias("relationshipType"))
            out = rows if out is None else out.unionByName(rows)
        return out.distinct().orderBy("relationshipType")

    def _presence(self, tables) -> DataFrame:
        out = None
        for t in tables:
            if not t.props:
                continue
            flags = t.df.agg(*[F.coalesce(F.max(F.col(f"`{p}`").isNotNull()), F.lit(False)).alias(p) for p in t.props])
            pairs = F.array(*[F.struct(F.lit(p).alias("propertyKey"), F.col(f"`{p}`").alias("there")) for p in t.props])
            rows = flags.select(F.explode(pairs).alias("x")).where("x.there").select("x.propertyKey")
            out = rows if out is None else out.unionByName(rows)
        return out

    def property_keys(self) -> DataFrame:
        """Names of properties that some node or relationship has a value for."""
        rows = [r for r in (self._presence(self.nodes), self._presence(self.edges)) if r is not None]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.distinct().orderBy("propertyKey")

    def type_properties(self, of: str) -> DataFrame:
        """Properties by label or type: ``nodeType`` or ``relType``, ``propertyName``, ``propertyTypes``."""
        first = "nodeType" if of == "node" else "relType"
        rows: list[DataFrame] = []
        for t in self.nodes if of == "node" else self.edges:
            fixed = t.label if of == "node" else t.type
            names = F.array(*[F.when(F.col(f"`{p}`").isNotNull(), F.lit(p)) for p in t.props]) if t.props else F.array().cast("array<string>")
            if fixed is not None:
                label = F.array(F.lit(fixed))
            else:
                label = F.col("labels") if of == "node" else F.array("type")
            x = t.df.select(F.explode(label).alias("l"), F.array_compact(names).alias("ps")).select("l", F.explode("ps").alias("p"))
            rows.append(x.distinct())
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return (
            out.distinct()
            .select(F.concat(F.lit(":"), "l").alias(first), F.col("p").alias("propertyName"), F.array(F.lit("String")).alias("propertyTypes"))
            .orderBy(first, "propertyName")
        )


def property_type(tables: list[DataFrame], name: str) -> T.DataType:
    """The type that a property has in all tables that hold it; text where they differ."""
    kinds = {t.schema[name].dataType for t in tables if name in t.columns}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds and all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType() if any(isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)) for k in kinds) else T.LongType()
    return T.StringType()
