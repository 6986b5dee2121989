"""Writing clauses: each makes new versions of the node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..plans.graph import EdgeTable, NodeTable, PropertyGraph
from ..plans.values import NodeRef, RelRef, SemanticError, Value
from ..sources.durable import cut


class Writer:
    """Applies writes to a session's graph of one node table and one edge table.

    New ids are drawn once and written out, so that later reads agree on them.
    ``stamp`` adds properties to every node that is created or set.
    """

    def __init__(self, session, stamp: dict | None = None):
        self.session, self.stamp = session, stamp or {}
        g = session.graph
        if len(g.nodes) != 1 or len(g.edges) != 1 or g.nodes[0].label is not None or g.edges[0].type is not None:
            raise SemanticError("only graphs of one node table and one edge table can be written")

    @property
    def nodes(self) -> DataFrame:
        return self.session.graph.nodes[0].df

    @property
    def edges(self) -> DataFrame:
        return self.session.graph.edges[0].df

    def put(self, compiler, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        old = self.session.graph
        new = PropertyGraph([NodeTable(nodes if nodes is not None else self.nodes, None)], [EdgeTable(edges if edges is not None else self.edges, None)])
        new.indexes, new.constraints = old.indexes, old.constraints
        self.session.graph = compiler.graph = new

    def apply(self, compiler, c: A.Clause, rows):
        return getattr(self, "_" + type(c).__name__.lower())(compiler, c, rows)

    # -- creating
    def _create(self, compiler, c: A.Create, rows):
        from ..plans.compiler import Rows

        df = rows.df if rows.df is not None else compiler.one_row()
        scope = dict(rows.scope)
        made_nodes: list[tuple[str, A.NodePattern]] = []
        made_rels: list[tuple[str, A.RelPattern, str, str]] = []
        for p in c.patterns:
            names = []
            for n in p.nodes:
                name = n.var or f"@new{len(df.columns)}n{len(made_nodes)}"
                if name not in scope:
                    df = df.withColumn(f"{name}.@id", F.expr("uuid()"))
                    made_nodes.append((name, n))
                    scope[name] = NodeRef(name, {}, T.StringType(), [0])
                names.append(name)
            for k, r in enumerate(p.rels):
                name = r.var or f"@new{len(df.columns)}r{len(made_rels)}"
                df = df.withColumn(f"{name}.@id", F.expr("uuid()"))
                a, b = (names[k + 1], names[k]) if r.direction == "in" else (names[k], names[k + 1])
                made_rels.append((name, r, a, b))
        base = dict(rows.scope)
        x = compiler.expressions(base)
        for name, n in made_nodes:
            props = {k: x.value(e) for k, e in n.props} | {k: x.literal(v) for k, v in self.stamp.items()}
            kinds = {k: T.StringType() if isinstance(v.type, T.NullType) else v.type for k, v in props.items()}
            df = df.withColumn(f"{name}.@labels", F.array(*[F.lit(z) for z in n.labels]).cast("array<string>"))
            for k, v in props.items():
                df = df.withColumn(f"{name}.{k}", v.col.cast(kinds[k]) if isinstance(v.type, T.NullType) else v.col)
            scope[name] = NodeRef(name, kinds, T.StringType(), [0])
        for name, r, a, b in made_rels:
            props = {k: x.value(e) for k, e in r.props}
            df = df.withColumn(f"{name}.@type", F.lit(r.types[0] if r.types else "RELATED")).withColumn(f"{name}.@src", F.col(f"`{a}.@id`")).withColumn(f"{name}.@dst", F.col(f"`{b}.@id`"))
            for k, v in props.items():
                df = df.withColumn(f"{name}.{k}", v.col)
            scope[name] = RelRef(name, {k: v.type for k, v in props.items()}, T.StringType())
        df, _ = cut(df)
        nodes, edges = self.nodes, self.edges
        for name, n in made_nodes:
            ref = scope[name]
            new = df.select(ref.id().alias("id"), ref.labels().alias("labels"), *[ref.prop(k).alias(k) for k in ref.props])
            nodes = union_fitted(nodes, new)
        for name, r, a, b in made_rels:
            ref = scope[name]
            new = df.select(ref.id().alias("id"), ref.rel_type().alias("type"), F.col(f"`{name}.@src`").alias("src"), F.col(f"`{name}.@dst`").alias("dst"), *[ref.prop(k).alias(k) for k in ref.props])
            edges = union_fitted(edges, new)
        self.put(compiler, nodes, edges)
        return Rows(df, {k: v for k, v in scope.items() if not k.startswith("@new")})

    def _merge(self, compiler, c: A.Merge, rows):
        """Rows that match the pattern bind it; the others create it, once for equal values."""
        from ..plans.compiler import Rows

        single = rows.df is None
        outer = rows.df if rows.df is not None else compiler.one_row()
        outer, _ = cut(outer.withColumn("@m", F.monotonically_increasing_id()))
        m = compiler.matcher()
        if single:
            found_df, scope = m.match(None, {}, c.pattern)
            found_df = found_df.withColumn("@m", F.lit(0).cast("long"))
        else:
            found_df, scope = m.match(outer, rows.scope, c.pattern)
        found_df, _ = cut(found_df)
        missing = outer.join(found_df.select("@m").distinct(), "@m", "left_anti") if not single else (outer if found_df.isEmpty() else outer.limit(0))
        if c.on_match and not found_df.isEmpty():
            self._setitems(compiler, A.SetItems(c.on_match), Rows(found_df, scope))
        if not missing.isEmpty():
            x = compiler.expressions(rows.scope)
            keys = [x.value(e).col for n in [*c.pattern.nodes, *c.pattern.rels] for _, e in n.props] + [rows.scope[n.var].id() for n in c.pattern.nodes if n.var in rows.scope]
            first = missing.withColumn("@k", F.xxhash64(*keys) if keys else F.lit(0)).dropDuplicates(["@k"]).drop("@k")
            created = self._create(compiler, A.Create([c.pattern]), Rows(first, rows.scope))
            if c.on_create:
                self._setitems(compiler, A.SetItems(c.on_create), created)
        # All rows now match the pattern in the new graph.
        m = compiler.matcher()
        df, scope = m.match(None if single else outer.drop("@m"), rows.scope, c.pattern)
        return Rows(df, scope)

    # -- changing
    def _changed(self, rows, ref, values: dict, labels=None):
        """What the last row says about each element: id and new values."""
        cols = [F.col(f"`{ref.var}.@id`").alias("id")] + [v.alias("@new:" + k) for k, v in values.items()]
        if labels is not None:
            cols.append(labels.alias("@labels"))
        return rows.df.where(F.col(f"`{ref.var}.@id`").isNotNull()).select(*cols).dropDuplicates(["id"])

    def _setitems(self, compiler, c: A.SetItems, rows):
        from ..plans.compiler import Rows

        for item in c.items:
            kind, var = item[0], item[1]
            ref = rows.scope.get(var)
            if ref is None:
                raise SemanticError(f"the variable {var} is not bound")
            if not isinstance(ref, NodeRef):
                continue
            x = compiler.expressions(rows.scope)
            values: dict[str, Value] = {}
            labels = None
            if kind == "prop":
                values[item[2]] = x.value(item[3])
            elif kind == "map":
                v = x.value(item[2])
                if not isinstance(v.type, T.StructType):
                    raise SemanticError("SET needs a map with known keys")
                values = {f.name: Value(v.col[f.name], f.dataType) for f in v.type.fields if not f.name.startswith("_")}
            else:
                labels = F.array(*[F.lit(z) for z in item[2]])
            for k, v in self.stamp.items():
                values[k] = x.literal(v)
            cols = {k: v.col.cast("string") if isinstance(v.type, T.NullType) else v.col for k, v in values.items()}
            new, _ = cut(self._changed(rows, ref, cols, labels))
            nodes = self.nodes
            joined = nodes.join(new.withColumn("@hit", F.lit(True)), "id", "left")
            hit = F.col("@hit").isNotNull()
            for k, v in values.items():
                old = nodes.schema[k].dataType if k in nodes.columns else v.type
                target = fitted(old, v.type)
                fresh = F.col(f"`@new:{k}`").cast(target)
                before = F.col(f"`{k}`").cast(target) if k in nodes.columns else F.lit(None).cast(target)
                joined = joined.withColumn(k, F.when(hit, fresh).otherwise(before))
            if labels is not None:
                joined = joined.withColumn("labels", F.when(hit, F.array_union("labels", "@labels")).otherwise(F.col("labels")))
            columns = list(dict.fromkeys([*nodes.columns, *values]))
            nodes, _ = cut(joined.select(*[F.col(f"`{n}`") for n in columns]))
            self.put(compiler, nodes)
            rows = self.refreshed(compiler, rows, var)
        return rows if isinstance(rows, Rows) else rows

    def refreshed(self, compiler, rows, var: str):
        """The rows with what the graph now says of a node variable."""
        from ..plans.compiler import Rows

        ref = rows.scope[var]
        df = rows.df.drop(*[c for c in ref.columns() if c != f"{var}.@id"])
        m = compiler.matcher()
        fresh, new = m.scan(var, [0])
        fresh = fresh.withColumnRenamed(f"{var}.@id", "@fresh")
        df = df.join(fresh, F.col(f"`{var}.@id`") == F.col("@fresh"), "left").drop("@fresh")
        return Rows(df, {**rows.scope, var: new})

    def _remove(self, compiler, c: A.Remove, rows):
        """Removing a property sets it to null; removing a label does nothing."""
        items = [("prop", i[1], i[2], A.Lit(None)) for i in c.items if i[0] == "prop"]
        return self._setitems(compiler, A.SetItems(items), rows) if items else rows

    def _delete(self, compiler, c: A.Delete, rows):
        for name in c.names:
            ref = rows.scope.get(name)
            if ref is None:
                raise SemanticError(f"the variable {name} is not bound")
            gone, _ = cut(rows.df.select(ref.id().alias("id")).where("id is not null").distinct())
            if isinstance(ref, RelRef):
                self.put(compiler, edges=cut(self.edges.join(gone, "id", "left_anti").select(*self.edges.columns))[0])
                continue
            nodes = cut(self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns))[0]
            edges = self.edges
            if c.detach:
                a, b = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
                edges = cut(edges.join(a, "src", "left_anti").join(b, "dst", "left_anti").select(*edges.columns))[0]
            self.put(compiler, nodes, edges)
        return rows

    def _foreach(self, compiler, c: A.Foreach, rows):
        from ..plans.compiler import Rows

        inner = compiler._unwind(A.Unwind(c.source, c.var), rows)
        inner = Rows(cut(inner.df)[0], inner.scope)
        for x in c.body:
            inner = self.apply(compiler, x, inner)
        return rows


def fitted(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type of a column that held ``old`` and gets ``new``."""
    if isinstance(new, T.NullType) or old == new:
        return old
    if isinstance(old, T.NullType) or old.simpleString() == new.simpleString():
        return new
    if isinstance(old, T.NumericType) and isinstance(new, T.NumericType):
        return T.LongType() if isinstance(old, T.IntegralType) and isinstance(new, T.IntegralType) else T.DoubleType()
    return T.StringType()


def union_fitted(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns by name, absent ones null, types widened where they differ."""
    for k in b.columns:
        if k in a.columns and a.schema[k].dataType.simpleString() != b.schema[k].dataType.simpleString():
            t = fitted(a.schema[k].dataType, b.schema[k].dataType)
            a, b = a.withColumn(k, F.col(f"`{k}`").cast(t)), b.withColumn(k, F.col(f"`{k}`").cast(t))
    return a.unionByName(b, allowMissingColumns=True)
