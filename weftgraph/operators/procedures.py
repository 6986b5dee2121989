"""Procedures: CALL name(arguments) YIELD columns. YIELD renames by position."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..functions import scalar
from ..plans.values import NodeRef, SemanticError, Value, common_type
from . import vector

STRING = T.StringType()


def call(compiler, c: A.Procedure, rows):
    name = c.name.lower()
    if name in _TABLES:
        return _table(compiler, c, rows, _TABLES[name](compiler.graph))
    if name in ("db.indexes", "db.schema.indexes", "db.constraints", "db.schema.constraints"):
        return rows
    if name == "db.index.vector.querynodes":
        return _nearest(compiler, c, rows)
    if name in _SCALARS:
        from ..plans.compiler import Rows

        x = compiler.expressions(rows.scope)
        df = rows.df if rows.df is not None else compiler.one_row()
        v = _SCALARS[name](*[x.value(a) for a in c.args])
        out = (c.yields or ["value"])[0]
        return Rows(df.withColumn(out, v.col), {**rows.scope, out: Value(F.col(f"`{out}`"), v.type)})
    raise SemanticError(f"no procedure {c.name}")


def _table(compiler, c, rows, df):
    from ..plans.compiler import Rows

    names = list(df.columns)
    for k, y in enumerate(c.yields or []):
        if k < len(names):
            df = df.withColumnRenamed(names[k], y)
            names[k] = y
    scope = {n: Value(F.col(f"`{n}`"), df.schema[n].dataType) for n in names}
    return Rows(df if rows.df is None else rows.df.crossJoin(df), {**rows.scope, **scope})


_TABLES = {
    "db.labels": lambda g: g.labels(),
    "db.relationshiptypes": lambda g: g.types(),
    "db.propertykeys": lambda g: g.property_keys(),
    "db.schema.nodetypeproperties": lambda g: g.type_properties("node"),
    "db.schema.reltypeproperties": lambda g: g.type_properties("rel"),
}


def _nearest(compiler, c, rows):
    """(label, property, vector, k): the k nodes most alike by cosine, for each row."""
    from ..plans.compiler import Rows

    x = compiler.expressions(rows.scope)
    label, prop = (a.value if isinstance(a, A.Lit) else compiler.params[a.name] for a in c.args[:2])
    v, k = x.value(c.args[2]), compiler.integer(c.args[3])
    node, score = ((c.yields or []) + ["node", "score"][len(c.yields or []) :])[:2]
    m = compiler.matcher()
    tables = compiler.graph.tables_for([label])
    df, ref = m.nodes(A.NodePattern(node, [label], []), node, tables, {})
    if prop not in ref.props:
        prop = "embedding"
    if prop not in ref.props:
        raise SemanticError(f"no property {prop}")
    target = scalar.REGISTRY["cosine_similarity"]
    if rows.df is None:
        s = target(Value(ref.prop(prop), ref.props[prop]), v).col
        df = vector.top(df.where(ref.prop(prop).isNotNull()).withColumn(score, s), score, k, ref.id())
    else:
        df = rows.df.withColumn("@q", F.monotonically_increasing_id()).crossJoin(df.where(ref.prop(prop).isNotNull()))
        s = target(Value(ref.prop(prop), ref.props[prop]), v).col
        df = vector.top(df.withColumn(score, s), score, k, ref.id(), ["@q"]).drop("@q")
    kind = T.DoubleType()
    return Rows(df, {**rows.scope, node: ref, score: Value(F.col(f"`{score}`"), kind)})


def _join(v, by):
    parts = F.transform(v.col, lambda x: F.coalesce(scalar.text_of(Value(x, v.type.elementType)), F.lit("null")))
    return Value(F.call_function("array_join", parts, by.col), STRING)


def _from_pairs(v):
    pairs = v.type.elementType
    if isinstance(pairs, T.ArrayType):
        full = F.filter(v.col, lambda p: F.size(p) >= 2)
        keys = F.transform(full, lambda p: scalar.text_of(Value(F.get(p, F.lit(0)), pairs.elementType)))
        values = F.transform(full, lambda p: F.get(p, F.lit(1)))
        # Of pairs with one key the last counts.
        last = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.array_position(F.slice(keys, i + 1, F.size(keys)), F.get(keys, i - 1)) == 0)
        kept = lambda c: F.filter(c, lambda _, i: F.get(last, i))
        out = F.when(F.size(keys) > 0, F.map_from_arrays(kept(keys), kept(values))).otherwise(F.map_from_arrays(keys, values))
        return Value(out, T.MapType(STRING, pairs.elementType))
    raise SemanticError("apoc.map.fromPairs needs a list of lists")


def _merge(a, b):
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        fields = {f.name: (a.col[f.name], f.dataType) for f in a.type.fields}
        fields |= {f.name: (b.col[f.name], f.dataType) for f in b.type.fields}
        return Value(F.struct(*[c.alias(k) for k, (c, _) in fields.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in fields.items()]))

    def as_map(v):
        if isinstance(v.type, T.MapType):
            return v.col, v.type.valueType
        kind = common_type([f.dataType for f in v.type.fields])
        pairs = [y for f in v.type.fields for y in (F.lit(f.name), v.col[f.name].cast(kind))]
        return F.create_map(*pairs), kind

    (x, xk), (y, yk) = as_map(a), as_map(b)
    kind = common_type([xk, yk])
    # Entries of the left that the right has not, then the right: no key occurs twice.
    left = F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k))
    cast = lambda m: F.transform_values(m, lambda _, v: v.cast(kind))
    return Value(F.map_concat(cast(left), cast(y)), T.MapType(STRING, kind))


def _flatten(v):
    col, kind = v.col, v.type
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        col, kind = F.flatten(col), kind.elementType
    return Value(col, kind)


def _to_json(v):
    if isinstance(v.type, (T.StructType, T.MapType, T.ArrayType)):
        return Value(F.to_json(v.col), STRING)
    one = F.to_json(F.array(v.col))
    return Value(F.substring(one, F.lit(2), F.length(one) - 2), STRING)


_SCALARS = {
    "apoc.create.uuid": lambda: Value(F.expr("uuid()"), STRING),
    "apoc.text.join": _join,
    "apoc.convert.tojson": _to_json,
    "apoc.convert.fromjsonmap": lambda v: Value(F.parse_json(v.col), T.VariantType()),
    "apoc.convert.fromjsonlist": lambda v: Value(F.parse_json(v.col), T.VariantType()),
    "apoc.map.frompairs": _from_pairs,
    "apoc.map.merge": _merge,
    "apoc.coll.flatten": _flatten,
}
