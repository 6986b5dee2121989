"""Scalar functions of the query language as column expressions.

Each takes typed values and returns one; dispatch is on static types. Names are in
lower case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import SemanticError, Value, common_type, is_element, is_float, is_int, is_null, is_number, is_string

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
REGISTRY: dict[str, Callable[..., Value]] = {}


def _register(*names: str):
    def put(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def text_of(v: Value) -> Column:
    """Display form, null kept as null."""
    if is_string(v.type):
        return v.col
    if is_float(v.type):
        x = v.col.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(F.isnan(x), F.lit("NaN")).when(whole, F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))
    if isinstance(v.type, T.ArrayType):
        inner = F.transform(v.col, lambda x: F.coalesce(text_of(Value(x, v.type.elementType)), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if isinstance(v.type, T.StructType) or isinstance(v.type, T.MapType):
        return F.to_json(v.col)
    return v.col.cast("string")


def _string(v: Value, name: str) -> Column:
    if not is_string(v.type) and not is_null(v.type):
        raise SemanticError(f"{name} needs text")
    return v.col.cast("string")


def _number(v: Value, name: str) -> Column:
    if not is_number(v.type) and not is_null(v.type):
        raise SemanticError(f"{name} needs a number")
    return v.col


def _list(v: Value, name: str) -> Column:
    if not isinstance(v.type, T.ArrayType):
        raise SemanticError(f"{name} needs a list")
    return v.col


# -- graph elements
@_register("id")
def _id(v):
    if not is_element(v.type):
        raise SemanticError("id needs a node or relationship")
    return Value(v.col["_id"], v.type["_id"].dataType)


@_register("labels")
def _labels(v):
    if not is_element(v.type) or "_labels" not in v.type.names:
        raise SemanticError("labels needs a node")
    return Value(v.col["_labels"], T.ArrayType(STRING))


@_register("type")
def _type(v):
    if not is_element(v.type) or "_type" not in v.type.names:
        raise SemanticError("type needs a relationship")
    return Value(v.col["_type"], STRING)


def _own_keys(t: T.StructType) -> list[str]:
    return [n for n in t.names if not (is_element(t) and n in ("_id", "_labels", "_type", "_src", "_dst"))]


@_register("keys")
def _keys(v):
    if isinstance(v.type, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(STRING))
    if not isinstance(v.type, T.StructType):
        raise SemanticError("keys needs a node, relationship or map")
    names = _own_keys(v.type)
    if is_element(v.type):
        found = F.array_compact(F.array(*[F.when(v.col[n].isNotNull(), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    else:
        found = F.array(*[F.lit(n) for n in names])
    return Value(F.when(v.col.isNotNull(), found), T.ArrayType(STRING))


@_register("properties")
def _properties(v):
    if isinstance(v.type, T.MapType) or not is_element(v.type):
        return v
    names = _own_keys(v.type)
    return Value(F.when(v.col.isNotNull(), F.struct(*[v.col[n].alias(n) for n in names])), T.StructType([v.type[n] for n in names]))


@_register("exists")
def _exists(v):
    return Value(v.col.isNotNull(), BOOL, False)


@_register("shortestpath", "allshortestpaths")
def _no_path(*_):
    return Value(F.lit(None).cast("string"), STRING)


@_register("gds.util.nodepropertyname")
def _identity(v):
    return v


@_register("gds.util.asnode")
def _as_node(v):
    return v


@_register("gds.util.asnodes")
def _as_nodes(v):
    return v


for _n in ("adamicadar", "commonneighbors", "preferentialattachment", "resourceallocation", "totalneighbors", "samecommunity"):
    REGISTRY[f"gds.alpha.linkprediction.{_n}"] = lambda *_: Value(F.lit(None).cast("double"), DOUBLE)
for _n in ("adamic_adar", "common_neighbors", "preferential_attachment", "resource_allocation", "total_neighbors", "same_community"):
    REGISTRY[_n] = lambda *_: Value(F.lit(None).cast("double"), DOUBLE)


# -- lists
@_register("size")
def _size(v):
    if isinstance(v.type, T.ArrayType):
        return Value(F.size(v.col).cast("long"), LONG)
    if isinstance(v.type, T.MapType):
        return Value(F.size(v.col).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        return Value(F.lit(len(_own_keys(v.type))).cast("long"), LONG)
    return Value(F.octet_length(_string(v, "size")).cast("long"), LONG)


@_register("length")
def _length(v):
    if isinstance(v.type, T.ArrayType):
        return Value(F.when(v.col.isNotNull(), F.size(v.col).cast("long")), LONG)
    return Value(F.length(_string(v, "length")).cast("long"), LONG)


@_register("head")
def _head(v):
    return Value(F.try_element_at(_list(v, "head"), F.lit(1)), v.type.elementType)


@_register("last")
def _last(v):
    return Value(F.try_element_at(_list(v, "last"), F.lit(-1)), v.type.elementType)


@_register("tail")
def _tail(v):
    c = _list(v, "tail")
    return Value(F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(0))), v.type)


@_register("range")
def _range(a, b, step=None):
    lo, hi = a.col.cast("long"), b.col.cast("long")
    by = F.lit(1).cast("long") if step is None else step.col.cast("long")
    empty = F.array().cast("array<long>")
    wrong = ((by > 0) & (lo > hi)) | ((by < 0) & (lo < hi))
    zero = F.raise_error(F.lit("range: the step is zero")).cast("array<long>")
    out = F.when(by == 0, zero).when(wrong, empty).otherwise(F.sequence(lo, hi, by))
    return Value(out, T.ArrayType(LONG))


@_register("reverse")
def _reverse(v):
    if isinstance(v.type, T.ArrayType):
        return Value(F.reverse(v.col), v.type)
    return Value(F.reverse(_string(v, "reverse")), STRING)


@_register("coalesce")
def _coalesce(*vs):
    kind = common_type([v.type for v in vs])
    return Value(F.coalesce(*[text_of(v) if is_string(kind) else v.col.cast(kind) if not isinstance(kind, T.StructType) else v.col for v in vs]), kind)


# -- text
@_register("tostring", "tostr")
def _to_string(v):
    return Value(F.coalesce(text_of(v), F.lit("null")), STRING, False)


@_register("tolower", "lower")
def _lower(v):
    return Value(F.lower(_string(v, "toLower")), STRING)


@_register("toupper", "upper")
def _upper(v):
    return Value(F.upper(_string(v, "toUpper")), STRING)


@_register("substring")
def _substring(s, start, size=None):
    c, a = _string(s, "substring"), F.greatest(start.col.cast("int"), F.lit(0))
    return Value(F.substring(c, a + 1, F.length(c) if size is None else F.greatest(size.col.cast("int"), F.lit(0))), STRING)


_WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@_register("trim")
def _trim(v):
    return Value(F.regexp_replace(_string(v, "trim"), f"^{_WHITE}|{_WHITE}\\z", ""), STRING)


@_register("ltrim")
def _ltrim(v):
    return Value(F.regexp_replace(_string(v, "lTrim"), f"^{_WHITE}", ""), STRING)


@_register("rtrim")
def _rtrim(v):
    return Value(F.regexp_replace(_string(v, "rTrim"), f"{_WHITE}\\z", ""), STRING)


@_register("replace")
def _replace(s, old, new):
    return Value(F.replace(_string(s, "replace"), _string(old, "replace"), _string(new, "replace")), STRING)


@_register("left")
def _left(s, n):
    return Value(F.substring(_string(s, "left"), F.lit(1), F.greatest(n.col.cast("int"), F.lit(0))), STRING)


@_register("right")
def _right(s, n):
    c, k = _string(s, "right"), F.greatest(n.col.cast("int"), F.lit(0))
    return Value(F.substring(c, F.greatest(F.length(c) - k, F.lit(0)) + 1, k), STRING)


@_register("split")
def _split(s, by):
    quoted = F.concat(F.lit("\\Q"), F.replace(_string(by, "split"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Value(F.split(_string(s, "split"), quoted, -1), T.ArrayType(STRING))


def _padded(s, n, fill, left):
    c, width = _string(s, "pad"), n.col.cast("int")
    one = F.lit(" ") if fill is None else F.substring(_string(fill, "pad"), F.lit(1), F.lit(1))
    pad = F.repeat(one, F.greatest(width - F.octet_length(c), F.lit(0)))
    return Value(F.concat(pad, c) if left else F.concat(c, pad), STRING)


@_register("lpad")
def _lpad(s, n, fill=None):
    return _padded(s, n, fill, True)


@_register("rpad")
def _rpad(s, n, fill=None):
    return _padded(s, n, fill, False)


# -- conversion
@_register("tointeger", "toint")
def _to_integer(v):
    if is_float(v.type):
        x = v.col.cast("double")
        top = F.lit(9223372036854775807).cast("long")
        out = F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= 9.223372036854775e18, top).when(x <= -9.223372036854775e18, F.lit(-9223372036854775807).cast("long") - 1)
        return Value(out.otherwise(x.cast("long")), LONG)
    return Value(v.col.cast("long"), LONG)


@_register("tofloat")
def _to_float(v):
    return Value(v.col.cast("double"), DOUBLE)


@_register("toboolean")
def _to_boolean(v):
    if isinstance(v.type, T.BooleanType):
        return v
    if is_int(v.type):
        return Value(v.col != 0, BOOL)
    if is_string(v.type):
        low = F.lower(v.col)
        return Value(F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)), BOOL)
    return Value(F.lit(None).cast("boolean"), BOOL)


# -- mathematics
@_register("abs")
def _abs(v):
    return Value(F.abs(_number(v, "abs")), v.type)


def _rounding(name, f):
    def g(v):
        if is_int(v.type):
            return v
        return Value(f(_number(v, name).cast("double")).cast("double"), DOUBLE)

    REGISTRY[name] = g


_rounding("ceil", lambda c: F.ceil(c))
_rounding("floor", lambda c: F.floor(c))
_rounding("round", lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5))


@_register("sign")
def _sign(v):
    return Value(F.signum(_number(v, "sign").cast("double")).cast(v.type if is_int(v.type) else DOUBLE), v.type if is_int(v.type) else DOUBLE)


def _real(name, f):
    REGISTRY[name] = lambda v: Value(f(_number(v, name).cast("double")), DOUBLE)


for _name, _f in {"sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "degrees": F.degrees, "radians": F.radians}.items():
    _real(_name, _f)


def _logarithm(f):
    def g(c):
        return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(c))

    return g


_real("log", _logarithm(F.ln))
_real("log10", _logarithm(F.log10))


@_register("atan2")
def _atan2(y, x):
    return Value(F.atan2(_number(y, "atan2").cast("double"), _number(x, "atan2").cast("double")), DOUBLE)


@_register("e")
def _e():
    return Value(F.e(), DOUBLE, False)


@_register("pi")
def _pi():
    return Value(F.pi(), DOUBLE, False)


@_register("rand")
def _rand():
    return Value(F.rand(), DOUBLE, False)


@_register("gds.util.nan")
def _nan():
    return Value(F.lit(float("nan")), DOUBLE, False)


@_register("gds.util.infinity")
def _infinity():
    return Value(F.lit(float("inf")), DOUBLE, False)


@_register("gds.util.isfinite")
def _is_finite(v):
    if not is_number(v.type):
        return Value(F.lit(False), BOOL, False)
    x = v.col.cast("double")
    return Value(F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)), BOOL, False)


@_register("gds.util.isinfinite")
def _is_infinite(v):
    return Value(~_is_finite(v).col, BOOL, False)


# -- time
@_register("timestamp")
def _timestamp():
    return Value(F.unix_millis(F.current_timestamp()), LONG, False)


@_register("date")
def _date(v=None):
    if v is not None:
        return v
    return Value(F.concat(F.lit("epoch+"), F.datediff(F.current_date(), F.lit("1970-01-01").cast("date")).cast("string"), F.lit("d")), STRING)


@_register("datetime", "localdatetime")
def _datetime(v=None):
    return _timestamp() if v is None else v


@_register("duration")
def _duration(v):
    return v


# -- similarity
def _reals(v: Value, cut: bool) -> Column:
    return F.transform(_list(v, "a vector function"), lambda x: x.cast("float").cast("double") if cut else x.cast("double"))


def _numeric(*vs: Value) -> bool:
    return all(isinstance(v.type, T.ArrayType) and is_number(v.type.elementType) for v in vs)


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and vectors of norm 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fine, F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


@_register("cosine_similarity")
def _cosine_similarity(a, b):
    if not _numeric(a, b):
        return Value(F.lit(None).cast("double"), DOUBLE)
    return Value(cosine(_reals(a, True), _reals(b, True)), DOUBLE)


@_register("cosine_distance", "gds.similarity.cosine")
def _cosine_distance(a, b):
    if not _numeric(a, b):
        return Value(F.lit(None).cast("double"), DOUBLE)
    return Value(1.0 - cosine(_reals(a, True), _reals(b, True)), DOUBLE)


@_register("euclidean_distance", "l2_distance", "gds.similarity.euclidean")
def _euclidean(a, b):
    if not _numeric(a, b):
        return Value(F.lit(None).cast("double"), DOUBLE)
    x, y = _reals(a, True), _reals(b, True)
    away = F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    return Value(F.when(F.size(x) == F.size(y), away).when(x.isNotNull() & y.isNotNull(), F.lit(1.7976931348623157e308)), DOUBLE)


def _sets(a: Value, b: Value):
    kind = common_type([a.type, b.type])
    x, y = a.col.cast(kind), b.col.cast(kind)
    return F.array_distinct(x), F.array_distinct(y)


@_register("jaccard", "gds.similarity.jaccard")
def _jaccard(a, b):
    x, y = _sets(a, b)
    union = F.size(F.array_union(x, y))
    return Value(F.when(union > 0, F.size(F.array_intersect(x, y)) / union).when(x.isNotNull() & y.isNotNull(), F.lit(0.0)), DOUBLE)


@_register("overlap", "gds.similarity.overlap")
def _overlap(a, b):
    x, y = _sets(a, b)
    least = F.least(F.size(x), F.size(y))
    return Value(F.when(least > 0, F.size(F.array_intersect(x, y)) / least).when(x.isNotNull() & y.isNotNull(), F.lit(0.0)), DOUBLE)


@_register("pearson", "gds.similarity.pearson")
def _pearson(a, b):
    if not _numeric(a, b):
        return Value(F.lit(None).cast("double"), DOUBLE)
    x, y = _reals(a, False), _reals(b, False)
    n = F.size(x)
    mx, my = _sum(x) / n, _sum(y) / n
    both = _sum(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)))
    vx, vy = _sum(F.transform(x, lambda p: (p - mx) * (p - mx))), _sum(F.transform(y, lambda q: (q - my) * (q - my)))
    fine = (F.size(x) == F.size(y)) & (n > 0)
    return Value(F.when(fine, F.when((vx > 0) & (vy > 0), both / F.sqrt(vx * vy)).otherwise(F.lit(0.0))), DOUBLE)


# -- aggregates in a scalar place
@_register("count")
def _count(v):
    return Value(F.when(v.col.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"), LONG, False)


REGISTRY["count_distinct"] = _count
