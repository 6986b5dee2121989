"""Compiles expressions of the syntax tree to typed columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..functions import scalar
from .values import Local, NodeRef, PathRef, RelRef, SemanticError, Value, common_type, is_element, is_float, is_int, is_null, is_number, is_string

AGGREGATES = frozenset(("count", "collect", "sum", "avg", "min", "max"))
BOOL, LONG, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def walk(e: Any):
    """All expressions within a tree, itself first."""
    if isinstance(e, A.Expr):
        yield e
    if isinstance(e, (list, tuple)):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            yield from walk(getattr(e, f))


def is_aggregate(e: A.Expr) -> bool:
    return isinstance(e, A.Call) and e.name in AGGREGATES


def has_aggregate(e: A.Expr) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


class Expressions:
    """Expressions over the variables of one scope.

    Booleans are two-valued: what is returned never is null. In filters, where null
    and false are one, the plain form is used, which Catalyst can push down.
    """

    def __init__(self, scope: dict, params: dict, known: dict | None = None, lenient: bool = False):
        self.scope, self.params, self.known, self.lenient = scope, params, known or {}, lenient

    def inner(self, name: str, col: Column, kind: T.DataType) -> Expressions:
        return Expressions({**self.scope, name: Local(col, kind)}, self.params, self.known, self.lenient)

    # -- conditions
    def condition(self, e: A.Expr, exact: bool = False) -> Column:
        """A boolean column; unless ``exact``, null may stand for false."""
        if e in self.known:
            return self.truth(self.known[e], exact)
        if isinstance(e, A.Binary):
            if e.op == "AND":
                return self.condition(e.left, exact) & self.condition(e.right, exact)
            if e.op == "OR":
                return self.condition(e.left, exact) | self.condition(e.right, exact)
            if e.op == "XOR":
                return self.condition(e.left, True) != self.condition(e.right, True)
            if e.op in ("=", "<>", "<", "<=", ">", ">="):
                return self.compare(e.op, e.left, e.right, exact)
        if isinstance(e, A.Unary):
            if e.op == "NOT":
                return ~self.condition(e.of, True)
            if e.op == "IS NULL":
                return self.value(e.of).col.isNull()
            if e.op == "IS NOT NULL":
                return self.value(e.of).col.isNotNull()
        return self.truth(self.value(e), exact)

    def truth(self, v: Value, exact: bool) -> Column:
        t = v.type
        if is_null(t):
            return F.lit(False)
        if isinstance(t, T.BooleanType):
            out = v.col
        elif is_number(t):
            out = v.col != 0
        elif is_string(t):
            out = v.col != ""
        elif isinstance(t, (T.ArrayType, T.MapType)):
            out = F.size(v.col) > 0
        else:
            return v.col.isNotNull()
        return F.coalesce(out, F.lit(False)) if exact and v.maybe_null else out

    def compare(self, op: str, left: A.Expr, right: A.Expr, exact: bool) -> Column:
        a, b = self.value(left), self.value(right)
        if op in ("=", "<>"):
            plain = op == "=" and not exact and any(isinstance(x, (A.Lit, A.Param)) for x in (left, right)) and not (is_null(a.type) or is_null(b.type))
            same = self.equal(a, b, plain)
            return same if op == "=" else ~same
        x, y = self.comparable(a, b)
        if x is None:
            return F.lit(False)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return F.coalesce(out, F.lit(False)) if exact else out

    def comparable(self, a: Value, b: Value) -> tuple[Column | None, Column | None]:
        if is_number(a.type) and is_number(b.type) or is_string(a.type) and is_string(b.type):
            return a.col, b.col
        times = (T.TimestampType, T.TimestampNTZType, T.DateType)
        if isinstance(a.type, times) and (isinstance(b.type, times) or is_string(b.type)):
            return a.col, b.col.cast(a.type)
        if isinstance(b.type, times) and is_string(a.type):
            return a.col.cast(b.type), b.col
        return None, None

    def equal(self, a: Value, b: Value, plain: bool = False) -> Column:
        if is_null(a.type):
            return b.col.isNull()
        if is_null(b.type):
            return a.col.isNull()
        if is_element(a.type) and is_element(b.type):
            return a.col["_id"].eqNullSafe(b.col["_id"])
        x, y = a.col, b.col
        if a.type != b.type and not (is_number(a.type) and is_number(b.type)):
            x, y = self.comparable(a, b)
            if x is None:
                both = isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType)
                if not both:
                    return F.lit(False)
                kind = common_type([a.type, b.type])
                x, y = a.col.cast(kind), b.col.cast(kind)
        return x == y if plain else x.eqNullSafe(y)

    # -- values
    def value(self, e: A.Expr) -> Value:
        if e in self.known:
            return self.known[e]
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def literal(self, v: Any) -> Value:
        if v is None:
            return Value(F.lit(None), T.NullType())
        if isinstance(v, bool):
            return Value(F.lit(v), BOOL, False)
        if isinstance(v, int):
            return Value(F.lit(v).cast("long"), LONG, False)
        if isinstance(v, float):
            return Value(F.lit(v), DOUBLE, False)
        if isinstance(v, str):
            return Value(F.lit(v), STRING, False)
        if isinstance(v, (list, tuple)):
            return self.array([self.literal(x) for x in v])
        if isinstance(v, dict):
            return self.struct([(k, self.literal(x)) for k, x in v.items()])
        raise SemanticError(f"no such value here: {type(v).__name__}")

    def array(self, vs: list[Value]) -> Value:
        if not vs:
            return Value(F.array().cast("array<string>"), T.ArrayType(STRING), False)
        kind = common_type([v.type for v in vs])
        if is_null(kind):
            kind = STRING
        cols = [v.col if v.type == kind else scalar.text_of(v) if is_string(kind) else v.col.cast(kind) for v in vs]
        return Value(F.array(*cols), T.ArrayType(kind), False)

    def struct(self, items: list[tuple[str, Value]]) -> Value:
        if not items:
            return Value(F.create_map().cast("map<string,string>"), T.MapType(STRING, STRING), False)
        items = [(k, Value(v.col.cast("string"), STRING) if is_null(v.type) else v) for k, v in items]
        return Value(F.struct(*[v.col.alias(k) for k, v in items]), T.StructType([T.StructField(k, v.type) for k, v in items]), False)

    def _lit(self, e: A.Lit) -> Value:
        return self.literal(e.value)

    def _param(self, e: A.Param) -> Value:
        if e.name not in self.params:
            raise SemanticError(f"the parameter ${e.name} has no value")
        return self.literal(self.params[e.name])

    def _var(self, e: A.Var) -> Value:
        if e.name not in self.scope:
            raise SemanticError(f"the variable {e.name} is not bound")
        found = self.scope[e.name]
        if isinstance(found, (NodeRef, RelRef)):
            return Value(found.struct(), found.struct_type())
        if isinstance(found, PathRef):
            return self.path(found)
        return Value(found.col, found.type, getattr(found, "maybe_null", True))

    def path(self, p: PathRef) -> Value:
        """A path as a list of its elements: id and label or type."""
        kind = T.StructType([T.StructField("_id", STRING), T.StructField("kind", STRING)])
        parts = []
        for x in p.elements:
            if isinstance(x, NodeRef):
                parts.append(F.array(F.struct(x.id().cast("string").alias("_id"), F.try_element_at(x.labels(), F.lit(1)).alias("kind"))))
            elif isinstance(x, RelRef):
                parts.append(F.array(F.struct(x.id().cast("string").alias("_id"), x.rel_type().alias("kind"))))
            else:
                parts.append(F.transform(x.col, lambda r: F.struct(r["_id"].cast("string").alias("_id"), r["_type"].alias("kind"))))
        return Value(F.concat(*parts) if parts else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind))

    def _prop(self, e: A.Prop) -> Value:
        if isinstance(e.base, A.Var):
            found = self.scope.get(e.base.name)
            if isinstance(found, (NodeRef, RelRef)):
                if e.key in found.props:
                    return Value(found.prop(e.key), found.props[e.key])
                return Value(F.lit(None), T.NullType())
        base = self.value(e.base)
        if is_null(base.type):
            return base
        if isinstance(base.type, T.StructType):
            if e.key in base.type.names:
                return Value(base.col[e.key], base.type[e.key].dataType)
            return Value(F.lit(None), T.NullType())
        if isinstance(base.type, T.MapType):
            return Value(F.try_element_at(base.col, F.lit(e.key)), base.type.valueType)
        if isinstance(base.type, T.VariantType):
            return Value(F.try_variant_get(base.col, f"$.{e.key}", "string"), STRING)
        raise SemanticError(f"no property of a {base.type.simpleString()}")

    def _index(self, e: A.Index) -> Value:
        base, at = self.value(e.base), self.value(e.at)
        if is_null(base.type):
            return base
        if isinstance(base.type, T.ArrayType):
            i = at.col.cast("int")
            return Value(F.get(base.col, F.when(i < 0, F.size(base.col) + i).otherwise(i)), base.type.elementType)
        if isinstance(base.type, T.MapType):
            return Value(F.try_element_at(base.col, at.col), base.type.valueType)
        if isinstance(base.type, T.StructType) and isinstance(e.at, A.Lit):
            return self._prop(A.Prop(e.base, str(e.at.value)))
        raise SemanticError(f"no element of a {base.type.simpleString()}")

    def _slice(self, e: A.Slice) -> Value:
        base = self.value(e.base)
        n = F.size(base.col)

        def place(x, default):
            if x is None:
                return default
            c = self.value(x).col.cast("int")
            return F.greatest(F.least(F.when(c < 0, n + c).otherwise(c), n), F.lit(0))

        low, high = place(e.low, F.lit(0)), place(e.high, n)
        return Value(F.slice(base.col, low + 1, F.greatest(high - low, F.lit(0))), base.type)

    def _listof(self, e: A.ListOf) -> Value:
        return self.array([self.value(x) for x in e.items])

    def _mapof(self, e: A.MapOf) -> Value:
        return self.struct([(k, self.value(x)) for k, x in e.items])

    def _mapprojection(self, e: A.MapProjection) -> Value:
        found = self.scope.get(e.var)
        items: list[tuple[str, Value]] = []
        for i in e.items:
            if i[0] == "prop":
                items.append((i[1], self._prop(A.Prop(A.Var(e.var), i[1]))))
            elif i[0] == "all":
                names = list(found.props) if isinstance(found, (NodeRef, RelRef)) else [n for n in self._var(A.Var(e.var)).type.names if not n.startswith("_")]
                items += [(k, self._prop(A.Prop(A.Var(e.var), k))) for k in names]
            elif i[0] == "pair":
                items.append((i[1], self.value(i[2])))
            else:
                items.append((i[1], self._var(A.Var(i[1]))))
        return self.struct(list(dict(items).items()))

    def _binary(self, e: A.Binary) -> Value:
        op = e.op
        if op in ("AND", "OR", "XOR", "=", "<>", "<", "<=", ">", ">="):
            return Value(self.condition(e, True), BOOL, False)
        a, b = self.value(e.left), self.value(e.right)
        if op == "IN":
            return self.member(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            if is_null(a.type) or is_null(b.type):
                return Value(F.lit(None).cast("boolean"), BOOL)
            if not is_string(a.type) or not is_string(b.type):
                return Value(F.lit(False), BOOL, False)
            test = {"STARTS WITH": a.col.startswith, "ENDS WITH": a.col.endswith, "CONTAINS": a.col.contains}
            return Value(test[op](b.col) if op in test else F.regexp_like(a.col, b.col), BOOL)
        if op == "+":
            if is_number(a.type) and is_number(b.type):
                return Value(a.col + b.col, DOUBLE if is_float(a.type) or is_float(b.type) else LONG)
            if is_string(a.type) and is_string(b.type):
                return Value(F.concat(a.col, b.col), STRING)
            if isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType):
                kind = common_type([a.type, b.type])
                return Value(F.concat(a.col.cast(kind), b.col.cast(kind)), kind)
            if is_null(a.type) or is_null(b.type):
                other = b if is_null(a.type) else a
                return Value(F.lit(None).cast(other.type) if not is_null(other.type) else F.lit(None), other.type)
            raise SemanticError(f"no sum of {a.type.simpleString()} and {b.type.simpleString()}")
        for v in (a, b):
            if not is_number(v.type) and not is_null(v.type):
                raise SemanticError(f"{op} needs numbers")
        x, y = a.col, b.col
        whole = not is_float(a.type) and not is_float(b.type)
        if op == "-":
            return Value(x - y, LONG if whole else DOUBLE)
        if op == "*":
            return Value(x * y, LONG if whole else DOUBLE)
        if op == "/":
            if whole:
                zero = F.raise_error(F.lit("division by zero")).cast("long")
                return Value(F.when(y == 0, zero).otherwise(F.call_function("div", x.cast("long"), F.nullif(y.cast("long"), F.lit(0).cast("long")))), LONG)
            x, y = x.cast("double"), y.cast("double")
            edge = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
            return Value(F.when(y == 0, edge).otherwise(F.try_divide(x, y)), DOUBLE)
        return Value(x % y, LONG if whole else DOUBLE)

    def member(self, a: Value, b: Value) -> Value:
        if is_null(b.type):
            return Value(F.lit(None).cast("boolean"), BOOL)
        if not isinstance(b.type, T.ArrayType):
            raise SemanticError("IN needs a list")
        kind = b.type.elementType
        return Value(F.exists(b.col, lambda x: self.equal(Value(x, kind), a)), BOOL)

    def _unary(self, e: A.Unary) -> Value:
        if e.op == "-":
            v = self.value(e.of)
            if not is_number(v.type) and not is_null(v.type):
                raise SemanticError("- needs a number")
            return Value(-v.col, LONG if is_int(v.type) else v.type)
        return Value(self.condition(e, True), BOOL, False)

    def _haslabel(self, e: A.HasLabel) -> Value:
        v = self.value(e.of)
        out = F.lit(True)
        for label in e.labels:
            out = out & F.array_contains(v.col["_labels"], label)
        return Value(F.coalesce(out, F.lit(False)), BOOL, False)

    def _case(self, e: A.Case) -> Value:
        tests = []
        subject = self.value(e.subject) if e.subject is not None else None
        for when, then in e.branches:
            test = self.condition(when) if subject is None else self.equal(subject, self.value(when))
            tests.append((test, self.value(then)))
        default = self.value(e.default) if e.default is not None else Value(F.lit(None), T.NullType())
        kind = common_type([v.type for _, v in tests] + [default.type])

        def fit(v: Value) -> Column:
            if v.type == kind or is_null(kind):
                return v.col
            return scalar.text_of(v) if is_string(kind) else v.col.cast(kind)

        out = F.when(tests[0][0], fit(tests[0][1]))
        for test, v in tests[1:]:
            out = out.when(test, fit(v))
        return Value(out.otherwise(fit(default)), kind)

    def _lambda(self, var: str, kind: T.DataType, f: Callable[[Expressions], Any]):
        return lambda x: f(self.inner(var, x, kind))

    def _comprehension(self, e: A.Comprehension) -> Value:
        source = self.value(e.source)
        if is_null(source.type):
            return Value(F.lit(None), T.NullType())
        kind = source.type.elementType
        col = source.col
        if e.where is not None:
            col = F.filter(col, self._lambda(e.var, kind, lambda s: s.condition(e.where, True)))
        if e.body is None:
            return Value(col, source.type)
        found: list[T.DataType] = []

        def body(s: Expressions) -> Column:
            v = s.value(e.body)
            found.append(v.type)
            return v.col

        out = F.transform(col, self._lambda(e.var, kind, body))
        return Value(out, T.ArrayType(found[0]))

    def _quantifier(self, e: A.Quantifier) -> Value:
        source = self.value(e.source)
        if is_null(source.type):
            return Value(F.lit(None).cast("boolean"), BOOL)
        kind = source.type.elementType
        hits = F.size(F.filter(source.col, self._lambda(e.var, kind, lambda s: s.condition(e.where, True))))
        n = F.size(source.col)
        out = {"all": hits == n, "any": hits > 0, "none": hits == 0, "single": hits == 1}[e.kind]
        return Value(F.when(source.col.isNotNull(), out), BOOL)

    def _exists(self, e: A.Exists) -> Value:
        raise SemanticError("EXISTS is not possible in this place")

    def _call(self, e: A.Call) -> Value:
        if is_aggregate(e) and e.name != "count":
            raise SemanticError(f"{e.name} is not possible in this place")
        if e.name in ("nodes", "relationships") and isinstance(e.args[0], A.Var) and isinstance(self.scope.get(e.args[0].name), PathRef):
            kinds = NodeRef if e.name == "nodes" else (RelRef, Value, Local)
            return self.path(PathRef([x for x in self.scope[e.args[0].name].elements if isinstance(x, kinds)]))
        f = scalar.REGISTRY.get(e.name)
        if f is None:
            if self.lenient:
                return Value(F.lit(None), T.NullType())
            raise SemanticError(f"no function {e.name}")
        args = [self.value(x) for x in e.args]
        try:
            return f(*args)
        except TypeError as error:
            raise SemanticError(f"wrong arguments for {e.name}: {error}") from error

    # -- aggregates
    def aggregate(self, e: A.Call, weight=None) -> Value:
        """An aggregate as a column for ``agg``; ``weight``: how many rows each row stands for."""
        if e.star:
            return Value(F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long")), LONG, False)
        v = self.value(e.args[0])
        c = v.col
        if e.name == "count":
            if is_element(v.type):
                c = c["_id"]
            if weight is not None and not e.distinct:
                return Value(F.coalesce(F.sum(F.when(c.isNotNull(), weight)), F.lit(0).cast("long")), LONG, False)
            return Value(F.count_distinct(c) if e.distinct else F.count(c), LONG, False)
        if e.name == "collect":
            kind = STRING if is_null(v.type) else v.type
            return Value(F.collect_set(c) if e.distinct else F.collect_list(c.cast(kind) if is_null(v.type) else c), T.ArrayType(kind), False)
        if e.name in ("sum", "avg"):
            if not is_number(v.type):
                return Value(F.lit(0).cast("long") if e.name == "sum" else F.lit(None).cast("double"), LONG if e.name == "sum" else DOUBLE)
            if e.name == "avg":
                return Value(F.avg(c), DOUBLE)
            kind = DOUBLE if is_float(v.type) else LONG
            total = F.sum_distinct(c) if e.distinct else F.sum(c)
            return Value(F.coalesce(total, F.lit(0)).cast(kind), kind, False)
        return Value(F.min(c) if e.name == "min" else F.max(c), v.type)
