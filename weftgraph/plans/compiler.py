"""Compiles clauses to DataFrame operations."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..sources.durable import cut
from .expressions import Expressions, conjuncts, has_aggregate, is_aggregate, walk
from .graph import PropertyGraph
from .patterns import Matcher
from .values import NodeRef, PathRef, RelRef, SemanticError, Value


def default_name(e: A.Expr) -> str:
    """The column name of an item without an alias."""
    if isinstance(e, A.Var):
        return e.name
    if isinstance(e, A.Prop) and isinstance(e.base, A.Var):
        return f"{e.base.name}.{e.key}"
    if isinstance(e, A.Call):
        if e.star:
            return f"{e.name}(*)"
        return f"{e.name}({default_name(e.args[0]) if e.args else ''})"
    return "value"


def variables(x: Any) -> Counter:
    """How often each variable is named in clauses, patterns and expressions."""
    out: Counter = Counter()
    todo = [x]
    while todo:
        y = todo.pop()
        if isinstance(y, A.Var):
            out[y.name] += 1
        elif isinstance(y, (A.NodePattern, A.RelPattern)):
            if y.var:
                out[y.var] += 1
            todo.append(y.props)
        elif isinstance(y, (list, tuple)):
            todo.extend(y)
        elif hasattr(y, "__dataclass_fields__"):
            if isinstance(y, A.Pattern) and y.name:
                out.update({n.var: 1 for n in [*y.nodes, *y.rels] if n.var})
            if isinstance(y, A.MapProjection):
                out[y.var] += 2
            if isinstance(y, A.Projection) and y.star:
                out["*"] += 1
            if isinstance(y, A.Delete):
                out.update(y.names)
            if isinstance(y, (A.SetItems, A.Remove)):
                out.update(i[1] for i in y.items)
            todo.extend(getattr(y, f) for f in y.__dataclass_fields__)
    return out


class Rows:
    """A DataFrame with the variables that its columns bind; ``df`` is None for the one empty row."""

    def __init__(self, df: DataFrame | None, scope: dict):
        self.df, self.scope = df, scope


class Compiler:
    """One statement over one graph.

    ``keys`` are columns that go along with every row and by which aggregates are
    grouped too (the row numbers of outer rows inside CALL).
    """

    def __init__(self, graph: PropertyGraph, params: dict | None = None, security=None, trust: bool = False, lenient: bool = False, writer=None, legacy_star: bool = False):
        self.graph, self.params, self.security = graph, params or {}, security
        self.trust, self.lenient, self.writer, self.legacy_star = trust, lenient, writer, legacy_star
        self.used: Counter = Counter()
        self.keys: list[str] = []
        self.frames: list[DataFrame] = []
        self.after: dict[int, A.Clause] = {}

    @property
    def spark(self):
        return self.graph.spark

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select()

    def matcher(self) -> Matcher:
        used = self.used if not self.used["*"] else Counter({k: 9 for k in self.used})
        return Matcher(self.graph, self.expressions, used, self.security, self.trust)

    def expressions(self, scope: dict, known: dict | None = None) -> Expressions:
        return Expressions(scope, self.params, known, self.lenient)

    # -- statements
    def statement(self, s: A.Statement) -> DataFrame:
        self.used = variables(s.parts)
        frames = [self.part(p) for p in s.parts]
        out = frames[0]
        for df, every in zip(frames[1:], s.all_flags):
            if df.columns != out.columns:
                df = df.toDF(*out.columns)
            out = out.unionByName(df)
            if not every:
                out = out.distinct()
        return out

    def part(self, clauses: list[A.Clause]) -> DataFrame:
        rows = Rows(None, {})
        self.after.update({id(c): d for c, d in zip(clauses, clauses[1:])})
        for c in clauses:
            rows = self.clause(c, rows)
        if not clauses or not (isinstance(clauses[-1], A.Projection) and clauses[-1].kind == "RETURN"):
            if isinstance(clauses[-1], A.Procedure) or (isinstance(clauses[-1], A.Catalog) and clauses[-1].action.startswith("show")):
                return self.output(rows)
            df = rows.df if rows.df is not None else self.one_row()
            return df.select().limit(0)
        return self.output(rows)

    def output(self, rows: Rows) -> DataFrame:
        x = self.expressions(rows.scope)
        df = rows.df if rows.df is not None else self.one_row()
        return df.select(*[x.value(A.Var(name)).col.alias(name) for name in rows.scope])

    def clause(self, c: A.Clause, rows: Rows) -> Rows:
        return getattr(self, "_" + type(c).__name__.lower())(c, rows)

    # -- matching
    def _match(self, c: A.Match, rows: Rows) -> Rows:
        if self.legacy_star:
            for p in c.patterns:
                for r in p.rels:
                    if r.star:
                        r.many, r.star = False, False
        if c.optional:
            return self.optional(c, rows)
        df, scope = rows.df, rows.scope
        m = self.matcher()
        if df is None and not scope and not self.used["*"]:
            whole = m.match_all(c.patterns, self.counted(c))
            if whole is not None:
                return self.where(Rows(*whole), c.where)
        # A pattern that shares a variable with what is bound comes before one that doesn't.
        todo = list(c.patterns)
        while todo:
            k = next((i for i, p in enumerate(todo) if any(n.var in scope for n in p.nodes if n.var)), 0)
            df, scope = m.match(df, scope, todo.pop(k))
        return self.where(Rows(df, scope), c.where)

    def counted(self, c: A.Match) -> dict[str, set | None] | None:
        """What the next clause needs of the variables, if it only counts rows: properties of each that it names (None: all of them).

        None where the number of equal rows has to stay as it is.
        """
        p = self.after.get(id(c))
        if not isinstance(p, A.Projection) or p.star:
            return None
        every = [c.where, p.where, [i.expr for i in p.items], [e for e, _ in p.order]]
        inside = list(walk(every))
        calls = [x for x in inside if is_aggregate(x)]
        if not any(has_aggregate(i.expr) for i in p.items) or any(isinstance(x, A.Exists) for x in inside):
            return None
        if not all(x.name in ("count", "min", "max") for x in calls):
            return None
        named = variables(every)
        needs: dict[str, set | None] = {v: set() for v in named}
        for x in inside:
            if isinstance(x, A.Prop) and isinstance(x.base, A.Var):
                needs[x.base.name].add(x.key)
                named[x.base.name] -= 1
            elif is_aggregate(x) and x.name == "count" and not x.star and isinstance(x.args[0], A.Var):
                named[x.args[0].name] -= 1
        return {v: props if named[v] <= 0 else None for v, props in needs.items()}

    def where(self, rows: Rows, e: A.Expr | None) -> Rows:
        for part in conjuncts(e):
            negated = isinstance(part, A.Unary) and part.op == "NOT" and isinstance(part.of, A.Exists)
            if isinstance(part, A.Exists) or negated:
                rows = self.semi(rows, part.of if negated else part, "left_anti" if negated else "left_semi")
                continue
            known, dropped = {}, []
            for x in walk(part):
                if isinstance(x, A.Exists) and x not in known:
                    rows, known[x], name = self.flag(rows, x)
                    dropped.append(name)
            df = rows.df if rows.df is not None else self.one_row()
            df = df.where(self.expressions(rows.scope, known).condition(part)).drop(*dropped)
            rows = Rows(df, rows.scope)
        return rows

    def correlated(self, rows: Rows, patterns, where) -> tuple[Rows, list[str]]:
        """The matches of patterns and condition for what ``rows`` bind, with the columns they depend on.

        Where one end of a single pattern is the only link to the rows, the matches
        are built from the relationships alone and joined on that node's id;
        otherwise they start from the distinct values that they depend on.
        """
        scope, m = rows.scope, self.matcher()
        named = variables([list(patterns), where])
        shared = [v for v in named if v in scope]
        p = patterns[0]
        ends = [n for n in (p.nodes[0], p.nodes[-1]) if n.var in scope]
        alone = (
            len(patterns) == 1 and len(shared) == 1 and len(ends) == 1 and len(p.rels) >= 1 and isinstance(scope[shared[0]], NodeRef)
            and not any(r.many for r in p.rels) and sum(n.var == shared[0] for n in p.nodes) == 1 and not ends[0].props
            and variables(where)[shared[0]] == 0 and not any(variables([n.props for n in p.nodes] + [r.props for r in p.rels])[shared[0]] for _ in [0])
        )
        if alone:
            v = shared[0]
            ref = scope[v]
            fixed = len(ref.tables) == 1 and (self.graph.nodes[ref.tables[0]].label is not None or not ends[0].labels)
            if fixed and all(self.graph.nodes[t].label == x for x in ends[0].labels for t in ref.tables):
                seed = {v: NodeRef(v, {}, ref.id_type, ref.tables)}
                tables, _ = m.candidates(p, {v: ref})
                if ref.tables[0] in tables[0 if p.nodes[0].var == v else -1]:
                    df, inner = _bare_match(m, p, v, seed)
                    found = self.where(Rows(df, inner), where)
                    return found, [f"{v}.@id"]
        needs: list[str] = []
        for v in shared:
            ref = scope[v]
            if isinstance(ref, (NodeRef, RelRef)):
                needs += ref.columns()
            elif isinstance(ref, Value):
                needs.append(v)
            else:
                raise SemanticError("a path can't be used in a sub-pattern")
        keys = rows.df.select(*[F.col(f"`{n}`") for n in needs]).distinct() if needs else None
        df, inner = keys, {v: scope[v] for v in shared}
        for q in patterns:
            df, inner = m.match(df, inner, q)
        return self.where(Rows(df, inner), where), needs

    def _on(self, left: DataFrame, found: DataFrame, needs: list[str]) -> tuple[DataFrame, Any]:
        """``found`` with renamed key columns, and the condition that joins it to ``left``."""
        cond = F.lit(True)
        for k, n in enumerate(needs):
            found = found.withColumnRenamed(n, f"@key{k}:{n}")
            a, b = F.col(f"`{n}`"), F.col(f"`@key{k}:{n}`")
            same = a == b if n.endswith("@id") else a.eqNullSafe(b)
            cond = same if k == 0 else cond & same
        return found, cond

    def semi(self, rows: Rows, e: A.Exists, how: str) -> Rows:
        found, needs = self.correlated(rows, list(e.patterns), e.where)
        right = found.df.select(*[F.col(f"`{n}`") for n in needs]) if needs else found.df.select(F.lit(1).alias("@one")).limit(1)
        right, cond = self._on(rows.df, right, needs)
        return Rows(rows.df.join(right, cond, how), rows.scope)

    def flag(self, rows: Rows, e: A.Exists) -> tuple[Rows, Value, str]:
        found, needs = self.correlated(rows, list(e.patterns), e.where)
        name = f"@flag{len(rows.df.columns)}"
        right = (found.df.select(*[F.col(f"`{n}`") for n in needs]).distinct() if needs else found.df.select().limit(1)).withColumn(name, F.lit(True))
        right, cond = self._on(rows.df, right, needs)
        keyed = [c for c in right.columns if c.startswith("@key")]
        df = rows.df.join(right, cond, "left").drop(*keyed)
        return Rows(df, rows.scope), Value(F.coalesce(F.col(f"`{name}`"), F.lit(False)), T.BooleanType(), False), name

    def optional(self, c: A.Match, rows: Rows) -> Rows:
        if rows.df is None:
            rows = Rows(self.one_row(), rows.scope)
        found, needs = self.correlated(rows, c.patterns, c.where)
        new = {k: v for k, v in found.scope.items() if k not in rows.scope}
        have = set(rows.df.columns)
        keep = [n for n in found.df.columns if n not in have]
        right = found.df.select(*[F.col(f"`{n}`") for n in [*needs, *keep]])
        right, cond = self._on(rows.df, right, needs)
        df = rows.df.join(right, cond, "left").drop(*[n for n in right.columns if n.startswith("@key")])
        return Rows(df, {**rows.scope, **new})

    # -- projection
    def _projection(self, c: A.Projection, rows: Rows) -> Rows:
        items = list(c.items)
        if c.star:
            items = [A.Item(A.Var(v), v) for v in rows.scope if not v.startswith("@")] + items
        named: dict[str, A.Expr] = {}
        for i in items:
            named[i.alias or default_name(i.expr)] = i.expr
        order = list(c.order)
        df = rows.df if rows.df is not None else self.one_row()
        rows = Rows(df, rows.scope)
        aggregated = any(has_aggregate(e) for e in named.values())
        known: dict[A.Expr, Value] = {}
        exists = {x for e in named.values() for x in walk(e) if isinstance(x, A.Exists)}
        for x in exists:
            rows, known[x], _ = self.flag(rows, x)
        if aggregated:
            out = self.aggregated(rows, named, order, known)
        else:
            out = self.projected(rows, named, order, c.distinct, known)
        df, scope, sort = out
        if c.distinct:
            df = df.select(*[F.col(f"`{n}`") for n in self.columns(scope)]).distinct()
        if order:
            df = df.orderBy(*sort)
        if c.skip is not None:
            df = df.offset(self.integer(c.skip))
        if c.limit is not None:
            n = self.integer(c.limit, None)
            df = df if n is None else df.limit(n)
        df = df.select(*[F.col(f"`{n}`") for n in [*self.keys, *self.columns(scope)]])
        return self.where(Rows(df, scope), c.where)

    def columns(self, scope: dict) -> list[str]:
        out: list[str] = []
        for name, ref in scope.items():
            if isinstance(ref, (NodeRef, RelRef)):
                out += ref.columns()
            elif isinstance(ref, PathRef):
                for x in ref.elements:
                    out += x.columns() if isinstance(x, (NodeRef, RelRef)) else [ref.extra] if ref.extra else []
            else:
                out.append(name)
        return list(dict.fromkeys(out))

    def renamed(self, ref, name: str, df_cols: list):
        """A bound element under another name: its columns and the new reference."""
        new = replace(ref, var=name)
        return [F.col(f"`{a}`").alias(b) for a, b in zip(ref.columns(), new.columns())], new

    def integer(self, e: A.Expr, default: int | None = 0) -> int | None:
        v = e.value if isinstance(e, A.Lit) else self.params.get(e.name) if isinstance(e, A.Param) else None
        if v is None and not isinstance(e, (A.Lit, A.Param)):
            found = self.spark.range(1).select(self.expressions({}).value(e).col).first()[0]
            v = found
        return v if isinstance(v, int) and not isinstance(v, bool) else default

    def projected(self, rows: Rows, named: dict, order: list, distinct: bool, known: dict):
        x = self.expressions(rows.scope, known)
        cols, scope, at = [F.col(f"`{k}`") for k in self.keys], {}, {}
        for name, e in named.items():
            ref = rows.scope.get(e.name) if isinstance(e, A.Var) else None
            if isinstance(ref, (NodeRef, RelRef)):
                more, new = self.renamed(ref, name, [])
                cols += more
                scope[name] = new
            else:
                v = x.value(e)
                col = v.col.cast("string") if isinstance(v.type, T.NullType) else v.col
                cols.append(col.alias(name))
                scope[name] = Value(F.col(f"`{name}`"), T.StringType() if isinstance(v.type, T.NullType) else v.type, v.maybe_null)
            at[e] = name
        sort = []
        new_scope = self.expressions(scope)
        mixed = self.expressions(rows.scope, {**known, **{A.Var(n): Value(x.value(e).col, x.value(e).type) for n, e in named.items() if n not in rows.scope}})
        for k, (e, down) in enumerate(order):
            if e in at or (isinstance(e, A.Var) and e.name in scope):
                v = new_scope.value(A.Var(at.get(e, e.name if isinstance(e, A.Var) else "")))
                col = v.col
            elif distinct:
                col = new_scope.value(e).col
            else:
                cols.append(mixed.value(e).col.alias(f"@order{k}"))
                col = F.col(f"`@order{k}`")
            sort.append(col.desc_nulls_last() if down else col.asc_nulls_first())
        return rows.df.select(*cols), scope, sort

    def aggregated(self, rows: Rows, named: dict, order: list, known: dict):
        x = self.expressions(rows.scope, known)
        keys, scope, over = [F.col(f"`{k}`") for k in self.keys], {}, {}
        calls: dict[A.Expr, str] = {}
        for e in [*named.values(), *[o for o, _ in order]]:
            for y in walk(e):
                if is_aggregate(y) and y not in calls:
                    calls[y] = f"@agg{len(calls)}"
        for name, e in named.items():
            if has_aggregate(e):
                continue
            ref = rows.scope.get(e.name) if isinstance(e, A.Var) else None
            if isinstance(ref, (NodeRef, RelRef)):
                more, new = self.renamed(ref, name, [])
                keys += more
                scope[name] = new
                over[e] = Value(new.struct(), new.struct_type())
                for p in new.props:
                    over[A.Prop(e, p)] = Value(new.prop(p), new.props[p])
            else:
                v = x.value(e)
                kind = T.StringType() if isinstance(v.type, T.NullType) else v.type
                keys.append(v.col.cast(kind).alias(name) if isinstance(v.type, T.NullType) else v.col.alias(name))
                scope[name] = over[e] = Value(F.col(f"`{name}`"), kind, v.maybe_null)
                over.setdefault(A.Var(name), scope[name])
        aggs = []
        weight = F.col("`@weight`") if "@weight" in rows.df.columns else None
        for y, name in calls.items():
            v = x.aggregate(y, weight)
            aggs.append(v.col.alias(name))
            over[y] = Value(F.col(f"`{name}`"), v.type, v.maybe_null)
        df = rows.df.groupBy(*keys).agg(*aggs) if keys else rows.df.agg(*aggs)
        if self.keys and not scope:
            # An outer row without inner rows gets what aggregates give over nothing.
            name = self.keys[-1]
            df = self.frames[-1].join(df, name, "left")
            for y, agg in calls.items():
                nothing = F.lit(0) if y.name in ("count", "sum") else F.array().cast(over[y].type) if y.name == "collect" else None
                if nothing is not None:
                    df = df.withColumn(agg, F.coalesce(F.col(f"`{agg}`"), nothing.cast(over[y].type)))
        after = self.expressions({}, over)
        cols, out = [F.col(f"`{k}`") for k in self.keys], {}
        for name, e in named.items():
            if name in scope:
                ref = scope[name]
                out[name] = ref
                cols += [F.col(f"`{c}`") for c in (ref.columns() if isinstance(ref, (NodeRef, RelRef)) else [name])]
            else:
                v = after.value(e)
                cols.append(v.col.alias(name))
                out[name] = Value(F.col(f"`{name}`"), v.type, v.maybe_null)
                over.setdefault(A.Var(name), Value(v.col, v.type))
        sort = []
        for k, (e, down) in enumerate(order):
            if isinstance(e, A.Var) and e.name in out and not isinstance(out[e.name], (NodeRef, RelRef)):
                col = F.col(f"`{e.name}`")
            else:
                cols.append(after.value(e).col.alias(f"@order{k}"))
                col = F.col(f"`@order{k}`")
            sort.append(col.desc_nulls_last() if down else col.asc_nulls_first())
        return df.select(*cols), out, sort

    # -- lists, files, subqueries, procedures
    def _unwind(self, c: A.Unwind, rows: Rows) -> Rows:
        v = self.expressions(rows.scope).value(c.expr)
        df = rows.df if rows.df is not None else self.one_row()
        if isinstance(v.type, T.NullType):
            return Rows(df.withColumn(c.var, F.lit(None).cast("string")).where(F.lit(False)), {**rows.scope, c.var: Value(F.col(f"`{c.var}`"), T.StringType())})
        kind = v.type.elementType if isinstance(v.type, T.ArrayType) else v.type
        col = v.col if isinstance(v.type, T.ArrayType) else F.when(v.col.isNotNull(), F.array(v.col))
        return Rows(df.withColumn(c.var, F.explode(col)), {**rows.scope, c.var: Value(F.col(f"`{c.var}`"), kind)})

    def _loadcsv(self, c: A.LoadCsv, rows: Rows) -> Rows:
        """The expression is the text itself: lines at line feeds, fields at commas, all trimmed text."""
        v = self.expressions(rows.scope).value(c.source)
        df = rows.df if rows.df is not None else self.one_row()
        fields = lambda line: F.transform(F.split(line, ",", -1), lambda f: F.trim(f))
        lines = F.filter(F.split(v.col, "\r?\n", -1), lambda s: F.trim(s) != "")
        if not c.headers:
            kind = T.ArrayType(T.StringType())
            return Rows(df.withColumn(c.var, F.explode(F.transform(lines, fields))), {**rows.scope, c.var: Value(F.col(f"`{c.var}`"), kind)})
        head = fields(F.try_element_at(lines, F.lit(1)))

        def row(line):
            own = fields(line)
            filled = F.transform(head, lambda _, i: F.coalesce(F.get(own, i), F.lit("")))
            return F.map_from_arrays(head, filled)

        body = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0)))
        df = df.withColumn(c.var, F.explode(F.transform(body, row)))
        return Rows(df, {**rows.scope, c.var: Value(F.col(f"`{c.var}`"), T.MapType(T.StringType(), T.StringType()))})

    def _subquery(self, c: A.Subquery, rows: Rows) -> Rows:
        """CALL { }: the inner clauses for each outer row; aggregates are of that row alone."""
        if rows.df is None:
            inner = Rows(None, {})
            for x in c.query:
                inner = self.clause(x, inner)
            return inner
        name = f"@row{len(self.keys)}"
        outer, _ = cut(rows.df.withColumn(name, F.monotonically_increasing_id()))
        self.keys.append(name)
        self.frames.append(outer.select(F.col(f"`{name}`")))
        inner = Rows(outer, dict(rows.scope))
        for x in c.query:
            inner = self.clause(x, inner)
        self.keys.pop()
        self.frames.pop()
        new = {k: v for k, v in inner.scope.items() if k not in rows.scope}
        right = inner.df.select(F.col(f"`{name}`").alias("@match"), *[F.col(f"`{n}`") for n in self.columns(new)])
        df = outer.join(right, F.col(f"`{name}`") == F.col("@match")).drop("@match", name)
        return Rows(df, {**rows.scope, **new})

    def _procedure(self, c: A.Procedure, rows: Rows) -> Rows:
        from ..operators.procedures import call

        return call(self, c, rows)

    # -- writing
    def _write(self, c: A.Clause, rows: Rows) -> Rows:
        if self.writer is None:
            raise SemanticError("this session only reads")
        return self.writer.apply(self, c, rows)

    _create = _merge = _setitems = _remove = _delete = _foreach = _write

    def _catalog(self, c: A.Catalog, rows: Rows) -> Rows:
        from ..operators.catalog import apply

        return apply(self, c)


def _bare_match(m: Matcher, p: A.Pattern, v: str, seed: dict):
    """A pattern of which the node ``v`` is known by id only."""
    pattern = A.Pattern([A.NodePattern(n.var, [], []) if n.var == v else n for n in p.nodes], p.rels, p.name)
    pinned = Pinned(m, v, seed[v])
    return pinned.match(None, {}, pattern, {v})


class Pinned:
    """A matcher that keeps the tables of one outer node fixed."""

    def __init__(self, m: Matcher, v: str, ref: NodeRef):
        self.m, self.v, self.ref = m, v, ref

    def match(self, rows, scope, p, bare):
        original = self.m.candidates

        def narrowed(pattern, s):
            return original(pattern, {**s, self.v: self.ref})

        self.m.candidates = narrowed
        try:
            return self.m.match(rows, scope, p, bare)
        finally:
            self.m.candidates = original
