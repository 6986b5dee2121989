"""Graph patterns as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from .graph import PropertyGraph, property_type
from .values import NodeRef, PathRef, RelRef, SemanticError, Value

STRING = T.StringType()
LABELS = T.ArrayType(STRING)
#: Hops of a path without an upper bound; hops from which a frontier is written out and tested for rows.
MOST_HOPS, EAGER_HOPS = 10, 5


class Matcher:
    """Adds the matches of patterns to the rows of a scope.

    ``security`` gives a condition for every node that is scanned or reached.
    ``used`` counts how often a variable is named in the query; a node that nothing
    else names, behind relationships whose ends are known to exist, is not joined.
    """

    def __init__(self, graph: PropertyGraph, expressions, used: dict[str, int], security=None, trust: bool = False):
        self.graph, self.expressions, self.used = graph, expressions, used
        self.security, self.trust = security, trust
        self.hidden = 0
        #: How often patterns name a variable that has no properties there (once where it is not listed).
        self.quiet: dict[str, int] = {}

    def fresh(self, prefix: str) -> str:
        self.hidden += 1
        return f"@{prefix}{self.hidden}"

    # -- which tables a pattern can touch
    def candidates(self, p: A.Pattern, scope: dict) -> tuple[list[list[int]], list[list[int]]]:
        """Node and edge tables for each element, narrowed by how they fit together."""
        g = self.graph
        nodes = []
        for n in p.nodes:
            bound = scope.get(n.var) if n.var else None
            own = g.tables_for(n.labels)
            if isinstance(bound, NodeRef):
                own = [t for t in own if t in bound.tables]
            nodes.append(own)
        edges = [g.edge_tables_for(r.types) for r in p.rels]
        changed = True
        while changed:
            changed = False
            for k, r in enumerate(p.rels):
                if r.many:
                    continue
                left, right = nodes[k], nodes[k + 1]

                def ways(e: int):
                    if r.direction in ("out", "both"):
                        yield "src", "dst"
                    if r.direction in ("in", "both"):
                        yield "dst", "src"

                fit = [
                    e for e in edges[k]
                    if any(any(g.joins(e, a, s) for a in left) and any(g.joins(e, b, d) for b in right) for s, d in ways(e))
                ]
                new_left = [a for a in left if any(g.joins(e, a, s) and any(g.joins(e, b, d) for b in right) for e in fit for s, d in ways(e))]
                new_right = [b for b in right if any(g.joins(e, b, d) and any(g.joins(e, a, s) for a in left) for e in fit for s, d in ways(e))]
                if (fit, new_left, new_right) != (edges[k], left, right):
                    edges[k], nodes[k], nodes[k + 1] = fit, new_left, new_right
                    changed = True
        return nodes, edges

    # -- tables
    def scan(self, var: str, tables: list[int]) -> tuple[DataFrame, NodeRef]:
        g = self.graph
        frames = [g.nodes[i] for i in tables]
        names = list(dict.fromkeys(p for t in frames for p in t.props))
        props = {n: property_type([t.df for t in frames if n in t.props], n) for n in names}
        single = len(tables) == 1
        id_type = frames[0].df.schema["id"].dataType if single else STRING
        out = None
        for i, t in zip(tables, frames):
            cols = [(F.col("id") if single else g.global_id(i, F.col("id"))).alias(f"{var}.@id")]
            labels = F.col("labels") if t.label is None else F.array(F.lit(t.label))
            cols.append(labels.alias(f"{var}.@labels"))
            for n in names:
                c = F.col(f"`{n}`").cast(props[n]) if n in t.props else F.lit(None).cast(props[n])
                cols.append((F.col(f"`{n}`") if n in t.props and t.df.schema[n].dataType == props[n] else c).alias(f"{var}.{n}"))
            rows = t.df.select(*cols)
            out = rows if out is None else out.unionByName(rows)
        ref = NodeRef(var, props, id_type, tables)
        return out, ref

    def nodes(self, pattern: A.NodePattern, var: str, tables: list[int], scope: dict) -> tuple[DataFrame, NodeRef]:
        if not tables:
            tables = list(range(len(self.graph.nodes)))
            df, ref = self.scan(var, tables[:1] if len(tables) == 1 else tables)
            return df.where(F.lit(False)), ref
        df, ref = self.scan(var, tables)
        for label in pattern.labels:
            if any(self.graph.nodes[t].label is None for t in tables):
                df = df.where(F.array_contains(ref.labels(), label))
        if self.security is not None:
            df = df.where(self.security(ref))
        return df, ref

    def edges(self, var: str, tables: list[int], types: list[str], left: list[int] | None, right: list[int] | None, native: tuple[bool, bool], single: bool = True) -> tuple[DataFrame, RelRef]:
        """Edges as columns of ``var``, ends native or global; ``left``/``right``: node tables of src and dst.

        Ids are native for a ``single`` table; of several they name the table too, as its ids are its own.
        """
        g = self.graph
        frames = [g.edges[i] for i in tables]
        names = list(dict.fromkeys(p for t in frames for p in t.props))
        props = {n: property_type([t.df for t in frames if n in t.props], n) for n in names}
        out = None
        same_id = single and len(frames) == 1
        for t in frames:
            df = t.df
            if t.type is None and types:
                df = df.where(F.col("type").isin(*types))

            def end(side: str, whole: bool) -> Column:
                label = getattr(t, f"{side}_label")
                c = F.col(side)
                return c if whole else (c.cast("string") if label is None else F.concat(F.lit(label + ":"), c.cast("string")))

            cols = [
                (F.col("id") if same_id else F.concat(F.lit(f"{t.type or ''}:{t.src_label or ''}:"), F.col("id").cast("string"))).alias(f"{var}.@id"),
                (F.col("type") if t.type is None else F.lit(t.type)).alias(f"{var}.@type"),
                end("src", native[0]).alias(f"{var}.@src"),
                end("dst", native[1]).alias(f"{var}.@dst"),
            ]
            for n in names:
                cols.append((F.col(f"`{n}`").cast(props[n]) if n in t.props else F.lit(None).cast(props[n])).alias(f"{var}.{n}"))
            rows = df.select(*cols)
            out = rows if out is None else out.unionByName(rows)
        id_type = frames[0].df.schema["id"].dataType if frames and same_id else STRING
        ends = tuple(out.schema[f"{var}.@{s}"].dataType for s in ("src", "dst")) if out is not None else (STRING, STRING)
        return out, RelRef(var, props, id_type, ends)

    # -- all patterns of a first MATCH
    def match_all(self, patterns: list[A.Pattern], needs: dict[str, set | None] | None) -> tuple[DataFrame, dict] | None:
        """The matches of patterns that hang together, by hops in the order in which rows grow least.

        A hop whose both ends are bound comes first, then one that finds at most one
        relationship for each row, then the one of the others that finds the fewest by
        the tables' sizes; it starts where this leaves the fewest others, as late as can be. Rows that differ only in what neither a later hop
        nor ``needs`` (variables, and their properties or None for all) asks for are
        counted in a column ``@weight`` before a hop multiplies them.
        None where the order written has to stay.
        """
        hops = [(i, k) for i, p in enumerate(patterns) for k in range(len(p.rels))]
        rels = [r.var for p in patterns for r in p.rels if r.var]
        seen = {n.var for p in patterns for n in p.nodes if n.var}
        given = [e for p in patterns for x in [*p.nodes, *p.rels] for _, e in x.props]
        if not hops or any(r.many for p in patterns for r in p.rels) or len(set(rels)) < len(rels) or seen & set(rels):
            return None
        if any(isinstance(y, A.Var) for e in given for y in _walk(e)):
            return None
        names = [[n.var or self.fresh("n") for n in p.nodes] for p in patterns]
        rel_names = [[r.var or self.fresh("r") for r in p.rels] for p in patterns]
        tables: dict[str, list[int]] = {}
        while True:
            before = dict(tables)
            found = []
            for p, own in zip(patterns, names):
                scope = {n.var: NodeRef(n.var, {}, STRING, tables[n.var]) for n in p.nodes if n.var in tables}
                found.append(self.candidates(p, scope))
                for name, t in zip(own, found[-1][0]):
                    tables[name] = [x for x in t if x in tables.get(name, t)]
            if tables == before:
                break
        if not all(tables.values()) or not all(e for _, edges in found for e in edges):
            return None
        nodes = [[tables[n] for n in own] for own in names]
        edges = [e for _, e in found]

        def one(i: int, k: int, way: int) -> bool:
            """The hop finds one relationship at most for each row."""
            r = patterns[i].rels[k]
            if r.direction == "both" or len(edges[i][k]) != 1:
                return False
            return self.graph.edges[edges[i][k][0]].own == ("src" if (r.direction == "out") == (way == 1) else "dst")

        sizes: dict[tuple, int] = {}

        def fan(i: int, k: int, way: int) -> float:
            """About how many relationships the hop finds for a row."""
            near = k if way == 1 else k + 1
            for kind, own, of in (("n", nodes[i][near], self.graph.nodes), ("e", edges[i][k], self.graph.edges)):
                for t in own:
                    if (kind, t) not in sizes:
                        sizes[kind, t] = int(str(of[t].df.select("id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return sum(sizes["e", t] for t in edges[i][k]) / max(1, sum(sizes["n", t] for t in nodes[i][near]))

        def order(start: str):
            bound, todo, out, grows = {start}, list(hops), [], []
            while todo:
                ways = []
                for i, k in todo:
                    a, b = names[i][k], names[i][k + 1]
                    if a in bound or b in bound:
                        way = 1 if a in bound else -1
                        ways.append((0 if a in bound and b in bound else 1 if one(i, k, way) else 2, i, k, way))
                if not ways:
                    return None
                rank = min(w[0] for w in ways)
                ways = [w for w in ways if w[0] == rank]
                _, i, k, way = min(ways, key=lambda w: fan(*w[1:])) if rank == 2 and len(ways) > 1 else ways[0]
                todo.remove((i, k))
                bound |= {names[i][k], names[i][k + 1]}
                grows.append(rank == 2)
                out.append((i, k, way))
            return (sum(grows), -grows.index(True) if any(grows) else 0), out, grows

        every = list(dict.fromkeys(n for own in names for n in own))
        plans = [(n, order(n)) for n in every]
        if any(x is None for _, x in plans):
            return None
        start, (_, plan, grows) = min(plans, key=lambda x: x[1][0])
        own_props = {n.var: {key for p in patterns for m in p.nodes if m.var == n.var for key, _ in m.props} for p in patterns for n in p.nodes if n.var}
        count: dict[str, int] = {}
        for own in names:
            for n in own:
                count[n] = count.get(n, 0) + 1
        self.quiet = {n: c for n, c in count.items() if not own_props.get(n)}
        i, k, way = plan[0]
        at = k if way == 1 else k + 1
        silent = self.unnamed(start) and len(tables[start]) == 1 and self.graph.nodes[tables[start][0]].label is not None
        bare: set[str] = set()
        applied = {(i, at)}
        if silent and one(i, k, way) and not patterns[i].nodes[at].props:
            rows, scope, bare = None, {}, {start}  # its own table, as relationships
        else:
            rows, ref = self.nodes(patterns[i].nodes[at], start, tables[start], {})
            scope = {start: ref}
            rows = self.with_props(rows, scope, patterns[i].nodes[at].props, ref)
            if silent:
                rows = rows.hint("shuffle_hash")  # ids alone; the relationships need no sort
        keys = {start}
        for step, ((i, k, way), more) in enumerate(zip(plan, grows)):
            p = patterns[i]
            near, far = (k, k + 1) if way == 1 else (k + 1, k)
            if needs is not None and more and step and not any(q.name for q in patterns):
                later = {n for j, h, _ in plan[step:] for n in names[j][h : h + 2]}
                live = [n for n in scope if n in later or n in needs]
                if not keys <= set(live):
                    rows, scope = self.weighed(rows, scope, live, needs, own_props)
                    keys = set(live)
            if (i, near) not in applied and names[i][near] in scope:
                rows = self.restrict(rows, scope, p.nodes[near], scope[names[i][near]])
            rows, scope = self.hop(rows, scope, p, k, way, names[i], rel_names[i], near, far, nodes[i], edges[i], bare)
            if bare:
                rows, bare = rows.where(scope[start].id().isNotNull()), set()
            applied |= {(i, near), (i, far)}
            if more:
                keys = keys | {rel_names[i][k]}
        for i, p in enumerate(patterns):
            for k, n in enumerate(p.nodes):
                if (i, k) not in applied and names[i][k] in scope:
                    rows = self.restrict(rows, scope, n, scope[names[i][k]])
        self.quiet = {}
        for p in patterns:
            if p.name:
                parts = []
                for k, n in enumerate(p.nodes):
                    if n.var:
                        parts.append(scope[n.var])
                    if k < len(p.rels) and p.rels[k].var:
                        parts.append(scope[p.rels[k].var])
                scope[p.name] = PathRef(parts)
        return rows, scope

    def weighed(self, rows: DataFrame, scope: dict, live: list[str], needs: dict, own_props: dict) -> tuple[DataFrame, dict]:
        """Rows with the live variables alone, each once, and how many there were of it."""
        columns, constant, out = [], {}, {}
        for name in live:
            ref = scope[name]
            asked = needs.get(name, set())
            if isinstance(ref, NodeRef):
                kept = ref.props if asked is None else {x: t for x, t in ref.props.items() if x in asked | own_props.get(name, set())}
                ref = NodeRef(name, kept, ref.id_type, ref.tables)
            out[name] = ref
            columns += ref.columns()
            if isinstance(ref, NodeRef) and len(ref.tables) == 1 and (label := self.graph.nodes[ref.tables[0]].label) is not None:
                columns.remove(f"{name}.@labels")
                constant[f"{name}.@labels"] = F.array(F.lit(label))
        weight = F.sum("`@weight`") if "@weight" in rows.columns else F.count(F.lit(1))
        rows = rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(weight.alias("@weight"))
        for c, value in constant.items():
            rows = rows.withColumn(c, value)
        return rows, out

    def unnamed(self, name: str) -> bool:
        """Nothing but relationships names the node."""
        return self.used.get(name, 0) <= self.quiet.get(name, 1) and self.security is None

    # -- one pattern
    def match(self, rows: DataFrame | None, scope: dict, p: A.Pattern, bare: set[str] | None = None) -> tuple[DataFrame, dict]:
        """``rows`` with the matches of ``p``; without rows, the matches alone.

        Variables in ``bare`` are bound outside: only their ids are made, from the
        relationship that starts or ends there.
        """
        bare = bare or set()
        scope = dict(scope)
        node_tables, edge_tables = self.candidates(p, scope)
        names = [n.var or self.fresh("n") for n in p.nodes]
        rel_names = [r.var or self.fresh("r") for r in p.rels]
        # Start at a bound node, if there is one; else at the first.
        start = next((k for k, n in enumerate(names) if n in scope and n not in bare), None)
        if start is None and bare:
            start = next((k for k, n in enumerate(names) if n in bare), None)
        start = start or 0
        first = names[start]
        if first in bare:
            pass
        elif first in scope:
            if not isinstance(scope[first], NodeRef):
                raise SemanticError(f"{first} is not a node")
            rows = self.restrict(rows, scope, p.nodes[start], scope[first])
        else:
            df, ref = self.nodes(p.nodes[start], first, node_tables[start], scope)
            rows, scope = self.attach(rows, df, scope, first, ref)
            rows = self.with_props(rows, scope, p.nodes[start].props, ref)
        order = [(k, 1) for k in range(start, len(p.rels))] + [(k, -1) for k in range(start - 1, -1, -1)]
        for k, way in order:
            near, far = (k, k + 1) if way == 1 else (k + 1, k)
            rows, scope = self.hop(rows, scope, p, k, way, names, rel_names, near, far, node_tables, edge_tables, bare)
        if p.name:
            parts = []
            for k, n in enumerate(p.nodes):
                if n.var:
                    parts.append(scope[n.var])
                if k < len(p.rels) and p.rels[k].var:
                    parts.append(scope[p.rels[k].var])
            scope[p.name] = PathRef(parts)
        return rows, scope

    def attach(self, rows: DataFrame | None, df: DataFrame, scope: dict, name: str, ref) -> tuple[DataFrame, dict]:
        return (df if rows is None else rows.crossJoin(df)), {**scope, name: ref}

    def restrict(self, rows: DataFrame, scope: dict, n: A.NodePattern, ref: NodeRef) -> DataFrame:
        """Labels and properties asked of a node that is bound already."""
        rows = rows.where(ref.id().isNotNull())
        for label in n.labels:
            if not all(self.graph.nodes[t].label == label for t in ref.tables):
                rows = rows.where(F.array_contains(ref.labels(), label))
        return self.with_props(rows, scope, n.props, ref)

    def with_props(self, rows: DataFrame, scope: dict, props, ref) -> DataFrame:
        for key, e in props:
            if key not in ref.props:
                return rows.where(F.lit(False))
            x = self.expressions(scope)
            found = x.value(e)
            rows = rows.where(x.equal(Value(ref.prop(key), ref.props[key]), found, True) & ref.prop(key).isNotNull())
        return rows

    def hop(self, rows, scope, p, k, way, names, rel_names, near, far, node_tables, edge_tables, bare):
        r = p.rels[k]
        direction = r.direction if way == 1 else {"out": "in", "in": "out", "both": "both"}[r.direction]
        if r.many:
            return self.long_hop(rows, scope, p, k, direction, names, rel_names, near, far, node_tables, edge_tables, bare)
        left, right = node_tables[near], node_tables[far]
        near_native, far_native = len(left) == 1, len(right) == 1
        rel = rel_names[k]
        if rel in scope and not isinstance(scope[rel], RelRef):
            raise SemanticError(f"{rel} is not a relationship")
        bound_rel = rel in scope
        name = self.fresh("r") if bound_rel else rel
        tables = edge_tables[k]
        if not tables:
            tables = list(range(len(self.graph.edges)))[:1]
        forms = []
        if direction in ("out", "both"):
            fit = [e for e in tables if any(self.graph.joins(e, a, "src") for a in left) and any(self.graph.joins(e, b, "dst") for b in right)]
            if fit:
                df, ref = self.edges(name, fit, r.types, left, right, (near_native, far_native), len(tables) == 1)
                forms.append((df.withColumn("@near", F.col(f"`{name}.@src`")).withColumn("@far", F.col(f"`{name}.@dst`")), ref))
        if direction in ("in", "both"):
            fit = [e for e in tables if any(self.graph.joins(e, a, "dst") for a in left) and any(self.graph.joins(e, b, "src") for b in right)]
            if fit:
                df, ref = self.edges(name, fit, r.types, right, left, (far_native, near_native), len(tables) == 1)
                forms.append((df.withColumn("@near", F.col(f"`{name}.@dst`")).withColumn("@far", F.col(f"`{name}.@src`")), ref))
        if not forms or not edge_tables[k]:
            df, ref = self.edges(name, tables, r.types, None, None, (True, True), len(tables) == 1)
            forms = [(df.withColumn("@near", F.col(f"`{name}.@src`")).withColumn("@far", F.col(f"`{name}.@dst`")).where(F.lit(False)), ref)]
        df, ref = forms[0]
        for other, other_ref in forms[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
            ref = RelRef(name, {**ref.props, **other_ref.props}, ref.id_type, ref.end_types)
        near_name, far_name = names[near], names[far]
        ends = {getattr(self.graph.edges[e], f"{b}_label") for a, b, way in (("src", "dst", "out"), ("dst", "src", "in")) if direction in (way, "both")
                for e in tables if any(self.graph.joins(e, x, a) for x in left) and any(self.graph.joins(e, x, b) for x in right)}
        near_key, far_key = self.fresh("near"), self.fresh("far")
        df = df.withColumnRenamed("@near", near_key).withColumnRenamed("@far", far_key)
        on = None
        if near_name in bare and near_name not in scope:
            tables_near = node_tables[near]
            scope = {**scope, near_name: NodeRef(near_name, {}, df.schema[near_key].dataType, tables_near)}
            df = df.withColumn(f"{near_name}.@id", F.col(near_key)).withColumn(f"{near_name}.@labels", F.lit(None).cast(LABELS))
            rows = df if rows is None else rows.crossJoin(df)
        else:
            on = self.near_id(scope[near_name], near_native, node_tables[near]) == F.col(near_key)
            if far_name in scope:
                on = on & (self.near_id(scope[far_name], far_native, node_tables[far]) == F.col(far_key))
            if bound_rel:
                on = on & (scope[rel].id() == ref.id())
            rows = rows.join(df, on)
        new_scope = scope if bound_rel else {**scope, rel: ref}
        rows = self.with_props(rows, new_scope, r.props, ref)
        rows = rows.drop(near_key)
        if far_name in new_scope:
            if on is None:
                rows = rows.where(self.near_id(new_scope[far_name], far_native, node_tables[far]) == F.col(far_key))
            rows = self.restrict(rows.drop(far_key), new_scope, p.nodes[far], new_scope[far_name])
            return rows, new_scope
        if far_name in bare:
            new_scope = {**new_scope, far_name: NodeRef(far_name, {}, rows.schema[far_key].dataType, node_tables[far])}
            rows = rows.withColumnRenamed(far_key, f"{far_name}.@id").withColumn(f"{far_name}.@labels", F.lit(None).cast(LABELS))
            return rows, new_scope
        return self.arrive(rows, new_scope, p.nodes[far], far_name, node_tables[far], far_key, ends)

    def near_id(self, ref: NodeRef, native: bool, tables: list[int]) -> Column:
        """The id of a bound node, native or global as the relationship's end is."""
        if native and len(ref.tables) > 1:
            # Bound as one of several tables: its id is global, the end's is native.
            label = self.graph.nodes[tables[0]].label
            return F.when(ref.id().startswith(label + ":"), F.substring(ref.id(), len(label) + 2, 1 << 30)) if label else ref.id()
        if not native and len(ref.tables) == 1:
            return self.graph.global_id(ref.tables[0], ref.id())
        return ref.id()

    def arrive(self, rows, scope, n: A.NodePattern, name: str, tables: list[int], key: str, ends: set) -> tuple[DataFrame, dict]:
        """Join the far node; ``ends``: the labels that the relationships have there."""
        labels = [self.graph.nodes[t].label for t in tables]
        lone = self.unnamed(name) and not n.props
        implied = bool(tables) and None not in labels and (len(tables) == 1 or bool(ends) and ends <= set(labels))
        if self.trust and lone and implied:
            ref = NodeRef(name, {}, rows.schema[key].dataType, tables)
            rows = rows.where(F.col(f"`{key}`").isNotNull()).withColumnRenamed(key, f"{name}.@id")
            label = F.lit(labels[0]) if len(tables) == 1 else F.substring_index(F.col(f"`{name}.@id`"), ":", 1)
            return rows.withColumn(f"{name}.@labels", F.array(label)), {**scope, name: ref}
        df, ref = self.nodes(n, name, tables, scope)
        scope = {**scope, name: ref}
        early = [x for x in n.props if not any(isinstance(y, A.Var) for y in _walk(x[1]))]
        df = self.with_props(df, {name: ref}, early, ref)
        rows = rows.join(df, F.col(f"`{key}`") == ref.id()).drop(key)
        return self.with_props(rows, scope, [x for x in n.props if x not in early], ref), scope

    # -- paths of variable length
    def long_hop(self, rows, scope, p, k, direction, names, rel_names, near, far, node_tables, edge_tables, bare):
        """All trails (no relationship twice) of the asked lengths.

        One join for each hop; the rows carry the ids of the relationships passed.
        Short bounds stay one lazy plan; longer ones write each frontier and stop
        when it is empty, so a bound of ten costs what the data need.
        """
        from ..sources.durable import cut

        r = p.rels[k]
        low = 1 if r.low is None else r.low
        high = max(low, MOST_HOPS) if r.high is None else r.high
        g = self.graph
        tables = edge_tables[k]
        labels = {g.edges[e].src_label for e in tables} | {g.edges[e].dst_label for e in tables}
        native = len(labels) <= 1
        edge = self.fresh("e")
        df, ref = self.edges(edge, tables, r.types, None, None, (native, native), len(tables) == 1)
        want_rels = r.var is not None and (self.used.get(r.var, 0) > 1 or p.name is not None)
        item = ref.struct() if want_rels else None
        cols = [F.col(f"`{edge}.@src`").alias("@a"), F.col(f"`{edge}.@dst`").alias("@b"), ref.id().alias("@eid")] + ([item.alias("@item")] if want_rels else [])
        out = df.select(*cols)
        back = df.select(F.col(f"`{edge}.@dst`").alias("@a"), F.col(f"`{edge}.@src`").alias("@b"), *cols[2:])
        steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
        near_name, far_name = names[near], names[far]
        if near_name in bare and near_name not in scope:
            raise SemanticError("a path of variable length can't start here")
        start = scope[near_name]
        here = self.near_id(start, native, start.tables)
        id_kind = T.ArrayType(ref.id_type)
        frontier = rows.withColumn("@cur", here).withColumn("@seen", F.array().cast(id_kind))
        if want_rels:
            frontier = frontier.withColumn("@rels", F.array().cast(T.ArrayType(ref.struct_type())))
        found = frontier if low == 0 else None
        for depth in range(1, high + 1):
            frontier = frontier.join(steps, (F.col("@cur") == F.col("@a")) & ~F.array_contains("@seen", F.col("@eid")))
            frontier = frontier.withColumn("@cur", F.col("@b")).withColumn("@seen", F.concat("@seen", F.array("@eid")))
            if want_rels:
                frontier = frontier.withColumn("@rels", F.concat("@rels", F.array("@item")))
            frontier = frontier.drop("@a", "@b", "@eid", "@item")
            if high > EAGER_HOPS and depth >= 2:
                frontier, _ = cut(frontier)
                if frontier.isEmpty():
                    break
            if depth >= low:
                found = frontier if found is None else found.unionByName(frontier)
        if found is None:
            found = frontier.where(F.lit(False))
        found = found.drop("@seen")
        scope = dict(scope)
        if r.var:
            if want_rels:
                found = found.withColumnRenamed("@rels", r.var)
                scope[r.var] = Value(F.col(f"`{r.var}`"), T.ArrayType(ref.struct_type()))
        if far_name in scope:
            far_ref = scope[far_name]
            found = found.where(self.near_id(far_ref, native, far_ref.tables) == F.col("@cur")).drop("@cur")
            return self.restrict(found, scope, p.nodes[far], far_ref), scope
        key = self.fresh("far")
        found = found.withColumnRenamed("@cur", key)
        far_tables = node_tables[far]
        if native:
            label = next(iter(labels), None)
            far_tables = [t for t in far_tables if label is None or g.nodes[t].label in (None, label)]
            if len(far_tables) != 1:
                found = found.withColumn(key, F.concat(F.lit(f"{label}:"), F.col(f"`{key}`").cast("string")) if label else F.col(f"`{key}`").cast("string"))
        elif len(far_tables) == 1:
            label = g.nodes[far_tables[0]].label
            kind = g.nodes[far_tables[0]].df.schema["id"].dataType
            found = found.where(F.col(f"`{key}`").startswith(f"{label}:")).withColumn(key, F.substring(F.col(f"`{key}`"), len(label) + 2, 1 << 30).cast(kind))
        return self.arrive(found, scope, p.nodes[far], far_name, far_tables, key, set())


def _walk(e):
    from .expressions import walk

    return walk(e)
