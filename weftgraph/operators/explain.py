"""EXPLAIN: a row for each clause, with what statistics say of the tables it touches."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cypher import ast as A


def operations(statement: A.Statement) -> list[tuple[str, str]]:
    """The operators of a statement in order, as name and detail."""
    out = []
    for k, part in enumerate(statement.parts):
        if k:
            out.append(("UnionAll" if statement.all_flags[k - 1] else "Union", ""))
        for c in part:
            if isinstance(c, A.Match):
                for p in c.patterns:
                    out.append(("OptionalScan" if c.optional else "Scan", f"({p.nodes[0].var or ''}{''.join(':' + x for x in p.nodes[0].labels)})"))
                    for r, n in zip(p.rels, p.nodes[1:]):
                        name = "PathExpand" if r.many else "Expand"
                        span = f" {r.low or 1}..{r.high if r.high is not None else max(r.low or 1, 10)}" if r.many else ""
                        out.append((name, f"{r.direction} {'|'.join(r.types) or 'any'}{span} to ({n.var or ''}{''.join(':' + x for x in n.labels)})"))
                if c.where is not None:
                    out.append(("Filter", ""))
            elif isinstance(c, A.Projection):
                from ..plans.expressions import has_aggregate

                out.append(("Aggregate" if any(has_aggregate(i.expr) for i in c.items) else "Project", c.kind))
                if c.distinct:
                    out.append(("Distinct", ""))
                if c.order:
                    out.append(("OrderBy", ""))
                if c.skip is not None or c.limit is not None:
                    out.append(("Limit", ""))
            else:
                out.append((type(c).__name__, ""))
    return out


def explain(session, statement: A.Statement, params) -> DataFrame:
    """Columns ``step``, ``operator``, ``detail``, ``rows`` (of the tables, before filters) and ``plan`` (Spark's, in the first row)."""
    g = session.graph
    counts: dict[str, int] = {}
    rows = []
    for k, (name, detail) in enumerate(operations(statement)):
        n = None
        if name in ("Scan", "OptionalScan"):
            labels = detail.strip("()").split(":")[1:]
            key = ":".join(labels)
            if key not in counts:
                tables = [g.nodes[i] for i in g.tables_for(labels)]
                total = 0
                for t in tables:
                    df = t.df if t.label is not None or not labels else t.df.where(F.array_contains("labels", labels[0]))
                    total += df.count()
                counts[key] = total
            n = counts[key]
        rows.append((k, name, detail, n, None))
    plan = None
    if not statement.writes:
        from ..plans.compiler import Compiler

        df = Compiler(g, params, None, session.trust, session.lenient).statement(statement)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("formatted")
        plan = text.getvalue()
    if rows:
        rows[0] = (*rows[0][:4], plan)
    return g.spark.createDataFrame(rows, "step int, operator string, detail string, rows long, plan string")
