"""A chained builder beside the query text: the same tree, compiled the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..cypher import ast as A
from ..cypher.parser import Parser
from .compiler import Compiler


def _expr(text):
    return Parser(text).expr() if isinstance(text, str) else text


class PlanBuilder:
    """scan, expand, path_expand, filter, project, aggregate, order_by, limit, distinct; then build."""

    def __init__(self, session):
        self.session = session
        self.pattern: A.Pattern | None = None
        self.matches: list[A.Clause] = []
        self.result = A.Projection("RETURN", [], star=True)

    def scan(self, label: str | None, alias: str, predicate: str | None = None) -> PlanBuilder:
        self.pattern = A.Pattern([A.NodePattern(alias, [label] if label else [], [])], [])
        self.matches.append(A.Match([self.pattern], _expr(predicate) if predicate else None))
        return self

    def scan_with_predicate(self, label: str | None, alias: str, predicate: str) -> PlanBuilder:
        return self.scan(label, alias, predicate)

    def _step(self, source: str, rel: A.RelPattern, dst: str, label: str | None) -> PlanBuilder:
        p = A.Pattern([A.NodePattern(source, [], []), A.NodePattern(dst, [label] if label else [], [])], [rel])
        self.matches.append(A.Match([p]))
        return self

    def expand(self, source: str, rel_type: str | None, dst: str, direction: str = "out", label: str | None = None, rel: str | None = None) -> PlanBuilder:
        return self._step(source, A.RelPattern(rel, [rel_type] if rel_type else [], [], direction), dst, label)

    def path_expand(self, source: str, rel_type: str | None, dst: str, low: int = 1, high: int = 10, direction: str = "out", label: str | None = None) -> PlanBuilder:
        return self._step(source, A.RelPattern(None, [rel_type] if rel_type else [], [], direction, low, high, True), dst, label)

    def filter(self, predicate: str) -> PlanBuilder:
        last = self.matches[-1]
        e = _expr(predicate)
        last.where = e if last.where is None else A.Binary("AND", last.where, e)
        return self

    def filter_on(self, alias: str, key: str, op: str, value) -> PlanBuilder:
        return self.filter(A.Binary(op, A.Prop(A.Var(alias), key), A.Lit(value)))

    def project(self, *items: str | tuple[str, str]) -> PlanBuilder:
        self.result.star = False
        self.result.items = [A.Item(_expr(i), None) if isinstance(i, str) else A.Item(_expr(i[0]), i[1]) for i in items]
        return self

    def aggregate(self, group_by: list, aggs: list[tuple[str, str, str]]) -> PlanBuilder:
        """``aggs``: (alias, function, expression or ``*``)."""
        calls = [A.Item(A.Call(f.lower(), (), star=True) if e == "*" else A.Call(f.lower(), (_expr(e),)), n) for n, f, e in aggs]
        self.project(*group_by)
        self.result.items += calls
        return self

    def order_by(self, expr: str, descending: bool = False) -> PlanBuilder:
        self.result.order.append((_expr(expr), descending))
        return self

    def limit(self, n: int) -> PlanBuilder:
        self.result.limit = A.Lit(n)
        return self

    def limit_offset(self, n: int, offset: int) -> PlanBuilder:
        self.result.skip = A.Lit(offset)
        return self.limit(n)

    def distinct(self) -> PlanBuilder:
        self.result.distinct = True
        return self

    def statement(self) -> A.Statement:
        return A.Statement([[*self.matches, self.result]], [])

    def build(self, security=None) -> DataFrame:
        s = self.session
        return Compiler(s.graph, {}, security, s.trust, s.lenient).statement(self.statement())


def plan_scan(session, label: str, alias: str = "n") -> DataFrame:
    return PlanBuilder(session).scan(label, alias).build()


def plan_traversal(session, label: str, rel_type: str, alias: str = "a", dst: str = "b") -> DataFrame:
    return PlanBuilder(session).scan(label, alias).expand(alias, rel_type, dst).build()
