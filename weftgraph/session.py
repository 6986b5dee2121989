"""The way in: a graph, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .cypher.parser import parse
from .plans.compiler import Compiler
from .plans.graph import PropertyGraph
from .plans.values import SemanticError


class GraphSession:
    """Runs query text over a graph.

    ``trust`` says that both ends of every relationship exist, which spares the join
    with a far node that the query does not use. ``lenient`` makes unknown functions
    null. Reads are lazy DataFrames; writes (graphs of one node and one edge table)
    replace the session's graph by its new version.
    """

    def __init__(self, graph: PropertyGraph, trust: bool = False, lenient: bool = False, legacy_star: bool = False, writer=None):
        self.graph, self.trust, self.lenient, self.legacy_star = graph, trust, lenient, legacy_star
        self.writer = writer

    def query(self, text: str, params: dict | None = None, security=None) -> DataFrame:
        statement = parse(text)
        if statement.explain:
            from .operators.explain import explain

            return explain(self, statement, params)
        if statement.writes and security is not None:
            raise SemanticError("a secured session only reads")
        writer = None
        if statement.writes:
            from .operators.mutate import Writer

            writer = self.writer or Writer(self)
        compiler = Compiler(self.graph, params, security, self.trust, self.lenient, writer, self.legacy_star)
        return compiler.statement(statement)

    def query_batch(self, statements: list[str], params: dict | None = None) -> list[DataFrame]:
        """Statements one after another; each sees what the ones before it wrote."""
        if len(statements) > 50:
            raise ValueError("at most 50 statements in a batch")
        if any(len(s.encode()) > 65536 for s in statements):
            raise ValueError("a statement may have 64 KiB at most")
        return [self.query(s, params) for s in statements]
