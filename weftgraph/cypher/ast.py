"""Syntax tree of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    base: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    base: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple  # of (key, Expr)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT, -, IS NULL, IS NOT NULL
    of: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    branches: tuple
    default: Expr | None


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    body: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Exists(Expr):
    patterns: tuple
    where: Expr | None


@dataclass(frozen=True)
class MapProjection(Expr):
    var: str
    items: tuple  # of ("prop", key) | ("all",) | ("pair", key, Expr) | ("var", name)


@dataclass(frozen=True)
class HasLabel(Expr):
    of: Expr
    labels: tuple


@dataclass(eq=False)
class NodePattern:
    var: str | None
    labels: list[str]
    props: list[tuple[str, Expr]]


@dataclass(eq=False)
class RelPattern:
    var: str | None
    types: list[str]
    props: list[tuple[str, Expr]]
    direction: str  # out, in, both
    low: int | None = None
    high: int | None = None
    many: bool = False
    star: bool = False


@dataclass(eq=False)
class Pattern:
    nodes: list[NodePattern]
    rels: list[RelPattern]
    name: str | None = None


@dataclass
class Item:
    expr: Expr
    alias: str | None


class Clause:
    pass


@dataclass
class Match(Clause):
    patterns: list[Pattern]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Projection(Clause):
    kind: str  # RETURN or WITH
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Unwind(Clause):
    expr: Expr
    var: str


@dataclass
class Procedure(Clause):
    name: str
    args: list[Expr]
    yields: list[str] | None


@dataclass
class Subquery(Clause):
    query: list[Clause]


@dataclass
class Create(Clause):
    patterns: list[Pattern]


@dataclass
class Merge(Clause):
    pattern: Pattern
    on_create: list
    on_match: list


@dataclass
class SetItems(Clause):
    items: list  # ("prop", var, key, Expr) | ("map", var, Expr, merge) | ("labels", var, [labels])


@dataclass
class Remove(Clause):
    items: list  # ("prop", var, key) | ("labels", var, [labels])


@dataclass
class Delete(Clause):
    names: list[str]
    detach: bool


@dataclass
class Foreach(Clause):
    var: str
    source: Expr
    body: list[Clause]


@dataclass
class LoadCsv(Clause):
    source: Expr
    var: str
    headers: bool


@dataclass
class Catalog(Clause):
    action: str  # create_index, drop_index, show_indexes, create_constraint, drop_constraint, show_constraints
    name: str | None = None
    label: str | None = None
    props: list[str] = field(default_factory=list)
    kind: str | None = None
    if_exists: bool = False


@dataclass
class Statement:
    parts: list[list[Clause]]  # of a union
    all_flags: list[bool]
    explain: bool = False

    @property
    def writes(self) -> bool:
        kinds = (Create, Merge, SetItems, Remove, Delete, Foreach)
        return any(isinstance(c, kinds) or (isinstance(c, Catalog) and not c.action.startswith("show")) for p in self.parts for c in p)
