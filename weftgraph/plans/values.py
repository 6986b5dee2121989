"""Values of expressions: a column with its type, or a bound graph element."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SemanticError(ValueError):
    """A query that reads well but means nothing here."""


@dataclass
class Value:
    col: Column
    type: T.DataType
    maybe_null: bool = True


@dataclass
class NodeRef:
    """A bound node: its columns start with its name."""

    var: str
    props: dict[str, T.DataType]
    id_type: T.DataType
    tables: list[int] = field(default_factory=list)

    def id(self) -> Column:
        return F.col(f"`{self.var}.@id`")

    def labels(self) -> Column:
        return F.col(f"`{self.var}.@labels`")

    def prop(self, key: str) -> Column:
        return F.col(f"`{self.var}.{key}`")

    def columns(self) -> list[str]:
        return [f"{self.var}.@id", f"{self.var}.@labels", *[f"{self.var}.{k}" for k in self.props]]

    def struct_type(self) -> T.StructType:
        return T.StructType(
            [T.StructField("_id", self.id_type), T.StructField("_labels", T.ArrayType(T.StringType()))]
            + [T.StructField(k, t) for k, t in self.props.items()]
        )

    def struct(self) -> Column:
        inner = F.struct(self.id().alias("_id"), self.labels().alias("_labels"), *[self.prop(k).alias(k) for k in self.props])
        return F.when(self.id().isNotNull(), inner)


@dataclass
class RelRef:
    """A bound relationship."""

    var: str
    props: dict[str, T.DataType]
    id_type: T.DataType
    end_types: tuple = (T.StringType(), T.StringType())

    def id(self) -> Column:
        return F.col(f"`{self.var}.@id`")

    def rel_type(self) -> Column:
        return F.col(f"`{self.var}.@type`")

    def prop(self, key: str) -> Column:
        return F.col(f"`{self.var}.{key}`")

    def columns(self) -> list[str]:
        return [f"{self.var}.{k}" for k in ("@id", "@type", "@src", "@dst", *self.props)]

    def struct_type(self) -> T.StructType:
        return T.StructType(
            [T.StructField("_id", self.id_type), T.StructField("_type", T.StringType())]
            + [T.StructField("_src", self.end_types[0]), T.StructField("_dst", self.end_types[1])]
            + [T.StructField(k, t) for k, t in self.props.items()]
        )

    def struct(self) -> Column:
        inner = F.struct(
            self.id().alias("_id"), self.rel_type().alias("_type"), F.col(f"`{self.var}.@src`").alias("_src"), F.col(f"`{self.var}.@dst`").alias("_dst"),
            *[self.prop(k).alias(k) for k in self.props],
        )
        return F.when(self.id().isNotNull(), inner)


@dataclass
class PathRef:
    """A named path: the bound, named elements in order."""

    elements: list
    extra: str | None = None


@dataclass
class Local:
    """A variable inside a list expression."""

    col: Column
    type: T.DataType


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def is_element(t: T.DataType) -> bool:
    """Whether a struct is a node or a relationship."""
    return isinstance(t, T.StructType) and t.names[:1] == ["_id"]


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type of a list or CASE over these types; raises where they don't mix."""
    known = [t for t in types if not is_null(t)]
    if not known:
        return T.NullType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(is_number(t) for t in known):
        return T.DoubleType() if any(map(is_float, known)) else T.LongType()
    if all(isinstance(t, T.ArrayType) for t in known):
        return T.ArrayType(common_type([t.elementType for t in known]))
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) for t in known):
        return T.TimestampType()
    return T.StringType()
