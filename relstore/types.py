"""The four types, columns, schemas and the limits that a user can observe."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import RelError, Span

# Limits of the dialect.
MAX_IDENTIFIER = 63
MAX_COLUMNS = 1024
MAX_VARCHAR = 4000
MAX_TUPLE = 4040
UINT32_MAX = 2**32 - 1
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_SPARK = {"UINT32": T.LongType(), "INT64": T.LongType(), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType()}
#: Bytes of a value in a row; a VARCHAR adds its own length.
_BYTES = {"UINT32": 4, "INT64": 8, "BOOLEAN": 1, "VARCHAR": 4}


def normalized(name: str) -> str:
    return name.translate({c: c + 32 for c in range(65, 91)})


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    max_bytes: int = 0

    @property
    def sql_type(self) -> str:
        return f"VARCHAR({self.max_bytes})" if self.type == "VARCHAR" else self.type


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    @staticmethod
    def of(columns: Sequence[Column]) -> Schema:
        """Validated; names become lower case."""
        if not 1 <= len(columns) <= MAX_COLUMNS:
            raise RelError("Semantic", f"a table has 1 to {MAX_COLUMNS} columns")
        out, seen, keys = [], set(), 0
        for c in columns:
            if not _NAME.match(c.name) or len(c.name) > MAX_IDENTIFIER:
                raise RelError("Semantic", f"invalid identifier '{c.name}'")
            name = normalized(c.name)
            if name in seen:
                raise RelError("Semantic", f"duplicate column name '{name}'")
            seen.add(name)
            if c.type not in _SPARK:
                raise RelError("Semantic", f"unknown type {c.type}")
            if c.type == "VARCHAR" and not 1 <= c.max_bytes <= MAX_VARCHAR:
                raise RelError("Semantic", f"VARCHAR length must be between 1 and {MAX_VARCHAR}")
            if c.primary_key:
                keys += 1
                if keys > 1:
                    raise RelError("Semantic", "a table declares more than one primary key")
                if c.nullable:
                    raise RelError("Semantic", "primary-key column cannot be nullable")
                if c.type != "UINT32":
                    raise RelError("Semantic", "primary keys must use UINT32")
            out.append(Column(name, c.type, c.nullable, c.primary_key, c.max_bytes if c.type == "VARCHAR" else 0))
        return Schema(tuple(out))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.primary_key), None)

    def find(self, name: str, span: Span | None = None) -> Column:
        wanted = normalized(name)
        for c in self.columns:
            if c.name == wanted:
                return c
        raise RelError("Semantic", f"column '{name}' does not exist", span)

    def struct(self) -> T.StructType:
        """As Spark sees it. Constraints are the manifest's; Spark's nullability is only advice."""
        return T.StructType([T.StructField(c.name, _SPARK[c.type], True, {"type": c.sql_type, "primary_key": c.primary_key}) for c in self.columns])

    def definition_bytes(self, table: str) -> int:
        return 48 + len(table) + 24 + sum(8 + len(c.name) for c in self.columns)

    def row_bytes(self, row: Sequence) -> int:
        n = 24 + -(-len(self.columns) // 8)
        for c, v in zip(self.columns, row, strict=True):
            if v is not None:
                n += _BYTES[c.type] + (len(v.encode("utf-8", "surrogatepass")) if c.type == "VARCHAR" else 0)
        return n

    def row_bytes_column(self, values: dict[str, SparkColumn]) -> SparkColumn:
        total = F.lit(24 + -(-len(self.columns) // 8))
        for c in self.columns:
            v = values[c.name]
            size = F.octet_length(v) + 4 if c.type == "VARCHAR" else F.lit(_BYTES[c.type])
            total = total + F.when(v.isNull(), 0).otherwise(size)
        return total

    def to_json(self) -> list[dict]:
        return [c.__dict__ for c in self.columns]

    @staticmethod
    def from_json(columns: list[dict]) -> Schema:
        return Schema(tuple(Column(**c) for c in columns))


def table_name(name: str, span: Span | None = None) -> str:
    if not _NAME.match(name) or len(name) > MAX_IDENTIFIER:
        raise RelError("Semantic", f"invalid identifier '{name}'", span)
    return normalized(name)


def convert(literal, column: Column, span: Span | None):
    """The value of a literal (see plans.tree) for a column: no coercion between kinds."""
    kind, v = literal.kind, literal.value
    if kind == "null":
        if not column.nullable:
            raise RelError("Constraint", f"column '{column.name}' cannot be NULL", span)
        return None
    return typed_value(literal, column.name, column.type, column.max_bytes, span) if v is not None else None


def typed_value(literal, name: str, type_: str, max_bytes: int, span: Span | None):
    """The value of a literal other than NULL, checked against a type and its range."""
    kind, v = literal.kind, literal.value
    fits = {"UINT32": "int", "INT64": "int", "BOOLEAN": "bool", "VARCHAR": "string"}[type_] == kind
    if not fits:
        label = {"int": "integer", "bool": "BOOLEAN", "string": "string"}[kind]
        raise RelError("Semantic", f"{label} literal is incompatible with {type_} column '{name}'", span)
    if type_ == "VARCHAR" and len(v.encode("utf-8", "surrogatepass")) > max_bytes:
        raise RelError("Constraint", f"value for column '{name}' exceeds VARCHAR({max_bytes})", span)
    if type_ == "UINT32":
        if literal.negative:
            raise RelError("Constraint", f"negative integer is out of range for UINT32 column '{name}'", span)
        if v > UINT32_MAX:
            raise RelError("Constraint", f"integer is out of range for UINT32 column '{name}'", span)
    if type_ == "INT64" and not INT64_MIN <= v <= INT64_MAX:
        raise RelError("Constraint", f"integer is out of range for INT64 column '{name}'", span)
    return v
