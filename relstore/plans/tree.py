"""Statements and expressions as parsed. AND and OR chains are lists, so that nothing recurses along them."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import Span

# Names in the debug form.
COMPARISONS = {"=": "Eq", "!=": "Ne", "<>": "Ne", "<": "Lt", "<=": "Le", ">": "Gt", ">=": "Ge"}


@dataclass(frozen=True)
class Literal:
    kind: str  # null, bool, int or string
    value: object
    span: Span = field(compare=False)
    negative: bool = False  # written with a minus, also for -0
    digits: str = ""


@dataclass(frozen=True)
class ColumnRef:
    name: str
    span: Span = field(compare=False)


@dataclass(frozen=True)
class Compare:
    op: str  # Eq, Ne, Lt, Le, Gt, Ge
    left: object
    right: object
    span: Span = field(compare=False)


@dataclass(frozen=True)
class Not:
    operand: object
    span: Span = field(compare=False)


@dataclass(frozen=True)
class Chain:
    op: str  # And, Or
    items: tuple
    span: Span = field(compare=False)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    length: str | None
    primary_key: bool
    nullable: bool | None
    span: Span = field(compare=False)
    length_span: Span | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Statement:
    kind: str  # Create, Insert, Select, Update, Delete, Begin, Commit, Rollback
    span: Span = field(compare=False)
    table: str = ""
    table_span: Span | None = field(default=None, compare=False)
    columns: tuple | None = None  # ColumnSpec of Create; (name, span) of Insert and Select (None: all)
    values: tuple = ()  # of Insert
    assignments: tuple = ()  # (name, span, Literal) of Update
    where: object = None
    read_only: bool = False

    def __repr__(self) -> str:
        return debug(self)


def debug(x) -> str:
    """A form of a statement or expression that is the same for the same tree."""
    if isinstance(x, Literal):
        if x.kind == "null":
            return "Null"
        if x.kind == "bool":
            return f"Bool({str(x.value).lower()})"
        if x.kind == "int":
            return f"Int({'-' if x.negative else ''}{x.digits})"
        return 'String("' + x.value.replace("\\", "\\\\").replace('"', '\\"') + '")'
    if isinstance(x, ColumnRef):
        return f"Id({x.name})"
    if isinstance(x, Compare):
        return f"{x.op}({debug(x.left)},{debug(x.right)})"
    if isinstance(x, Not):
        return f"Not({debug(x.operand)})"
    if isinstance(x, Chain):
        out = debug(x.items[0])
        for item in x.items[1:]:
            out = f"{x.op}({out},{debug(item)})"
        return out
    if isinstance(x, ColumnSpec):
        kind = f"{x.type}({x.length})" if x.length is not None else x.type
        null = "" if x.nullable is None else ":NULL" if x.nullable else ":NOT_NULL"
        return f"{x.name}:{kind}{':PK' if x.primary_key else ''}{null}"
    where = f", where={debug(x.where)}" if x.where is not None else ""
    if x.kind == "Create":
        return f"Create(table={x.table}, columns=[{','.join(map(debug, x.columns))}])"
    if x.kind == "Insert":
        names = "" if x.columns is None else f"columns=[{','.join(n for n, _ in x.columns)}], "
        return f"Insert(table={x.table}, {names}values=[{','.join(map(debug, x.values))}])"
    if x.kind == "Select":
        return f"Select(table={x.table}, columns=[{'*' if x.columns is None else ','.join(n for n, _ in x.columns)}]{where})"
    if x.kind == "Update":
        return f"Update(table={x.table}, set=[{','.join(f'{n}={debug(v)}' for n, _, v in x.assignments)}]{where})"
    if x.kind == "Delete":
        return f"Delete(table={x.table}{where})"
    return x.kind + ("(READ ONLY)" if x.read_only else "")
