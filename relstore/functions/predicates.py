"""Bound predicates as Spark columns, or as an Arrow filter where they are very large."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binder import Bound

#: Nodes beyond which Catalyst spends longer on a predicate than the rows are worth.
LARGE = 600
_OPS = {
    "Eq": lambda a, b: a == b,
    "Ne": lambda a, b: a != b,
    "Lt": lambda a, b: a < b,
    "Le": lambda a, b: a <= b,
    "Gt": lambda a, b: a > b,
    "Ge": lambda a, b: a >= b,
}
_ARROW = {"Eq": pc.equal, "Ne": pc.not_equal, "Lt": pc.less, "Le": pc.less_equal, "Gt": pc.greater, "Ge": pc.greater_equal}


def shrink(b: Bound) -> Bound:
    """`c = x OR c = y OR ...` becomes one membership test; the value of the predicate stays, also for NULL."""
    if b.kind in ("And", "Or", "not"):
        items = [shrink(x) for x in b.items]
        if b.kind == "Or":
            values, rest = {}, []
            for x in items:
                if x.kind == "compare" and x.op == "Eq" and {y.kind for y in x.items} == {"column", "constant"} and all(y.kind == "column" or y.value is not None for y in x.items):
                    c, v = x.items if x.items[0].kind == "column" else x.items[::-1]
                    values.setdefault(c.column.name, (c, []))[1].append(v.value)
                else:
                    rest.append(x)
            items = [Bound("in", "BOOLEAN", column=c.column, value=tuple(v)) for c, v in values.values()] + rest
            if len(items) == 1:
                return items[0]
        return Bound(b.kind, b.type, items=tuple(items))
    return b


def nodes(b: Bound) -> int:
    return 1 + sum(nodes(x) for x in b.items)


def to_column(b: Bound) -> Column:
    if b.kind == "column":
        return F.col(b.column.name)
    if b.kind == "constant":
        return F.lit(b.value).cast({"BOOLEAN": "boolean", "VARCHAR": "string", None: "boolean"}.get(b.type, "long"))
    if b.kind == "in":
        return F.col(b.column.name).isin(list(b.value))
    if b.kind == "not":
        return ~to_column(b.items[0])
    if b.kind == "compare":
        if any(x.type is None for x in b.items):
            return F.lit(None).cast("boolean")
        return _OPS[b.op](*map(to_column, b.items))
    parts = [to_column(x) for x in b.items]
    # A balanced tree: Catalyst recurses along it.
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0] if len(p) == 1 else p[0] & p[1] if b.kind == "And" else p[0] | p[1] for p in pairs]
    return parts[0]


def evaluate(b: Bound, batch: pa.RecordBatch | pa.Table):
    """The predicate over a batch, in three-valued logic."""
    n = batch.num_rows
    if b.kind == "column":
        return batch.column(b.column.name)
    if b.kind == "constant":
        return pa.scalar(b.value, {"BOOLEAN": pa.bool_(), "VARCHAR": pa.string(), None: pa.bool_()}.get(b.type, pa.int64()))
    if b.kind == "in":
        c = batch.column(b.column.name)
        return pc.if_else(pc.is_null(c), pa.scalar(None, pa.bool_()), pc.is_in(c, value_set=pa.array(b.value, c.type)))
    if b.kind == "not":
        return pc.invert(evaluate(b.items[0], batch))
    if b.kind == "compare":
        if any(x.type is None for x in b.items):
            return pa.nulls(n, pa.bool_())
        return _ARROW[b.op](*(evaluate(x, batch) for x in b.items))
    join = pc.and_kleene if b.kind == "And" else pc.or_kleene
    out = evaluate(b.items[0], batch)
    for x in b.items[1:]:
        out = join(out, evaluate(x, batch))
    return out


def hits(b: Bound, batch: pa.RecordBatch | pa.Table):
    """For each row whether the predicate is true."""
    hit = evaluate(b, batch)
    if isinstance(hit, pa.Scalar):
        hit = pa.array([hit.as_py()] * batch.num_rows, pa.bool_())
    return pc.fill_null(hit, False)


def with_match(df: DataFrame, where: Bound | None, name: str) -> DataFrame:
    """df with a boolean column that is true where the predicate is true, and false where it is false or unknown."""
    if where is None:
        return df.withColumn(name, F.lit(True))
    small = shrink(where)
    if nodes(small) <= LARGE:
        return df.withColumn(name, F.coalesce(to_column(small), F.lit(False)))
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, hits(small, batch)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` boolean") if schema else df


def matching(df: DataFrame, where: Bound | None) -> DataFrame:
    """The rows for which the predicate is true."""
    if where is None:
        return df
    small = shrink(where)
    if nodes(small) <= LARGE:
        return df.filter(to_column(small))
    return with_match(df, where, "__match").filter("__match").drop("__match")
