"""Scans and changes of one table. Changes are copy-on-write: they give a new TableState and leave all files as they are."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RelError
from ..functions.predicates import hits, matching, shrink, with_match
from ..plans.binder import Bound, key_candidate
from ..sources.files import Store, plain
from ..sources.manifest import DataFile, TableState
from ..types import MAX_TUPLE, UINT32_MAX, Column, Schema

RID = "_rid"
RID_COLUMN = Column(RID, "INT64")
#: Rows of local files that a statement by primary key reads or rewrites in this process; more are a Spark job.
NEAR_ROWS = 1 << 17
#: Footers of new local files that this process reads; more are a Spark job.
FOOTERS = 1024
_ARROW = {"UINT32": pa.int64(), "INT64": pa.int64(), "BOOLEAN": pa.bool_(), "VARCHAR": pa.string()}


class Tables:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    # -- reading

    def scan(self, t: TableState, files: Sequence[DataFile] | None = None, with_file: bool = False) -> DataFrame:
        """Columns in schema order, _rid and, if asked for, _file. External rows have no _rid before they are first changed."""
        files = t.files if files is None else files
        struct = T.StructType([*t.schema.struct().fields, T.StructField(RID, T.LongType())])
        names = [*t.schema.names, RID]
        extra = [F.col("_metadata.file_path").alias("_file")] if with_file else []
        out = None
        own = [f.path for f in files if not f.external]
        if own:
            out = self.spark.read.schema(struct).parquet(*own).select(*names, *extra)
        far = [f.path for f in files if f.external]
        if far:
            columns = [F.expr(e).cast(f.dataType).alias(f.name) for e, f in zip(t.mapping, t.schema.struct().fields, strict=True)]
            more = self.spark.read.parquet(*far).select(*columns, F.lit(None).cast("long").alias(RID), *extra)
            out = more if out is None else out.unionByName(more)
        if out is None:
            fields = [*struct.fields, T.StructField("_file", T.StringType())] if with_file else struct
            out = self.spark.createDataFrame([], T.StructType(list(fields)))
        return out

    def candidates(self, t: TableState, where: Bound | None) -> Sequence[DataFile]:
        """Files that may hold matches, by their range of primary keys."""
        key = key_candidate(where, t.schema)
        return t.files if key is None else [f for f in t.files if f.may_hold(key)]

    def select(self, t: TableState, where: Bound | None) -> DataFrame:
        return matching(self.scan(t, self.candidates(t, where)), where)

    def has_key(self, t: TableState, key: int) -> bool:
        files = [f for f in t.files if f.may_hold(key)]
        # Keys are unique, so that a file whose range is as long as it has rows holds them all.
        if any(f.rows == f.high - f.low + 1 for f in files):
            return True
        if self._are_near(files):
            name = t.schema.key.name
            return any(pc.any(pc.equal(pq.ParquetFile(plain(f.path)).read([name]).column(name), key)).as_py() for f in files)
        return bool(files) and not self.scan(t, files).filter(F.col(t.schema.key.name) == key).isEmpty()

    # -- statements by primary key over few local rows: no Spark job

    def _are_near(self, files: Sequence[DataFile]) -> bool:
        return self.store.local and not any(f.external for f in files) and sum(f.rows for f in files) <= NEAR_ROWS

    def near(self, t: TableState, where: Bound | None) -> Sequence[DataFile] | None:
        """The files that may hold the one row of a predicate that fixes the primary key, if they can be read here."""
        if key_candidate(where, t.schema) is None:
            return None
        files = self.candidates(t, where)
        return files if self._are_near(files) else None

    def _read(self, t: TableState, f: DataFile) -> pa.Table:
        return pq.ParquetFile(plain(f.path)).read().select([*t.schema.names, RID]).cast(self._arrow(t))

    def _rows(self, t: TableState, f: DataFile, where: Bound) -> tuple[pa.Table, pa.ChunkedArray | pa.Array]:
        """A file's rows, and which of them match."""
        rows = self._read(t, f)
        return rows, hits(shrink(where), rows)

    @staticmethod
    def _arrow(t: TableState) -> pa.Schema:
        return pa.schema([*((c.name, _ARROW[c.type]) for c in t.schema.columns), (RID, pa.int64())])

    def select_near(self, t: TableState, where: Bound, files: Sequence[DataFile], names: list[str]) -> list[tuple]:
        out: list[tuple] = []
        for f in files:
            rows, hit = self._rows(t, f, where)
            found = rows.filter(hit)
            out += zip(*(found.column(n).to_pylist() for n in names), strict=True)
        return out

    def _write_near(self, t: TableState, rows: pa.Table) -> tuple[DataFile, ...]:
        if not rows.num_rows:
            return ()
        folder = self.store.path(self._folder(t))
        os.makedirs(folder)
        path = f"{folder}/part-0.parquet"
        pq.write_table(rows, path)
        bounds = pc.min_max(rows.column(t.schema.key.name)).as_py() if t.schema.key else {"min": None, "max": None}
        return (DataFile(path, rows.num_rows, bounds["min"], bounds["max"]),)

    def _update_near(self, t: TableState, values: dict[str, object], where: Bound, files: Sequence[DataFile]) -> tuple[TableState, int]:
        key = t.schema.key.name
        for f in files:
            rows, hit = self._rows(t, f, where)
            if not pc.any(hit).as_py():
                continue
            old = rows.filter(hit).to_pylist()[0]  # keys are unique
            new = {**old, **values}
            if new[key] != old[key] and self.has_key(t, new[key]):
                raise RelError("Constraint", f"UPDATE primary key {new[key]} already exists")
            if t.schema.row_bytes([new[c] for c in t.schema.names]) > MAX_TUPLE:
                raise RelError("Constraint", "tuple exceeds the inline capacity")
            columns = [pc.if_else(hit, pa.scalar(values[c.name], c.type), rows.column(c.name)) if c.name in values else rows.column(c.name) for c in rows.schema]
            made = self._write_near(t, pa.Table.from_arrays(columns, schema=rows.schema))
            return replace(t, files=tuple(x for x in t.files if x is not f) + made), 1
        return t, 0

    def _delete_near(self, t: TableState, where: Bound, files: Sequence[DataFile]) -> tuple[TableState, int]:
        for f in files:
            rows, hit = self._rows(t, f, where)
            if pc.any(hit).as_py():
                made = self._write_near(t, rows.filter(pc.invert(hit)))
                return replace(t, files=tuple(x for x in t.files if x is not f) + made), 1
        return t, 0

    # -- writing

    def _folder(self, t: TableState) -> str:
        return f"data/{t.table_id}/{uuid.uuid4().hex}"

    def written(self, t: TableState, df: DataFrame) -> tuple[tuple[DataFile, ...], int | None]:
        """Write rows (columns and _rid) as new files: what a manifest says about them, and their largest _rid."""
        path = self.store.path(self._folder(t))
        df.select(*t.schema.names, RID).write.parquet(path)
        found = self._from_footers(t, path) if self.store.local else None
        if found is not None:
            return found
        return self.described(t, self.spark.read.schema(T.StructType([*t.schema.struct().fields, T.StructField(RID, T.LongType())])).parquet(path))

    def _from_footers(self, t: TableState, path: str) -> tuple[tuple[DataFile, ...], int | None] | None:
        """What `described` gives, from the statistics of a few local files; None if there are more, or some lack them."""
        names = sorted(n for n in os.listdir(path) if n.endswith(".parquet"))
        if len(names) > FOOTERS:
            return None
        files, last = [], None
        for name in names:
            footer = pq.read_metadata(f"{path}/{name}")
            if not footer.num_rows:
                continue
            bounds: dict[str, tuple[int, int]] = {}
            for c in [RID] if t.schema.key is None else [RID, t.schema.key.name]:
                at = footer.schema.names.index(c)
                parts = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups)]
                if not all(p is not None and p.has_min_max for p in parts):
                    return None
                bounds[c] = min(p.min for p in parts), max(p.max for p in parts)
            low, high = bounds[t.schema.key.name] if t.schema.key else (None, None)
            files.append(DataFile(f"{path}/{name}", footer.num_rows, low, high))
            last = max(bounds[RID][1], -1 if last is None else last)
        return tuple(files), last

    def described(self, t: TableState, df: DataFrame, external: bool = False) -> tuple[tuple[DataFile, ...], int | None]:
        key = t.schema.key
        bounds = [F.min(key.name).alias("low"), F.max(key.name).alias("high")] if key else [F.lit(None).alias("low"), F.lit(None).alias("high")]
        last = F.lit(None).cast("long") if external else F.max(RID)
        found = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *bounds, last.alias("last")).collect()  # a row for each file
        files = tuple(sorted((DataFile(r["path"], r["rows"], r["low"], r["high"], external) for r in found), key=lambda f: f.path))
        return files, max((r["last"] for r in found if r["last"] is not None), default=None)

    def insert_rows(self, t: TableState, rows: list[tuple[int, Sequence]]) -> TableState:
        """Checked rows with their ids, as one file."""
        if not rows:
            return t
        if self.store.local:
            columns = [pa.array([r[1][i] for r in rows], _ARROW[c.type]) for i, c in enumerate(t.schema.columns)]
            files = self._write_near(t, pa.Table.from_arrays([*columns, pa.array([r[0] for r in rows], pa.int64())], schema=self._arrow(t)))
        else:
            struct = T.StructType([*t.schema.struct().fields, T.StructField(RID, T.LongType())])
            files, _ = self.written(t, self.spark.createDataFrame([(*r[1], r[0]) for r in rows], struct).coalesce(1))
        return replace(t, files=t.files + files)

    def _violations(self, schema: Schema, df: DataFrame) -> None:
        """Check all rows in one pass."""
        checks: list[tuple[str, SparkColumn]] = []
        for c in schema.columns:
            v = F.col(c.name)
            if not c.nullable:
                checks.append((f"column '{c.name}' cannot be NULL", v.isNull()))
            if c.type == "UINT32":
                checks.append((f"integer is out of range for UINT32 column '{c.name}'", (v < 0) | (v > UINT32_MAX)))
            if c.type == "VARCHAR":
                checks.append((f"value for column '{c.name}' exceeds VARCHAR({c.max_bytes})", F.octet_length(v) > c.max_bytes))
        checks.append(("tuple exceeds the inline capacity", schema.row_bytes_column({c.name: F.col(c.name) for c in schema.columns}) > MAX_TUPLE))
        found = df.agg(*[F.max(F.coalesce(bad, F.lit(False))).alias(str(i)) for i, (_, bad) in enumerate(checks)]).first()
        for (message, _), bad in zip(checks, found, strict=True):
            if bad:
                raise RelError("Constraint", message)

    def append(self, t: TableState, df: DataFrame) -> TableState:
        """All rows of a DataFrame with the table's columns, checked like single inserts. Ids are unique, not dense."""
        cast = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.schema.struct().fields])
        self._violations(t.schema, cast)
        numbered = cast.withColumn(RID, F.monotonically_increasing_id() + F.lit(t.next_rid))
        files, last = self.written(t, numbered)
        if t.schema.key:
            key = t.schema.key.name
            new = self.scan(t, files).select(key)
            if not new.groupBy(key).count().filter("count > 1").isEmpty():
                raise RelError("Constraint", "Duplicate primary key.")
            low, high = min((f.low for f in files), default=0), max((f.high for f in files), default=-1)
            near = [f for f in t.files if f.low is not None and f.low <= high and f.high >= low]
            if near and not new.join(self.scan(t, near).select(key), key, "left_semi").isEmpty():
                raise RelError("Constraint", "Duplicate primary key.")
        return replace(t, files=t.files + files, next_rid=t.next_rid if last is None else last + 1)

    def import_parquet(self, t: TableState, path: str) -> TableState:
        """Refer to files as they are; they are checked now and copied when they are first changed."""
        source = self.spark.read.parquet(path)
        mapped = source.select(*[F.expr(e).cast(f.dataType).alias(f.name) for e, f in zip(t.mapping, t.schema.struct().fields, strict=True)])
        self._violations(t.schema, mapped)
        key = t.schema.key
        if key and not mapped.groupBy(key.name).count().filter("count > 1").isEmpty():
            raise RelError("Constraint", "Duplicate primary key.")
        named = source if key is None else source.withColumn(key.name, F.expr(t.mapping[t.schema.names.index(key.name)]).cast("long"))
        files, _ = self.described(t, named.select(*([key.name] if key else []), "_metadata"), external=True)
        return replace(t, files=t.files + files)

    # -- changing

    def _touched(self, t: TableState, where: Bound | None, extra: SparkColumn | None = None) -> tuple[list[tuple[DataFile, int]], int | None]:
        """Files with matches and how many, and the largest value of `extra` over matches; one job."""
        by_path = {plain(f.path): f for f in t.files}
        hits = matching(self.scan(t, self.candidates(t, where), with_file=True), where)
        found = hits.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.max(extra if extra is not None else F.lit(0)).alias("x")).collect()  # a row for each file
        return [(by_path[plain(r["_file"])], r["n"]) for r in found], max((r["x"] for r in found), default=None)

    def update(self, t: TableState, values: dict[str, object], where: Bound | None) -> tuple[TableState, int]:
        near = self.near(t, where)
        if near is not None:
            return self._update_near(t, values, where, near)
        struct = {f.name: f.dataType for f in t.schema.struct().fields}
        new = {c: F.lit(values[c]).cast(struct[c]) if c in values else F.col(c) for c in t.schema.names}
        touched, size = self._touched(t, where, t.schema.row_bytes_column(new))
        n = sum(k for _, k in touched)
        if not n:
            return t, 0
        key = t.schema.key
        if key and key.name in values:
            k = values[key.name]
            if n > 1:
                raise RelError("Constraint", f"UPDATE would produce duplicate primary key {k}")
            if self.has_key(t, k):
                row = matching(self.scan(t, [f for f, _ in touched]), where).select(key.name).first()
                if row[0] != k:
                    raise RelError("Constraint", f"UPDATE primary key {k} already exists")
        if size > MAX_TUPLE:
            raise RelError("Constraint", "tuple exceeds the inline capacity")
        old = [f for f, _ in touched]
        marked = with_match(self.scan(t, old), where, "__hit")
        changed = marked.select(*[F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in t.schema.names], RID)
        return self._replaced(t, old, changed), n

    def delete(self, t: TableState, where: Bound | None) -> tuple[TableState, int]:
        near = self.near(t, where)
        if near is not None:
            return self._delete_near(t, where, near)
        touched, _ = self._touched(t, where)
        part = [f for f, k in touched if k < f.rows]
        whole = {f.path for f, k in touched if k == f.rows}
        t = replace(t, files=tuple(f for f in t.files if f.path not in whole))
        if part:
            t = self._replaced(t, part, with_match(self.scan(t, part), where, "__hit").filter("not __hit").drop("__hit"))
        return t, sum(k for _, k in touched)

    def _replaced(self, t: TableState, old: Sequence[DataFile], rows: DataFrame) -> TableState:
        if any(f.external for f in old):  # rows of external files get their ids now
            rows = rows.withColumn(RID, F.coalesce(RID, F.monotonically_increasing_id() + F.lit(t.next_rid)))
        files, last = self.written(t, rows)
        gone = {f.path for f in old}
        next_rid = max(t.next_rid, -1 if last is None else last + 1)
        return replace(t, files=tuple(f for f in t.files if f.path not in gone) + files, next_rid=next_rid)

    def compact(self, t: TableState, target_rows: int) -> TableState:
        """Small files become few, sorted by primary key, so that their ranges don't overlap."""
        small = [f for f in t.files if f.rows < target_rows and not f.external]
        if len(small) < 2:
            return t
        if self._are_near(small) and sum(f.rows for f in small) <= target_rows:
            held = pa.concat_tables([self._read(t, f) for f in small])
            gone = {f.path for f in small}
            made = self._write_near(t, held.sort_by(t.schema.key.name) if t.schema.key else held)
            return replace(t, files=tuple(f for f in t.files if f.path not in gone) + made)
        rows, n = self.scan(t, small), max(1, sum(f.rows for f in small) // target_rows)
        key = t.schema.key
        rows = rows.repartitionByRange(n, key.name).sortWithinPartitions(key.name) if key else rows.coalesce(n)
        return self._replaced(t, small, rows)

    def validate(self, t: TableState) -> None:
        """Files, counts, ranges and keys are what the manifest says; else an Execution error."""
        fresh = {plain(f.path): f for part in (False, True) for f in self._measured(t, part)}
        for f in t.files:
            now = fresh.get(plain(f.path))
            if f.rows and (now is None or (now.rows, now.low, now.high) != (f.rows, f.low, f.high)):
                raise RelError("Execution", f"{f.path} is not as the manifest says")
        key = t.schema.key
        rows = self.scan(t)
        if key and not rows.groupBy(key.name).count().filter("count > 1").isEmpty():
            raise RelError("Execution", f"table '{t.name}' has a duplicate primary key")
        self._violations(t.schema, rows)

    def _measured(self, t: TableState, external: bool) -> tuple[DataFile, ...]:
        files = [f for f in t.files if f.external == external]
        if not files:
            return ()
        key = t.schema.key
        rows = self.scan(t, files, with_file=True)
        bounds = [F.min(key.name), F.max(key.name)] if key else [F.lit(None), F.lit(None)]
        return tuple(DataFile(r[0], r[1], r[2], r[3], external) for r in rows.groupBy("_file").agg(F.count(F.lit(1)), *bounds).collect())
