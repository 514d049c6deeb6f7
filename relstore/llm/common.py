"""What the operators share: tables in the shared folder, readers, defaults."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rules: ASCII only.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 1 << 20
#: Spark drops a command's shuffle files at its end; else they stay until the driver's heap happens to be collected.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none (tests) is a temporary one made and set; on a cluster a machine's own folder is no shared one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="relstore-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one call, in a folder of its own under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._tables: set[str] = set()

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df as Parquet and read it back: cuts the lineage, survives lost executors and leaves no shuffle files."""
        path = self.path(name)
        before = self.spark.conf.get(FILE_CLEANUP, None)
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            if before is None:
                self.spark.conf.unset(FILE_CLEANUP)
            else:
                self.spark.conf.set(FILE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._relstore_path = path
        self._tables.add(path)
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """Write the call's result and drop all else that it wrote."""
        out = self.table(df, "result")
        for path in self._tables - {out._relstore_path}:
            remove(self.spark, path)
        self._tables = {out._relstore_path}
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._relstore_path)
            self._tables.discard(t._relstore_path)

    def close(self) -> None:
        remove(self.spark, self.root)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """The rows that no label may be learnt from: crc32 of the id as text, modulo 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def batch_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a slice has about `limit` bytes (one row may have more)."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            n = 0 if n != n else int(n)
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def limit_threads() -> None:
    """One BLAS thread in a Python worker: cores belong to tasks."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
