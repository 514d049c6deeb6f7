"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. Every text is normalised; its key is a 64-bit hash. The keys alone - no texts - are counted first.
2. The directory says how many leading bits of a key name its bucket. It begins as one bucket and doubles while a bucket holds more
   keys than its capacity; a bucket that needs fewer bits than the directory's depth stands in several of its slots. Depth
   follows from the data: keys are distinct, so that each bucket fits in the end. Capacity grows with the number of keys beyond
   CAPACITY * BUCKETS, so that the directory has a bounded size whatever the input is.
3. Texts move once, to the owner of their bucket; a bucket is a range of keys. A key with many rows is dealt to several owners, whose
   entries meet again as one entry an owner. Owners compare the bytes of the texts under a key: equal ones are one entry, different
   ones are entries of the key's chain. Entries, by bucket, key and number in the chain, are written as sorted files to the
   shared folder; that is the index.
4. Rows find their bucket by the directory and, in it, their entry by key and digest.

Copies are never listed in one place: an entry holds its smallest id and a count.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Workspace

#: Keys that a bucket holds before it is split, and buckets from which on it holds more.
CAPACITY, BUCKETS = 1000, 4096
#: A key with more than this share of all rows, and more than HOT rows, is dealt to an owner for each such share.
HOT, HOT_SHARE = 1000, 1 / 1024


def normalised(text: Column) -> Column:
    """Each run of whitespace becomes one space; null counts as empty.

    The pattern leaves runs that are one space already alone, which is most of them.
    """
    ws = SPACE_CLASS
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{ws}]*|\x20[{ws}]+", " ")


def _slot(key: Column, depth: int) -> Column:
    """The leading `depth` bits of a key, as an integer from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def with_key(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__norm", normalised(F.col(text))).withColumn("__key", F.xxhash64("__norm"))


def split(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]] | None:
    """Buckets as (first slot, slots, local depth), in the order of keys, from the keys of the 2**depth slots that have any.

    A bucket that is overfull is split by one more bit. None: a slot by itself is overfull, so that the directory must be deeper.
    """
    if max(counts.values(), default=0) > capacity:
        return None
    below = sorted(counts)
    before = [0]
    for i in below:
        before.append(before[-1] + counts[i])

    def held(first: int, span: int) -> int:
        return before[bisect_left(below, first + span)] - before[bisect_left(below, first)]

    out, todo = [], [(0, 0)]
    while todo:
        first, local = todo.pop()
        span = 1 << (depth - local)
        if held(first, span) > capacity:
            todo += [(first + span // 2, local + 1), (first, local + 1)]
        else:
            out.append((first, span, local))
    return out


def build_directory(keys: DataFrame, capacity: int = CAPACITY, most: int = BUCKETS) -> tuple[DataFrame, int]:
    """(directory, depth). directory: slot, bucket, local_depth. keys: distinct __key."""
    spark, total = keys.sparkSession, keys.count()
    capacity = max(capacity, -(-total // most))
    # Hashes are spread evenly: a few bits more than the mean needs are enough as a rule; slots grow as total / capacity does.
    depth, found = max(0, (total // capacity).bit_length() + 1), None
    while found is None:
        counts = {r[0]: r[1] for r in keys.groupBy(_slot(F.col("__key"), depth).alias("slot")).count().collect()}
        found = split(counts, depth, capacity)
        depth += found is None
    slots = [(first + i, b, local) for b, (first, span, local) in enumerate(found) for i in range(span)]
    return spark.createDataFrame(slots, "slot long, bucket int, local_depth int"), depth


def build_index(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """(entries, directory, depth). entries: bucket, key, chain (number within the key), sha, keep_id, group_size."""
    rows = with_key(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text")
    keys = ws.table(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")), "keys")
    directory, depth = build_directory(keys.select("__key"), capacity)
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(HOT, int((keys.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # At most 1 / HOT_SHARE keys.
    hot = keys.filter(F.col("n") > share).select(F.col("__key"), F.ceil(F.col("n") / share).cast("int").alias("owners"))
    placed = (
        rows.withColumn("slot", _slot(F.col("__key"), depth))
        .join(F.broadcast(directory), "slot")  # its size is bounded by BUCKETS
        .join(F.broadcast(hot), "__key", "left")
        .withColumn("owner", F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("owners")), F.lit(0)))
        .select("bucket", "owner", "id", "__key", "__norm")
    )
    # Grouping by the text compares bytes, inside the tasks that own the buckets.
    owned = placed.repartition(parts, "bucket", "owner").groupBy("bucket", "owner", "__key", "__norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = ws.table(owned.select("bucket", "__key", F.sha2(F.col("__norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "entries")
    chain = Window.partitionBy("bucket", "key").orderBy("keep_id", "sha")
    whole = (
        entries.groupBy("bucket", F.col("__key").alias("key"), "sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .repartition(parts, "bucket")
        .withColumn("chain", F.row_number().over(chain))
        .sortWithinPartitions("bucket", "key", "chain")
    )
    index = ws.table(whole, "buckets")
    ws.drop(keys, entries)
    return index, directory, depth


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """All rows with keep_id, group_size, kept and text_sha256 beside their own columns.

    Texts are equal if they are identical after each run of whitespace is one space. Null is empty text,
    so null and '' are copies of each other. The row with the smallest id stays; null ids come last: a
    group of null ids only keeps them all as `kept` with keep_id null. Repeated rows with the
    smallest id all have kept = true; none can be told from another. Columns of the input with the
    names of results are replaced. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    index, directory, depth = build_index(docs, ws, doc_id, text, capacity)
    entry = index.select("bucket", "key", "sha", "keep_id", "group_size").toDF("__bucket", "__key", "__sha", "__keep", "__size")
    rows = with_key(docs.drop(*({"keep_id", "group_size", "kept", "text_sha256"} - {doc_id, text})), text)
    rows = rows.withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256)).withColumn("__slot", _slot(F.col("__key"), depth)).drop("__norm")
    bucket = directory.select(F.col("slot").alias("__slot"), F.col("bucket").alias("__bucket"))
    found = rows.join(F.broadcast(bucket), "__slot").join(entry.hint("merge"), ["__bucket", "__key", "__sha"])
    return (
        found.withColumn("keep_id", F.col("__keep"))
        .withColumn("group_size", F.col("__size"))
        .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("__keep")))
        .withColumn("text_sha256", F.col("__sha"))
        .drop("__slot", "__bucket", "__key", "__sha", "__keep", "__size")
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns, whatever those are called."""
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    ids, texts = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    return exact_dedup(own, ids, texts).filter("kept").select(*own.columns).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
