"""Embedding near-dedup by a pivot-permutation index.

1. Pivots are vectors of a bounded sample, about as many as the square root of the number of vectors (from PIVOTS to MOST_PIVOTS).
   A vector is described by its nearest pivots, in order: NEAREST of them, and one more for each doubling of the pivots, as
   neighbours among denser pivots change sooner.
2. Inverted pivot lists: a vector stands in the list of every two pivots that it has among its nearest, under its label. Two
   vectors meet if they share two pivots at least; they are compared if they share SHARED = 3. A list
   of more than BLOCK vectors is split by a third pivot, which loses nothing, as all that are compared share three.
3. What is longer still is cut into blocks of BLOCK vectors, and each two blocks of a list are one unit of work, so that no list
   is one task. Where two vectors share several lists, only the list of their lowest common pivots counts the pair.
4. Candidates are verified by their cosine in double precision.

Equal vectors are one class: only one of them is indexed, and the others are counted. Units report how many
links each vector has there and a spanning forest of them, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, limit_threads, read
from .components import connected_components

#: Rows that pivots are chosen from, the least and the most pivots, and how many of the nearest describe a vector at least.
SAMPLE, PIVOTS, MOST_PIVOTS, NEAREST = 4096, 128, 2048, 6
#: Pivots that two vectors must share to be compared.
SHARED = 3
BLOCK = 512
THRESHOLD = 0.93


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision; scaled first, so that squares stay finite."""
    v = np.asarray(vectors, np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(top > 0, top, 1)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def index_size(vectors: int) -> tuple[int, int]:
    """Pivots, and nearest ones of a vector, for a number of vectors: the length of lists then hardly grows with it."""
    pivots, nearest = PIVOTS, NEAREST
    while pivots < MOST_PIVOTS and pivots * pivots < vectors:
        pivots, nearest = pivots * 2, nearest + 1
    return pivots, nearest


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points far from one another: each next one is the sample's farthest from those chosen."""
    if not len(sample):
        return sample
    u = unit(sample)
    chosen, near = [0], u @ u[0]
    while len(chosen) < min(count, len(u)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        chosen.append(i)
        near = np.maximum(near, u @ u[i])
    return u[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The ordered numbers of each row's nearest pivots; ties by number."""
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int16)


def _describe(pivots_b, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        pivots = pivots_b.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            length = np.diff(column.offsets.to_numpy())
            near = [[]] * batch.num_rows
            fit = np.flatnonzero(length == pivots.shape[1])
            first = np.concatenate([[0], np.cumsum(length)])
            if len(fit):
                rows = flat[first[fit][:, None] + np.arange(pivots.shape[1])]
                for i, x in zip(fit, nearest_pivots(rows, pivots, count), strict=True):
                    near[i] = x.tolist()
            packed = [rows.tobytes() for rows in unit(flat[first[fit][:, None] + np.arange(pivots.shape[1])])] if len(fit) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("label"), batch.column("copies"), pa.array(packed, pa.binary()), pa.array(near, pa.list_(pa.int16()))], names=["v", "label", "copies", "vector", "near"]
            )

    return run


def compare_blocks(a: np.ndarray, b: np.ndarray | None, near_a: np.ndarray, near_b: np.ndarray | None, listed: tuple[int, ...], pivots: int, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links between two blocks of the list of the pivots `listed`, in order (b None: within one block)."""

    def sets(near: np.ndarray) -> np.ndarray:
        s = np.zeros((len(near), pivots), np.float32)
        s[np.arange(len(near))[:, None], near] = 1
        return s

    sa = sets(near_a)
    sb = sa if b is None else sets(near_b)
    candidate = sa @ sb.T >= shared  # shared-pivot counts
    # The pair's lowest common pivots are those listed: no other list counts it.
    candidate &= sa[:, : listed[-1]] @ sb[:, : listed[-1]].T == len(listed) - 1
    if b is None:
        candidate = np.triu(candidate, 1)
        b = a
    return np.nonzero(candidate & (a @ b.T >= threshold))


def _packed(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of `dim` doubles each."""
    data = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * dim * 8 : (column.offset + len(column)) * dim * 8]
    return np.frombuffer(data.tobytes(), np.float64).reshape(-1, dim)


def _search(dim: int, pivots: int, shared: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        key, held = None, []

        def unit_done() -> pa.RecordBatch | None:
            if key is None:
                return None
            _, lo, hi, third, x, y = key
            side, v, copy, vector, nearest = (np.concatenate(c) for c in zip(*held, strict=True))
            of = {k: side == k for k in ((0,) if x == y else (0, 1))}
            if not all(m.any() for m in of.values()):
                return None
            ids, copies, vec, near = ({k: c[m] for k, m in of.items()} for c in (v, copy, vector, nearest))
            listed = tuple(sorted({p for p in (lo, hi, third) if p >= 0}))
            i, j = compare_blocks(vec[0], vec.get(1), near[0], near.get(1), listed, pivots, shared, threshold)
            if not len(i):
                return None
            side = 1 if x != y else 0
            links = np.bincount(i, weights=copies[side][j], minlength=len(ids[0]))
            back = np.bincount(j, weights=copies[0][i], minlength=len(ids[side]))
            root = {}

            def find(n: int) -> int:
                while root.setdefault(n, n) != n:
                    root[n] = root[root[n]]
                    n = root[n]
                return n

            tree_u, tree_v = [], []
            for p, q in zip(ids[0][i].tolist(), ids[side][j].tolist(), strict=True):
                rp, rq = find(p), find(q)
                if rp != rq:
                    root[max(rp, rq)] = min(rp, rq)
                    tree_u.append(p), tree_v.append(q)
            u = np.concatenate([ids[0], ids[side], np.array(tree_u, np.int64)])
            n = np.concatenate([links, back, np.zeros(len(tree_u))]).astype(np.int64)
            v = np.concatenate([np.full(len(ids[0]) + len(ids[side]), -1), np.array(tree_v, np.int64)])
            edge = np.concatenate([np.zeros(len(ids[0]) + len(ids[side]), bool), np.ones(len(tree_u), bool)])
            keep = (n > 0) | edge
            return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep]), pa.array(n[keep]), pa.array(edge[keep])], names=["u", "v", "n", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "third", "x", "y")]
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("side", "v", "copies")]
            cols += [_packed(batch.column("vector"), dim), batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)]
            turn = np.flatnonzero(np.any([np.diff(c) != 0 for c in [name, *numbers]], axis=0)) + 1
            for start, end in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
                now = (batch.column("label")[start].as_py(), *(int(c[start]) for c in numbers))
                if now != key:
                    out = unit_done()
                    if out is not None:
                        yield out
                    key, held = now, []
                held.append([c[start:end] for c in cols])
        out = unit_done()
        if out is not None:
            yield out

    return run


def embedding_components(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row.

    Vectors are compared where labels are equal and not null. A vector that is null, empty, all zero or
    holds null or non-finite components links with nothing, nor does one without a label; vectors of different lengths
    never link. Rows with equal vectors and labels link with each other. Repeated ids are rows of their own: n_links counts
    rows. A null id has a null component and kept false. Other columns are ignored.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "embeddings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = F.col("vector")
    good = e.isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0)
    good = good & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    # Adding 0.0 makes -0.0 and 0.0 one value: equal vectors have equal keys.
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double") + 0.0).alias("vector"), F.col(label).cast("string").alias("label"))
    base = base.withColumn("good", F.coalesce(good, F.lit(False)))
    keyed = base.withColumn("key", F.sha2(F.concat_ws("|", F.col("label"), F.concat_ws(",", F.transform("vector", lambda x: F.hex(x.cast("string"))))), 256))
    narrow = ws.table(keyed.select("vec_id", "good", F.when(F.col("good"), F.col("key")).alias("key")), "rows")
    classes = keyed.filter("good and vec_id is not null").groupBy("key", "label", "vector").agg(F.min("vec_id").alias("v"), F.count(F.lit(1)).alias("copies"))
    classes = ws.table(classes.withColumn("v", F.xxhash64("key")).select("key", "label", "vector", "copies", "v"), "classes")
    sizes_of = {r[0]: r[1] for r in classes.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()}
    edges, counts = None, None
    for dim in sizes_of:  # one as a rule
        own = classes.filter(F.size("vector") == dim)
        # A bounded sample: SAMPLE rows at most.
        sample = own.orderBy(F.xxhash64("v")).limit(SAMPLE).select("vector").toPandas()["vector"]
        most, nearest = index_size(sizes_of[dim])
        pivots = choose_pivots(np.array([np.asarray(x, np.float64) for x in sample]), most)
        near = min(nearest, len(pivots))
        shared = min(SHARED, near)
        described = own.select("v", "label", "copies", "vector").mapInArrow(_describe(spark.sparkContext.broadcast(pivots), near), "v long, label string, copies long, vector binary, near array<short>")
        described = ws.table(described, "described")
        if near < 2:
            pairs = [(0, 0)]
        else:
            pairs = list(combinations(range(near), 2))
        spots = F.array(*[F.struct(F.least(F.col("near")[a], F.col("near")[b]).cast("int").alias("lo"), F.greatest(F.col("near")[a], F.col("near")[b]).cast("int").alias("hi")) for a, b in pairs])
        posts = described.select("label", "v", "near", F.explode(spots).alias("s")).select("label", "s.lo", "s.hi", "v", F.filter("near", lambda p: p > F.col("s.hi")).alias("rest"))
        key = ["label", "lo", "hi"]
        sizes = posts.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        long = (F.col("m") > BLOCK) & F.lit(shared > 2)
        posts = posts.join(sizes, key).select(*key, F.explode(F.when(long, F.transform("rest", lambda p: p.cast("int"))).otherwise(F.array(F.lit(-1)))).alias("third"), "v")
        posts = ws.table(posts, "posts")
        key = ["label", "lo", "hi", "third"]
        sizes = posts.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        placed = posts.join(sizes.drop("m"), key).withColumn("block", F.pmod(F.xxhash64("v", F.lit(3)), F.col("blocks")).cast("int"))
        # Each block meets itself and all others of its list.
        units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            *key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "v"
        )
        full = units.join(described.select("v", "copies", "vector", "near"), "v")
        work = full.repartition(parts, *key, "x", "y").sortWithinPartitions(*key, "x", "y", "side")
        found = ws.table(work.mapInArrow(_search(dim, len(pivots), shared, threshold), "u long, v long, n long, edge boolean"), "found")
        own_edges, own_counts = found.filter("edge").select("u", "v"), found.filter("not edge").select("u", "n")
        edges = own_edges if edges is None else edges.union(own_edges)
        counts = own_counts if counts is None else counts.union(own_counts)
    if edges is None:
        edges = spark.createDataFrame([], "u long, v long")
        counts = spark.createDataFrame([], "u long, n long")
    stars = connected_components(edges, ws).toDF("v", "root")
    n = counts.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "v")
    smallest = keyed.filter("good and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("own"))
    named = classes.select("key", "v", "copies").join(smallest, "key").join(stars, "v", "left").join(n, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = ws.table(named, "named")
    names = named.groupBy("root").agg(F.min("own").alias("component"))
    per_class = named.join(names, "root").select("key", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = narrow.join(per_class, "key", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).select(F.col("vec_id").alias(vec_id), "n_links", "component_id", "kept")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"))


#: Every pair of a label, without an index.
OP9_SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
),
g AS MATERIALIZED (
  SELECT vec_id, label, x FROM e
  WHERE x IS NOT NULL AND label IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM g AS a JOIN g AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT reach.vec_id, links.v FROM reach JOIN links ON links.u = reach.other
),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
