"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact length in words; the histogram has a row per source and length.
2. Sources get targets in proportion to their weights; what exceeds a source's cap is shared again among the others.
3. For each source, whole copies of all documents come first (`base`). The remaining budget is filled from the histogram:
   each length gets its proportional share, rounded down, the largest lengths top that up as long as they fit, and a
   bounded-knapsack dynamic programme over what is then left of the histogram hits the rest of the budget, or comes as near below as
   any choice can. One histogram is at most as long as the number of distinct lengths, not of documents.
4. Of each length as many documents are chosen as the fit says, by a seeded hash. Ranks come from counts of hash buckets, so that a
   length that a third of all rows have is ranked in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, read

#: Weights of sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: What the mix takes of all words, and of one source at most.
TOTAL, CAP = 1.5, 2.0
#: Words that the knapsack fits exactly; the greedy part leaves at most so many.
KNAPSACK_WORDS = 20_000
#: Hash buckets of one length.
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share `total` by weight; nobody gets more than cap times its size, and the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    for i in range(len(sizes)):
        out[i] = 0.0
    left = total
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, so that their sum is as near to the budget as can be without exceeding it.

    Sums that the first k lengths can reach are bits of an integer; a bounded count is split in powers of two.
    """
    items, reach, states = [], 1, []
    full = (1 << (budget + 1)) - 1
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        c = min(c, budget // n) if n else 0
        part = 1
        while c > 0:
            k = min(part, c)
            items.append((i, k, n * k))
            states.append(reach)
            reach |= (reach << (n * k)) & full
            c, part = c - k, part * 2
        if reach >> budget & 1:
            break
    out, at = [0] * len(lengths), reach.bit_length() - 1
    for (i, k, n), before in zip(reversed(items), reversed(states), strict=True):
        if not before >> at & 1:
            out[i] += k
            at -= n
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length (all positive) to take for `budget` words."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # In Python integers: a product may exceed 64 bits.
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= limit:
            break
        k = min(int(counts[i] - take[i]), (left - limit // 2) // int(lengths[i]))
        if k > 0:
            take[i] += k
            left -= k * int(lengths[i])
    rest = counts - take
    use = np.flatnonzero((rest > 0) & (lengths <= left))
    # Short lengths last: they close the gap. Any order reaches the same sums.
    use = use[np.argsort(-lengths[use], kind="stable")]
    more = knapsack(lengths[use].tolist(), rest[use].tolist(), left)
    take[use] += np.array(more, np.int64)
    return take


def _ranked(docs: DataFrame, source: str, text: str, doc_id: str, seed: int) -> DataFrame:
    """docs with __source (never null), __size, __rank and __bucket. Rows without an id, or with the same, differ by their texts."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.withColumn("__source", key).withColumn("__size", word_count(F.col(text))).withColumn("__rank", F.xxhash64(F.col(doc_id), F.xxhash64(text), F.lit(seed)))
    return rows.withColumn("__bucket", F.pmod(F.shiftright("__rank", 20), F.lit(BUCKETS)).cast("int"))


def mix_plan(rows: DataFrame, weights: Iterable[float], total: float, cap: float, ws: Workspace) -> DataFrame:
    """From ranked rows: __source, __size, __bucket, first, base, take, __source_size, __target."""
    spark, weights = rows.sparkSession, list(weights)
    rows = rows.select(F.when(F.col("__source") != "n", F.substring("__source", 2, 1 << 30)).alias("source"), F.col("__size").alias("size"), F.col("__bucket").alias("bucket"))
    cells = ws.table(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "cells")
    histogram = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).toPandas()  # a row per source
    by_source = by_source.sort_values("source", key=lambda s: s.map(lambda x: (x is None, (x or "").encode("utf-8", "surrogatepass"))))
    sizes = [int(x) for x in by_source["words"]]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total * sum(sizes), cap)
    plan = pd.DataFrame({"source": by_source["source"].tolist(), "words": sizes, "target": goal}).astype({"words": "int64", "target": "float64"})
    goals = spark.createDataFrame([tuple(r) for r in plan.itertuples(index=False)], "source string, words long, target double")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        words, target = int(pdf["words"].iloc[0]), float(pdf["target"].iloc[0])
        base = int(target // words) if words else 0
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        some = pdf["size"].to_numpy(np.int64) > 0
        take = np.zeros(len(pdf), np.int64)
        lengths, counts = pdf["size"].to_numpy(np.int64)[some], pdf["n"].to_numpy(np.int64)[some]
        if words:
            take[some] = fit(lengths, counts, round(target) - base * words)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "base": base, "take": take})

    matched = histogram.join(goals, histogram["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    fits = matched.groupBy("source").applyInPandas(fitted, "source string, size long, base long, take long")
    # Where a bucket's documents begin in the order of their length; BUCKETS rows a length at most.
    first = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = fits.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "base", "take")
    chosen = cells.withColumn("first", first).join(f, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size"))).select("source", "size", "bucket", "n", "first", "base", "take")
    chosen = ws.table(chosen.join(goals.select(F.col("source").alias("g_source"), "words", "target"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source"), "chosen")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return chosen.select(key.alias("__source"), F.col("size").alias("__size"), F.col("bucket").alias("__bucket"), "first", "base", "take", F.col("words").alias("__source_size"), F.col("target").alias("__target"))


def _with_copies(rows: DataFrame, plan: DataFrame, doc_id: str) -> DataFrame:
    """Ranked rows with __copies: how often each row is taken. Rows move once, as window and join have the same keys."""
    cell = ["__source", "__size", "__bucket"]
    ranked = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*cell).orderBy("__rank", doc_id)))
    copies = F.col("base") + (F.col("first") + F.col("__place") <= F.col("take")).cast("long")
    return ranked.join(plan.hint("merge"), cell).withColumn("__copies", copies)


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Iterable[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 7
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: one row per row of docs.

    taken = copies * size. Null texts have size 0. Sources are ordered by code point, null last and a source like any
    other. A source without words has target 0. Documents of size 0 come along with every whole copy of their source.
    Repeated rows are documents of their own; equal rows can't be told apart, so any of them are chosen. Rows without an
    id are ranked by their texts. Other columns are ignored. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    narrow = _ranked(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "source", "text", "doc_id", seed).drop("text")
    rows = ws.table(narrow, "sizes")
    taken = _with_copies(rows, mix_plan(rows, weights, total, cap, ws), "doc_id")
    return taken.select(
        F.col("doc_id").alias(doc_id),
        F.col("source").alias(source),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
        F.col("__copies").alias("copies"),
    )


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Iterable[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 7
) -> DataFrame:
    """The rows of the mix, each as often as it is taken: decided row by row, as in mix_sources, whatever the ids are."""
    ws = Workspace(docs.sparkSession, "mixed-documents")
    # Columns by place: their names may be those of results.
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    ids, sources, texts = (f"c{docs.columns.index(c)}" for c in (doc_id, source, text))
    rows = _ranked(own, sources, texts, ids, seed)
    plan = mix_plan(ws.table(rows.select("__source", "__size", "__bucket"), "sizes"), weights, total, cap, ws)
    taken = _with_copies(rows, plan, ids).filter("__copies > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*own.columns).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
