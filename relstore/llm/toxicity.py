"""Toxicity by class-conditional Kneser-Ney models of letters.

Both models predict the next byte of a normalised text (letters in lower case, all else one space) from the ORDER - 1
bytes before it. A class's counts say in how many of its distinct labelled texts an n-gram stands, so that one
text or its copies weigh little. Each class discounts its counts and gives the mass to one shared backoff distribution:
the pooled n-grams, themselves interpolated with pooled continuation counts of one byte less, and so on down to single bytes.
PRIOR texts of the shared distribution stand behind each context beside the discounts, as a Dirichlet prior does. An expression
that is rare in a class has thus about the same probability in both models. An n-gram that no labelled text holds has the shared
probability times the mass that each class has freed in its context; the ratio of those masses is its evidence.

A word's evidence is the difference of its letters' log-likelihoods. A text is described by that difference in length-normalised form,
over the whole text, over its most toxic passage of WINDOW words and over its TOP most toxic words, and by its length. A logistic
curve over those, fitted on labelled rows whose texts weren't counted, gives the score.

Counting covers all labelled rows that may be learnt from. An n-gram's bytes are its key, so that none share counts. What the
driver gathers (24 bytes an n-gram) and broadcasts (12 bytes) grows with the distinct n-grams of the labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, held_out, read
from .textkernel import text_buffer

ORDER = 5
#: N-grams that a counting task holds before it passes them on.
FLUSH = 1 << 21
#: Texts of the shared distribution behind every context of a class.
PRIOR = 20
#: Words of a passage, and how many single words count.
WINDOW, TOP = 8, 5
#: Of the folds by crc32 that may be learnt from, the one that fits the curve; the others are counted.
CURVE_FOLD = 4
#: The curve is fitted on at most so many labelled rows, chosen by a hash of their id.
CURVE_ROWS = 20_000
#: A difference beyond this, a word, is as certain as it gets.
CLIP = 20.0

_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row of each): every row's letters with one space between words, before the first and after the last."""
    data, at = text_buffer(texts)
    n, length = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), length + 2)
    buffer = np.full(len(data) + 2 * n, 32, np.uint8)
    buffer[np.arange(len(data)) + 2 * np.repeat(np.arange(n), length) + 1] = _TABLE[data]
    keep = np.ones(len(buffer), bool)
    if len(buffer):
        keep[1:] = (buffer[1:] != 32) | (buffer[:-1] != 32) | (row[1:] != row[:-1])
    return buffer[keep], row[keep]


def ngrams(codes: np.ndarray, order: int) -> np.ndarray:
    """Every n-gram of `order` <= 7 bytes as a number: its bytes, the first one highest."""
    m = len(codes) - order + 1
    out = np.zeros(m, np.int64)
    for j in range(order):
        out = out << 8 | codes[j : j + m]
    return out


def _count(order: int):
    """ngram, toxic, ordinary: texts of the task that have it, in parts of about FLUSH n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own, done = None, set()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.stack([np.bincount(at, weights=np.concatenate([n[c] for _, n in held]), minlength=len(key)).astype(np.int64) for c in (0, 1)])
            return key, counts

        def batch(key: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts[1]), pa.array(counts[0])], names=["ngram", "toxic", "ordinary"])

        for part in batch_slices(batches, "text"):
            codes, row = letters(part.column("text"))
            label = part.column("label").to_numpy(zero_copy_only=False)
            # Repeated rows of an id and a text come one after the other: they count once.
            fresh = np.zeros(part.num_rows, bool)
            for i, (who, what) in enumerate(zip(zip(part.column("doc_id").to_pylist(), part.column("h1").to_pylist(), strict=True), label.tolist(), strict=True)):
                if who != own:
                    own, done = who, set()
                fresh[i] = what not in done
                done.add(what)
            if len(codes) < order:
                continue
            gram = ngrams(codes, order)
            of = row[: len(gram)]
            whole = (of == row[order - 1 :]) & fresh[of]
            key, at = np.unique(gram[whole], return_inverse=True)
            once = np.unique(of[whole] * len(key) + at)
            kind = label[once // max(len(key), 1)]
            once %= max(len(key), 1)
            held.append((key, np.stack([np.bincount(once[kind == c], minlength=len(key)) for c in (0, 1)])))
            if sum(len(k) for k, _ in held) > FLUSH:
                held = [merged()]
                if len(held[0][0]) > FLUSH // 2:
                    yield batch(*held.pop())
        if held:
            yield batch(*merged())

    return run


class Ratios(NamedTuple):
    """log p(byte | context, toxic) - log p(byte | context, ordinary), by n-gram and for other bytes by context; both ascending."""

    ngram: np.ndarray
    value: np.ndarray
    context: np.ndarray
    other: np.ndarray

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Values of n-grams; 0 where neither class has seen the context."""
        if not len(self.ngram):
            return np.zeros(len(gram), np.float32)
        at = np.minimum(np.searchsorted(self.ngram, gram), len(self.ngram) - 1)
        out = self.value[at]
        missed = np.flatnonzero(self.ngram[at] != gram)
        context = gram[missed] >> 8
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        out[missed] = np.where(self.context[at] == context, self.other[at], np.float32(0))
        return out


def _discount(n: np.ndarray) -> float:
    n1, n2 = (n == 1).sum(), (n == 2).sum()
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.75


def shared_backoff(ngram: np.ndarray, count: np.ndarray, order: int) -> np.ndarray:
    """p(last byte | the bytes before it) of distinct n-grams, ascending, by interpolated Kneser-Ney."""
    d = _discount(count)
    if order == 1:
        return (np.maximum(count - d, 0) + d * len(ngram) / 256) / count.sum()
    context = np.unique(ngram >> 8, return_inverse=True)[1]
    shorter, of = np.unique(ngram & ((1 << 8 * (order - 1)) - 1), return_inverse=True)
    # Continuation counts: distinct n-grams that end in the shorter one.
    lower = shared_backoff(shorter, np.bincount(of).astype(float), order - 1)[of]
    total, kinds = np.bincount(context, weights=count)[context], np.bincount(context)[context]
    return (np.maximum(count - d, 0) + d * kinds * lower) / total


def log_ratios(ngram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, prior: float = PRIOR) -> Ratios:
    """From the counts of distinct n-grams, ascending."""
    counts = {1: toxic.astype(float), 0: ordinary.astype(float)}
    if not counts[1].sum() or not counts[0].sum():
        return Ratios(*(np.zeros(0, t) for t in (np.int64, np.float32, np.int64, np.float32)))
    shared = shared_backoff(ngram, counts[0] + counts[1], order)
    contexts, context = np.unique(ngram >> 8, return_inverse=True)
    value, other = np.zeros(len(ngram)), np.zeros(len(contexts))
    for k, sign in ((1, 1), (0, -1)):
        c = counts[k]
        d = _discount(c[c > 0])
        mass = np.bincount(context, weights=c) + prior
        freed = (d * np.bincount(context, weights=c > 0) + prior) / mass
        value += sign * np.log(np.maximum(c - d, 0) / mass[context] + freed[context] * shared)
        other += sign * np.log(freed)
    return Ratios(ngram, value.astype(np.float32), contexts, other.astype(np.float32))


def evidence(texts: pa.Array, ratios: Ratios, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(features, words): for each text the difference a word over the whole text, in its most toxic passage and of its most
    toxic words, and the logarithm of its length."""
    n = len(texts)
    codes, row = letters(texts)
    out, words = np.zeros((n, 4)), np.zeros(n, np.int64)
    if len(codes) < order:
        return out, words
    value = ratios.of(ngrams(codes, order))
    value[row[: len(value)] != row[order - 1 :]] = 0
    # A word begins after a space, and the space after it is its end.
    starts = np.flatnonzero((codes[:-1] == 32) & (codes[1:] != 32) & (row[:-1] == row[1:])) + 1
    word = np.cumsum(np.isin(np.arange(len(codes)), starts, assume_unique=True)) - 1
    total = np.bincount(np.maximum(word[order - 1 :], 0), weights=value, minlength=len(starts)).clip(-10 * CLIP, 10 * CLIP)[: len(starts)]
    of = row[starts]
    words = np.bincount(of, minlength=n)
    some = words > 0
    if not len(starts):
        return out, words
    first = np.concatenate([[0], np.cumsum(words)])
    out[:, 0] = np.bincount(of, weights=total, minlength=n) / np.maximum(words, 1)
    sums = np.concatenate([[0.0], np.cumsum(total)])
    at = np.arange(len(total))
    end = np.minimum(at + WINDOW, first[of + 1])
    passage = (sums[end] - sums[at]) / np.maximum(end - at, WINDOW // 2)
    out[some, 1] = np.maximum.reduceat(passage, first[:-1][some])
    by = np.lexsort((-total, of))
    best = np.arange(len(by)) - first[of[by]] < TOP
    out[:, 2] = np.bincount(of[by][best], weights=total[by][best], minlength=n) / np.clip(words, 1, TOP)
    out[:, :3] = np.clip(out[:, :3], -CLIP, CLIP)
    out[:, 3] = np.log1p(words)
    return out, words


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights by Newton's method; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -20.0 if not len(y) or not y.max() else 20.0
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    ratios: Ratios
    weights: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, differences a word, words)."""
        x, words = evidence(texts, self.ratios)
        z = np.clip(self.weights[0] + x @ self.weights[1:], -700, 700)
        return 1 / (1 + np.exp(-z)), x[:, 0], words


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The models and the curve. Labels of held-out ids are never read."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).filter("fold <> 0").distinct()
    # Of rows with equal texts and labels the one with the smallest id counts: decided by hashes, before any text moves. Labels
    # grow with the corpus: sort-merge joins at every size.
    hashes = base.select("doc_id", "h1", "h2").join(known.filter(F.col("fold") != CURVE_FOLD).select("doc_id", "label").hint("merge"), "doc_id")
    chosen = hashes.groupBy("h1", "h2", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h1", "label")
    # Chosen rows have these folds only: other texts need not move.
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    taught = base.filter(F.col("doc_id").isNotNull() & ~fold.isin(0, CURVE_FOLD)).select("doc_id", "h1", "text")
    train = taught.join(chosen.hint("merge"), ["doc_id", "h1"]).select("doc_id", "h1", "text", "label")
    per_task = train.mapInArrow(_count(ORDER), "ngram long, toxic long, ordinary long")
    counts = per_task.groupBy("ngram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    ngram, toxic, ordinary = (counts.column(c).to_numpy() for c in ("ngram", "toxic", "ordinary"))
    by = np.argsort(ngram)
    ratios = log_ratios(ngram[by], toxic[by], ordinary[by])
    del counts, ngram, toxic, ordinary, by
    shared = docs.sparkSession.sparkContext.broadcast(tuple(ratios))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ratios(*shared.value)
        for part in batch_slices(batches, "text"):
            x, _ = evidence(part.column("text"), own)
            keys = ["doc_id", "h1", "h2", "label"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c.copy()) for c in x.T)], names=[*keys, "a", "b", "c", "d"])

    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    few = known.filter(F.col("fold") == CURVE_FOLD).orderBy(*order).limit(CURVE_ROWS).select("doc_id", "label")
    # CURVE_ROWS labels at most; their documents, of which ids with several texts may give more, are cut in a fixed order too.
    # Texts are described where they are read, so that only numbers are sorted and cut.
    fitting = base.join(F.broadcast(few), "doc_id").select("doc_id", "h1", "h2", "label", "text")
    described = fitting.mapInArrow(describe, f"doc_id {fitting.schema['doc_id'].dataType.simpleString()}, h1 long, h2 int, label int, a double, b double, c double, d double")
    rows = described.dropDuplicates(["doc_id", "h1", "h2", "label"]).orderBy(*order, "h1", "h2").limit(CURVE_ROWS).toPandas()
    x = np.concatenate([np.ones((len(rows), 1)), rows[["a", "b", "c", "d"]].to_numpy(float)], axis=1)
    by = np.lexsort(x.T)  # sums don't depend on the order of tasks
    return Model(ratios, fit_curve(x[by], rows["label"].to_numpy(float)[by]))


def _shared_model(docs: DataFrame, labels: DataFrame, **columns: str):
    model = fit(docs, labels, **columns)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(model.ratios), model.weights))
    return lambda: Model(Ratios(*shared.value[0]), shared.value[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, delta, words: one row per row of docs.

    Labels of held-out ids (crc32 of the id as text modulo 5 is 0) are never read; null labels teach nothing; an id
    with several labels teaches all of them, and so does a text whose rows have both labels; equal texts with equal labels
    count once. Null and empty texts have delta 0 and the score of a text without evidence. Null ids are
    scored and not held out. Without labels of both classes every score is about 0 (or 1, if all are toxic). Scores don't depend
    on how rows are dealt to tasks. Other columns are ignored. An empty table gives an empty result.
    """
    model = _shared_model(docs, labels, doc_id=doc_id, text=text, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for part in batch_slices(batches, "text"):
            score, delta, words = own.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(delta), pa.array(words)], names=["doc_id", "score", "delta", "words"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = base.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, delta double, words long")
    return scored.select(F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "delta", "words")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, each by itself whatever its id."""
    model = _shared_model(docs, labels, doc_id=doc_id, text=text)
    # Columns by place: their names may repeat.
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    name = f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model()
        for part in batch_slices(batches, name):
            yield part.filter(pc.less(pa.array(judge.score(part.column(name))[0]), 0.5))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
