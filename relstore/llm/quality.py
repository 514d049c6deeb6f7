"""A quality classifier by co-training on two views of a document.

* Content: relative frequencies of byte trigrams of the text, in WIDTH slots by hash.
* Metadata: language, source, length and the page's shape (lines, their lengths and repeats; shares of capitals, digits and signs).
  It holds nothing of which words or letters stand in the text, and the content view nothing of length, layout, language or source,
  so that given the label either says little about the other.

Both are logistic models. They begin with the labelled rows. In each round, each model labels those of all unlabelled documents that
it is surest of, as many of either label as their shares say, and gives them to the other model, which learns them too. At
the end each view is calibrated on labelled rows that neither has learnt from, and a document's score is the mean of the two
calibrated log-odds, as a probability. All documents are scored.

Labelled rows are a bounded sample, chosen by a hash of the id. Unlabelled ones are all scored in every round, in the executors,
and what is given grows with them: GIVEN of every POOL. A model learns its gifts in blocks of about POOL rows by a hash, each with all labelled
rows at one block's share of weight; the blocks' objectives add up to the whole one, and the model is the mean of theirs
by size (exact for one block, else an approximation). No state is kept by row: what earlier rounds gave away follows from their models and cuts.
The texts are read once for all rounds: a table holds each unlabelled row's exact trigram counts by slot and its metadata, and rounds read that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch_slices, held_out, read
from .textkernel import mix, text_buffer
from .toxicity import fit_curve

WIDTH, META = 2048, 96
LABELLED = 6000
#: In each round a model gives away GIVEN of every POOL unlabelled documents.
POOL, ROUNDS, GIVEN = 4000, 5, 200
#: Sureness is ranked in steps of 1 / STEPS log-odds up to LIMIT; in the last step, a hash chooses.
STEPS, LIMIT = 1024, 32
#: Of the folds by crc32 that may be learnt from, the one that calibrates.
CALIBRATION_FOLD = 4
SCALE, RIDGE = 30.0, 1e-4
#: Rows whose counts are spread out over all slots at once.
SPREAD = 512
_UPPER, _DIGIT, _SIGN, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN[33:127] = True
_SIGN &= ~(_LETTER | _DIGIT)


def trigrams(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(slot, row) of every byte trigram, and the number of rows."""
    data, at = text_buffer(texts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(at) - 1
    wide = data.astype(np.uint64)
    slot = (mix(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) >> np.uint64(20)) % np.uint64(width)
    own = row[:-2] == row[2:]
    return slot[own].astype(np.int64), row[:-2][own], len(at) - 1


def metadata(texts: pa.Array, lang: list, source: list) -> np.ndarray:
    """A row of META features a text."""
    data, at = text_buffer(texts)
    n, size = len(at) - 1, np.diff(at).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    share = lambda kind: np.bincount(row[kind[data]], minlength=n) / np.maximum(size, 1)
    out = np.zeros((n, META), np.float64)
    breaks = data == 10
    count = np.bincount(row[breaks], minlength=n) + 1.0
    spaces = np.bincount(row[data == 32], minlength=n)
    for i in range(n):
        parts = data[at[i] : at[i + 1]].tobytes().split(b"\n")
        out[i, 7] = 1 - len(set(parts)) / len(parts)
    out[:, 0] = np.log1p(size) / 10
    out[:, 1] = np.log1p(count) / 5
    out[:, 2] = np.log1p(size / count) / 10
    out[:, 3], out[:, 4], out[:, 5] = share(_UPPER) * 5, share(_DIGIT) * 5, share(_SIGN) * 5
    out[:, 6] = np.log1p(size / (spaces + count)) / 5
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        out[i, 16 + zlib.crc32(str(a).encode()) % 16] = 1
        out[i, 32 + zlib.crc32(str(b).encode()) % (META - 32)] = 1
    return out


def blobs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: bytes at[i] to at[i + 1] of the data."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pack_content(texts: pa.Array) -> pa.Array:
    """A row's trigram counts by slot, exactly: pairs of 16 bits, a slot's distance from the one before and a count (a larger one in several pairs)."""
    slot, row, n = trigrams(texts)
    counts = np.bincount(row * WIDTH + slot, minlength=n * WIDTH)
    cell = np.flatnonzero(counts)
    count, (row, slot) = counts[cell], np.divmod(cell, WIDTH)
    times = (count + 0xFFFE) // 0xFFFF
    if len(times) and times.max() > 1:
        last = np.cumsum(times) - 1
        row, slot = np.repeat(row, times), np.repeat(slot, times)
        rest = count - 0xFFFF * (times - 1)
        count = np.full(len(row), 0xFFFF)
        count[last] = rest
    first = np.searchsorted(row, np.arange(n + 1))
    gap = np.diff(slot, prepend=0)
    begins = first[:-1][np.diff(first) > 0]
    gap[begins] = slot[begins]
    return blobs(np.stack([gap, count], axis=1).astype("<u2"), first * 4)


def unpack_content(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(slot, row, count) of pack_content()'s pairs, and the number of rows."""
    data, at = text_buffer(packed)
    pairs, first = data.view("<u2").reshape(-1, 2), at // 4
    size = np.diff(first)
    slot = np.cumsum(pairs[:, 0], dtype=np.int64)
    begins = first[:-1][size > 0]
    slot -= np.repeat(slot[begins] - pairs[begins, 0], size[size > 0])
    return slot, np.repeat(np.arange(len(size)), size), pairs[:, 1].astype(float), len(size)


#: What metadata() holds of a row, without its zeros.
_META = np.dtype([("shape", "<f8", 8), ("lang", "u1"), ("source", "u1")])


def pack_metadata(meta: np.ndarray) -> pa.Array:
    out = np.empty(len(meta), _META)
    out["shape"], out["lang"], out["source"] = meta[:, :8], meta[:, 16:32].argmax(axis=1), meta[:, 32:].argmax(axis=1)
    return blobs(out.view(np.uint8), np.arange(len(meta) + 1) * _META.itemsize)


def unpack_metadata(packed: pa.Array) -> np.ndarray:
    rows = text_buffer(packed)[0].view(_META)
    out = np.zeros((len(rows), META), np.float64)
    out[:, :8] = rows["shape"]
    out[np.arange(len(rows)), 16 + rows["lang"].astype(int)] = 1
    out[np.arange(len(rows)), 32 + rows["source"].astype(int)] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 200, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last constant, by accelerated gradient descent; weight: of the rows, 1 by default."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    y = y.astype(x1.dtype)
    w = np.zeros(x1.shape[1], x1.dtype)  # of the rows' precision: mixed products would copy all rows
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    of = np.ones(len(y), x1.dtype) if weight is None else weight.astype(x1.dtype)
    size = of.sum(dtype=float)
    # Power iterations bound the curvature.
    v = np.full(x1.shape[1], 1 / np.sqrt(x1.shape[1]), x1.dtype)
    for _ in range(20):
        v = x1.T @ (of * (x1 @ v))
        top = float(np.linalg.norm(v))
        v /= x1.dtype.type(top)
    rate = x1.dtype.type(1 / (0.25 * top / size * 1.05 + ridge))
    last, t = w.copy(), 1.0
    for _ in range(steps):
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + x1.dtype.type((t - 1) / u) * (w - last)
        t = u
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        g = x1.T @ (of * (p - y)) / x1.dtype.type(size) + x1.dtype.type(ridge) * ahead
        last, w = w, ahead - rate * g
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS, given: int = GIVEN, ridges: tuple[float, float] = (1e-4, 1e-4)) -> list[np.ndarray]:
    """Weights of both views, in one process; co_train_all() does this to a table."""
    learnt = [(views[k], y.astype(float)) for k in (0, 1)]
    left = np.ones(len(pools[0]), bool)
    share = float(y.mean()) if len(y) else 0.5
    weights = [fit_logistic(*learnt[k], ridges[k]) for k in (0, 1)]
    for _ in range(rounds):
        if not left.any() or share in (0.0, 1.0):
            break
        gifts = []
        for k in (0, 1):
            at = np.flatnonzero(left)
            z = odds(pools[k][at], weights[k])
            by = np.argsort(z, kind="stable")
            ones, zeros = max(1, round(given * share)), max(1, round(given * (1 - share)))
            yes, no = by[::-1][:ones], by[:zeros]
            yes, no = yes[z[yes] > 0], no[z[no] < 0]
            gifts.append((at[np.concatenate([yes, no])], np.concatenate([np.ones(len(yes)), np.zeros(len(no))])))
        for k in (0, 1):
            rows, labels = gifts[1 - k]
            learnt[k] = (np.concatenate([learnt[k][0], pools[k][rows]]), np.concatenate([learnt[k][1], labels]))
        for rows, _ in gifts:
            left[rows] = False
        weights = [fit_logistic(*learnt[k], ridges[k]) for k in (0, 1)]
    return weights


def _frequencies(slot: np.ndarray, row: np.ndarray, count: np.ndarray | None, n: int) -> np.ndarray:
    counts = np.bincount(row * WIDTH + slot, weights=count, minlength=n * WIDTH).reshape(n, WIDTH)
    return (counts * SCALE / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float16)


def content_view(texts: pa.Array) -> np.ndarray:
    slot, row, n = trigrams(texts)
    return _frequencies(slot, row, None, n)


def packed_view(packed: pa.Array) -> np.ndarray:
    """content_view() of the texts, from pack_content()."""
    out = np.empty((len(packed), WIDTH), np.float16)
    for i in range(0, len(packed), SPREAD):
        slot, row, count, n = unpack_content(packed.slice(i, SPREAD))
        out[i : i + n] = _frequencies(slot, row, count, n)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the samples: label and both views as blobs."""
    for part in batch_slices(batches, "text"):
        content = content_view(part.column("text"))
        meta = metadata(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist()).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [part.column("label"), part.column("fold"), pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())],
            names=["label", "fold", "content", "meta"],
        )


def _sureness(part: pa.RecordBatch, models: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Log-odds of the rows by both views, for each pair of models. The same for a row whatever rows it comes with."""
    slot, row, count, n = unpack_content(part.column("content"))
    size = np.maximum(np.bincount(row, weights=count, minlength=n), 1)
    meta = unpack_metadata(part.column("meta"))
    return [[np.bincount(row, weights=c[:-1][slot] * count, minlength=n) * SCALE / size + c[-1], (meta * m[:-1]).sum(axis=1) + m[-1]] for c, m in models]


def _steps(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -LIMIT, LIMIT) * STEPS).astype(np.int64)


def cut(step: np.ndarray, count: np.ndarray, wanted: int) -> tuple[int, float]:
    """(step, share): rows above the step and a share of those in it are about `wanted`; steps ascend."""
    above = np.cumsum(count[::-1])[::-1] - count
    if not len(step) or above[0] + count[0] <= wanted:
        return -(1 << 40), 1.0
    at = int(np.flatnonzero(above < wanted)[0])
    return int(step[at]), (wanted - above[at]) / count[at]


def _verdicts(z: np.ndarray, chance: np.ndarray, cuts: tuple) -> np.ndarray:
    """1 or 0 for rows that a model gives away with that label, else -1."""
    out = np.full(len(z), -1)
    for label, (step, share) in zip((1, 0), cuts, strict=True):
        own = _steps(z if label else -z)
        out[((z > 0) if label else (z < 0)) & ((own > step) | ((own == step) & (chance < share)))] = label
    return out


def _unlabelled(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column("id_hash").fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        same = known[at] == h if len(known) else np.zeros(len(h), bool)
        yield from batch_slices([batch.filter(pa.array(~(same & batch.column("id_hash").is_valid().to_numpy(zero_copy_only=False))))], "text")


def _profiles(known_b):
    """row_hash, content, meta: the unlabelled rows as the rounds read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _unlabelled(batches, known_b.value):
            for i in range(0, whole.num_rows, SPREAD):
                part = whole.slice(i, SPREAD)
                meta = metadata(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row_hash"), pack_content(part.column("text")), pack_metadata(meta)], names=["row_hash", "content", "meta"])

    return run


def _given(part: pa.RecordBatch, rounds: list, after: list | None = None) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """([verdicts of either model in the round that took the row], still left, log-odds of the models `after`)."""
    models = [r[0] for r in rounds] + ([after] if after else [])
    z = _sureness(part, models)
    chance = (part.column("row_hash").to_numpy() & 0xFFFFF) / float(1 << 20)
    left, found = np.ones(part.num_rows, bool), [np.full(part.num_rows, -1) for _ in (0, 1)]
    for (_, cuts), own in zip(rounds, z[: len(rounds)], strict=True):
        said = [np.where(left, _verdicts(own[k], chance, cuts[k]), -1) for k in (0, 1)]
        for k in (0, 1):
            found[k] = np.where(said[k] >= 0, said[k], found[k])
        left &= (said[0] < 0) & (said[1] < 0)
    return found, left, z[-1] if after else []


def _histogram(state_b):
    """view, step, count of the unlabelled rows that no round has taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rounds, models), width = state_b.value, LIMIT * STEPS
        counts = np.zeros((4, 2 * width + 1), np.int64)
        for part in batch_slices(batches, "content"):
            _, left, z = _given(part, rounds, models)
            for k in (0, 1):
                for label, signed in ((0, -z[k]), (1, z[k])):
                    counts[2 * k + label] += np.bincount(_steps(signed[left]) + width, minlength=2 * width + 1)
        kind, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(step - width), pa.array(counts[kind, step])], names=["kind", "step", "n"])

    return run


def _gifts(state_b):
    """view, block, row_hash, label, features: what each view learns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, blocks = state_b.value
        for part in batch_slices(batches, "content"):
            found, _, _ = _given(part, rounds)
            for k in (0, 1):
                at = np.flatnonzero(found[1 - k] >= 0)
                if not len(at):
                    continue
                rows = part.take(pa.array(at))
                h = rows.column("row_hash").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k)), pa.array((h >> 20) % blocks[k]), rows.column("row_hash"), pa.array(found[1 - k][at]), rows.column("meta" if k else "content")],
                    names=["view", "block", "row_hash", "label", "features"],
                )

    return run


def _fit_block(labelled_b, blocks: list[int]):
    """view, rows, weights of one block of gifts with all labelled rows."""

    def run(table: pa.Table) -> pa.Table:
        views, y = labelled_b.value
        k = table.column("view")[0].as_py()
        table = table.sort_by([("row_hash", "ascending"), ("label", "ascending")])
        packed = table.column("features").combine_chunks()
        own = unpack_metadata(packed).astype(np.float32).astype(views[k].dtype) if k else packed_view(packed).astype(np.float32)
        x = np.concatenate([views[k].astype(own.dtype), own])
        weight = np.concatenate([np.full(len(y), 1 / blocks[k]), np.ones(len(table))])
        w = fit_logistic(x, np.concatenate([y, table.column("label").to_numpy()]), RIDGE, weight=weight)
        return pa.table({"view": pa.array([k]), "rows": pa.array([len(table)]), "weights": pa.array([w.astype(float).tolist()])})

    return run


def id_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def co_train_all(docs: DataFrame, known: np.ndarray, views: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of both views; every document whose id's hash isn't `known` (ascending) can be given."""
    sc = docs.sparkSession.sparkContext
    share = float(y.mean()) if len(y) else 0.5
    models = [fit_logistic(v, y.astype(float), RIDGE) for v in views]
    if share in (0.0, 1.0) or not len(y):
        return models
    hashed = docs.select(F.xxhash64("doc_id", "text", "lang", "source").alias("row_hash"), F.when(F.col("doc_id").isNotNull(), id_hash()).alias("id_hash"), "text", "lang", "source")
    ws = Workspace(docs.sparkSession, "cotrain")
    pool = ws.table(hashed.mapInArrow(_profiles(sc.broadcast(known)), "row_hash long, content binary, meta binary"), "profiles", compression="zstd")
    labelled_b = sc.broadcast(([views[0].astype(np.float16), views[1]], y))
    past: list = []
    wanted: tuple[int, int] | None = None
    total = [0, 0]  # what each view was given
    for _ in range(rounds):
        # At most 4 * (2 * LIMIT * STEPS + 1) rows.
        found = pool.mapInArrow(_histogram(sc.broadcast((past, models))), "kind long, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
        if not len(found):
            break
        if wanted is None:
            given = found["n"][found["kind"] == 0].sum() * GIVEN / POOL
            wanted = max(1, round(given * share)), max(1, round(given * (1 - share)))
        pick = lambda k, label: found[(found["kind"] == 2 * k + label) & (found["step"] >= 0)]
        cuts = [tuple(cut(*(pick(k, label)[c].to_numpy() for c in ("step", "n")), n) for label, n in ((1, wanted[0]), (0, wanted[1]))) for k in (0, 1)]
        past = [*past, (models, cuts)]
        for k in (0, 1):
            total[1 - k] += sum(min(n, int(pick(k, label)["n"].sum())) for label, n in ((1, wanted[0]), (0, wanted[1])))
        blocks = [max(1, round(n / POOL)) for n in total]
        gifts = pool.mapInArrow(_gifts(sc.broadcast((past, blocks))), "view long, block long, row_hash long, label long, features binary")
        fitted = gifts.groupBy("view", "block").applyInArrow(_fit_block(labelled_b, blocks), "view long, rows long, weights array<double>").toPandas()
        models = list(models)
        for k in (0, 1):
            own = fitted[fitted["view"] == k].sort_values("rows")
            if len(own):
                models[k] = np.average(np.stack(own["weights"].to_list()), axis=0, weights=own["rows"]).astype(models[k].dtype)
    ws.close()
    return models


def _scores(weights_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (content_w, meta_w), ((a0, b0), (a1, b1)) = weights_b.value
        for part in batch_slices(batches, "text"):
            slot, row, n = trigrams(part.column("text"))
            size = np.maximum(np.bincount(row, minlength=n), 1)
            content = np.bincount(row, weights=content_w[:-1][slot], minlength=n) * SCALE / size + content_w[-1]
            meta = odds(metadata(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist()), meta_w)
            z0, z1 = np.clip(a0 + b0 * content, -30, 30), np.clip(a1 + b1 * meta, -30, 30)
            p = lambda z: pa.array(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), p(z0), p(z1), p((z0 + z1) / 2)], names=["doc_id", "content_score", "metadata_score", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted, content_score, metadata_score: one row per row of docs.

    Labels of held-out ids are never read; null labels teach nothing; an id with both labels teaches both. Null text is empty text; null
    language or source is a value like others, and a table without those columns has null there. Rows that repeat id and text
    are taught once and scored each; equal rows have equal scores. Null ids are scored. Without labels of both kinds, scores are those of the one kind, or 0.5.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    given = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), given("lang"), given("source"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).withColumn("fold", fold)
    order = F.xxhash64("doc_id", F.lit(4))
    taught = known.filter("fold <> 0").orderBy(order, "doc_id", "label").limit(LABELLED)
    chosen = ws.table(taught, "chosen")
    # 8 bytes a labelled id: without them, every round would shuffle all texts.
    ids = np.sort(known.select(id_hash().alias("h")).distinct().toArrow().column("h").to_numpy())
    # LABELLED labels at most; rows that repeat id, text and label count once, and of what ids with several texts give a fixed order takes as many.
    row = ["doc_id", "label", F.xxhash64("text", "lang", "source").alias("h")]
    sample = base.join(F.broadcast(chosen), "doc_id").select(*row, "text", "lang", "source", "fold").dropDuplicates(["doc_id", "label", "h"])
    sample = sample.orderBy(order, "doc_id", "label", "h").limit(LABELLED).select("text", "lang", "source", "label", "fold")
    got = sample.mapInArrow(_features, "label int, fold long, content binary, meta binary").toPandas()
    views = [
        np.frombuffer(b"".join(got["content"]), np.float16).reshape(-1, WIDTH).astype(np.float32),
        np.frombuffer(b"".join(got["meta"]), np.float32).reshape(-1, META).astype(np.float64),
    ]
    y = got["label"].to_numpy(int)
    teach, tune = got["fold"].to_numpy(int) != CALIBRATION_FOLD, got["fold"].to_numpy(int) == CALIBRATION_FOLD
    # In a fixed order, so that reruns agree.
    by = np.lexsort([got["content"].map(zlib.crc32).to_numpy(), got["meta"].map(zlib.crc32).to_numpy()])
    views, y, teach, tune = [v[by] for v in views], y[by], teach[by], tune[by]
    weights = co_train_all(base, ids, [v[teach] for v in views], y[teach])
    curves = []
    for k in (0, 1):
        z = odds(views[k][tune], weights[k])
        fitted = len(z) and 0 < y[tune].mean() < 1
        curves.append(fit_curve(np.stack([np.ones(len(z)), z], axis=1), y[tune].astype(float), ridge=1e-2) if fitted else np.array([0.0, 1.0]))
    del views, got
    scored = base.mapInArrow(_scores(spark.sparkContext.broadcast((weights, curves))), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, content_score double, metadata_score double, score double")
    return scored.select(
        F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "content_score", "metadata_score"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
