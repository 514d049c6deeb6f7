"""Byte-level BPE in length-bucketed, padded numpy matrices.

Texts are split by the tokenizer's pattern. Of the pieces of a batch, the distinct ones that are neither a
token themselves nor known already are laid out as rows of matrices, one matrix for
pieces of about the same length. In each round every row merges its leftmost pair of the lowest rank; ranks of
pairs are found in a hash table; rows are compacted (what follows the merged pair moves one to the
left), and rows without a pair that has a rank leave the matrix. That gives what merging one piece after the other gives.

A piece of more than LONG bytes is a matrix of its own: its cells stand in blocks, one row each, with the lowest rank of each
block beside them. A round looks at these and moves cells of one block only, so that its cost grows with the
square root of the piece's length, not with the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batch_slices

#: Pieces that a worker remembers, the bytes they may take, and cells of one matrix.
CACHE_PIECES, CACHE_BYTES = 400_000, 64 << 20
MATRIX_CELLS = 1 << 20
#: Longer pieces are merged in blocks.
LONG = 512
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - self.bits)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, at = np.arange(len(keys)), self._home(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] == -1]
            # Of several that want the same cell, the last one written has it.
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[todo]] == keys[todo]
            self.rank[at[todo[placed]]] = rank[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is none. Cells under -1 are padding and match nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), _NONE, out)

    def rank_of(self, left: int, right: int) -> int:
        """The rank of one pair."""
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (found := self.keys[at]) != -1:
            if found == key:
                return int(self.rank[at])
            at = (at + 1) & (len(self.keys) - 1)
        return int(_NONE)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter((len(x) for x in self.tokens), np.int64, len(self.tokens))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_matrix(ids: np.ndarray, length: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge all rows to the end. ids: rows padded by -1; length: cells of each row that count."""
    ids, length = ids.copy(), length.copy()
    if ids.shape[1] < 2:
        return ids, length
    live = np.arange(len(ids))
    work = ids
    ranks = pairs.ranks(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(len(work), -1)
    while len(live):
        at = ranks.argmin(axis=1)  # the leftmost of the lowest
        row = np.arange(len(live))
        best = ranks[row, at]
        open_ = best != _NONE
        if not open_.all():
            done = live[~open_]
            ids[done, : work.shape[1]] = work[~open_]
            ids[done, work.shape[1] :] = -1
            live, work, ranks, at, best = live[open_], work[open_], ranks[open_], at[open_], best[open_]
            row = np.arange(len(live))
            if not len(live):
                break
        length[live] -= 1
        # Compaction: every row moves what follows the pair one cell to the left.
        cells = work.shape[1]
        source = np.arange(cells - 1)[None, :] + (np.arange(cells - 1)[None, :] > at[:, None])
        work = np.take_along_axis(work, source, axis=1)
        work[row, at] = best
        if cells == 2:
            ids[live, :1] = work
            ids[live, 1:] = -1
            break
        pair_source = np.minimum(source[:, :-1], cells - 2)
        ranks = np.take_along_axis(ranks, pair_source, axis=1)
        # Only the pairs on either side of the merged cell are new.
        right = at < cells - 2
        r, c = row[right], at[right]
        ranks[r, c] = pairs.ranks(work[r, c], work[r, c + 1])
        left = at > 0
        r, c = row[left], at[left] - 1
        ranks[r, c] = pairs.ranks(work[r, c], work[r, c + 1])
        longest = int(length[live].max())
        if longest < work.shape[1]:
            work, ranks = work[:, : max(longest, 1)], ranks[:, : max(longest - 1, 0)]
            if ranks.shape[1] == 0:
                ids[live, :1] = work[:, :1]
                ids[live, 1:] = -1
                break
    return ids, length


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge one long row to the end, in blocks: the row's cells in order, each block filled from the left."""
    cells = max(2, int(len(ids) ** 0.5))
    blocks = -(-len(ids) // cells)
    work = np.full(blocks * cells, -1, np.int32)
    work[: len(ids)] = ids
    ranks = np.full(blocks * cells, _NONE, np.int32)
    ranks[: len(ids) - 1] = pairs.ranks(ids[:-1], ids[1:])
    work, ranks = work.reshape(blocks, cells), ranks.reshape(blocks, cells)  # a pair stands at its left cell
    filled = [cells] * blocks
    filled[-1] = len(ids) - cells * (blocks - 1)
    # Blocks that have cells, as a chain; `blocks` and -1 end it.
    after, before = list(range(1, blocks + 1)), list(range(-1, blocks - 1))
    lowest = ranks.min(axis=1)
    while True:
        b = int(lowest.argmin())  # the leftmost block of those with the lowest rank
        best = lowest[b]
        if best == _NONE:
            break
        at = int(ranks[b].argmin())
        # The right half of the pair goes; what follows it in its block moves up.
        of, gone = (b, at + 1) if at + 1 < filled[b] else (after[b], 0)
        n = filled[of]
        work[of, gone : n - 1] = work[of, gone + 1 : n]
        ranks[of, gone : n - 1] = ranks[of, gone + 1 : n]
        work[of, n - 1], ranks[of, n - 1] = -1, _NONE
        filled[of] = n - 1
        if n == 1:
            after[b] = after[of]
            if after[of] < blocks:
                before[after[of]] = b
        work[b, at] = best
        # Only the pairs on either side of the merged cell are new.
        if at + 1 < filled[b]:
            ranks[b, at] = pairs.rank_of(int(best), int(work[b, at + 1]))
        elif after[b] < blocks:
            ranks[b, at] = pairs.rank_of(int(best), int(work[after[b], 0]))
        else:
            ranks[b, at] = _NONE
        if at:
            ranks[b, at - 1] = pairs.rank_of(int(work[b, at - 1]), int(best))
        elif (p := before[b]) >= 0:
            ranks[p, filled[p] - 1] = pairs.rank_of(int(work[p, filled[p] - 1]), int(best))
            lowest[p] = ranks[p].min()
        lowest[b] = ranks[b].min()
        if of != b:
            lowest[of] = ranks[of].min()
    return work[work >= 0]


def _width(n: int) -> int:
    """The bucket of a length: up to a quarter of a row is padding."""
    if n <= 8:
        return n
    step = 1 << max(0, n.bit_length() - 3)
    return -(-n // step) * step


class Encoder:
    """Encodes with a bounded memory of pieces; one a worker."""

    def __init__(self, path: str, pattern: str, cache_pieces: int = CACHE_PIECES):
        self.vocab = vocabulary(path)
        self.split = regex.compile(pattern)
        self.limit = cache_pieces
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: Iterable[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            self.held += 5 * len(raw)  # itself, and four bytes an id at most for each of its own
            whole = self.vocab.ranks.get(raw)
            if whole is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[p] = merge_long(self.vocab.byte_ids[np.frombuffer(raw, np.uint8)], self.vocab.pairs).astype("<u4").tobytes()
            else:
                buckets.setdefault(_width(len(raw)), []).append((p, raw))
        for width, items in buckets.items():
            rows = max(1, MATRIX_CELLS // width)
            for i in range(0, len(items), rows):
                part = items[i : i + rows]
                ids = np.full((len(part), width), -1, np.int32)
                length = np.fromiter((len(raw) for _, raw in part), np.int64, len(part))
                cells = np.arange(width)[None, :] < length[:, None]
                ids[cells] = self.vocab.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                ids, length = merge_matrix(ids, length, self.vocab.pairs)
                flat = ids.astype("<u4")
                for (p, _), row, n in zip(part, flat, length, strict=True):
                    self.known[p] = row[:n].tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        pieces = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > self.limit or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        new = {p for x in pieces for p in x if p not in known}
        if new:
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, x)) for x in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row.

    Whole texts; null and empty texts have no tokens. A row in, a row out: repeated rows and null ids stay. Other
    columns of the input are left out. A worker holds about a megabyte of texts at a time (or one text, if
    that is longer) and a bounded memory of pieces. `vocabulary_path` is read on the executors.
    """
    fields = [docs.schema[doc_id].simpleString().split(":", 1)[1]]
    schema = f"`{doc_id}` {fields[0]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path, pattern)
        for part in batch_slices(batches, text):
            coded = encoder.encode_batch(part.column(text).to_pylist())
            columns = [
                part.column(doc_id),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in coded], pa.string()),
            ]
            if ids:
                columns.append(pa.array(coded, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def decode_ids(coded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the bytes that the ids stand for."""
    fields = [f for f in coded.schema.fields if f.name != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(vocabulary_path).tokens
        for part in batch_slices(batches, ids):
            raw = [b"" if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + [pa.array(raw, pa.binary())], names=[f.name for f in fields] + ["decoded"])

    return coded.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
