"""Token counts by section, by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' byte lengths give each token's span of characters (a token that begins
or ends inside a character covers that character), and spans are joined to the sections' intervals. A token that lies in
several sections goes to one of them by an explicit rule:

* first: the section of its first character (the next section after it, if that lies in none);
* last: the section of its last character (the one before it, if that lies in none);
* most: the section it has most characters in, the earlier one of equals.

A token that touches no section is counted under section null. So the counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Encoder
from .common import batch_slices, read

RULE = "first"


def lines(text: str) -> list[tuple[int, int]]:
    """Lines with their line feed; an empty text is one empty line."""
    ends = list(accumulate(len(x) + 1 for x in text.split("\n")))
    ends[-1] -= 1  # the last line has no line feed
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def token_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last, from the tokens' lengths in bytes."""
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    end = np.cumsum(lengths)
    return char[end - lengths], char[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = RULE) -> np.ndarray:
    """The section of each token, -1 for none. sections: (begin, end) in order, without overlaps; empty ones get nothing."""
    n = len(sections)
    out = np.full(len(start), -1, np.int64)
    full = np.flatnonzero(sections[:, 1] > sections[:, 0]) if n else np.zeros(0, np.int64)
    if not len(full) or not len(start):
        return out
    begin, stop = sections[full, 0], sections[full, 1]
    lo = np.searchsorted(stop, start, side="right")  # the first section that ends after the token begins
    hi = np.searchsorted(begin, end, side="left") - 1  # the last one that begins before the token ends
    some = lo <= hi
    if rule == "first":
        pick = lo
    elif rule == "last":
        pick = hi
    elif rule == "most":
        pick = lo.copy()
        for i in np.flatnonzero(some & (hi > lo)):
            part = slice(lo[i], hi[i] + 1)
            pick[i] = lo[i] + int(np.argmax(np.minimum(stop[part], end[i]) - np.maximum(begin[part], start[i])))
    else:
        raise ValueError(f"no such rule: {rule}")
    out[some] = full[pick[some]]
    return out


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    sections: Callable[[str], list[tuple[int, int]]] = lines,
    rule: str = RULE,
) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing: a row for each section of each row of docs.

    Sections are numbered from 0 in the order of `sections(text)`, which must not overlap; a further row with section null
    is there only if tokens touch no section. n_crossing counts those of n_tokens that reach into another section or out of all.
    Null text is empty text: one section without tokens. Rows stay rows of their own whatever their ids; other columns
    are ignored. A worker holds about a megabyte of texts at a time, or one text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path, pattern)
        for part in batch_slices(batches, text):
            texts = [t or "" for t in part.column(text).to_pylist()]
            row, number, begins, ends, counts, crossing = [], [], [], [], [], []
            for i, (t, coded) in enumerate(zip(texts, encoder.encode_batch(texts), strict=True)):
                spans = np.array(sections(t), np.int64).reshape(-1, 2)
                start, end = token_spans(t.encode("utf-8", "surrogatepass"), encoder.vocab.lengths[np.frombuffer(coded, "<u4")]) if coded else (np.zeros(0, np.int64),) * 2
                of = attribute(start, end, spans, rule)
                n = np.bincount(of + 1, minlength=len(spans) + 1)
                inside = of >= 0
                cross = np.zeros(len(of), bool)
                cross[inside] = (start[inside] < spans[of[inside], 0]) | (end[inside] > spans[of[inside], 1])
                x = np.bincount(of[cross] + 1, minlength=len(spans) + 1)
                row += [i] * len(spans)
                number += range(len(spans))
                begins += spans[:, 0].tolist()
                ends += spans[:, 1].tolist()
                counts += n[1:].tolist()
                crossing += x[1:].tolist()
                if n[0]:
                    row.append(i), number.append(None), begins.append(None), ends.append(None), counts.append(int(n[0])), crossing.append(0)
            yield pa.RecordBatch.from_arrays(
                [part.column(doc_id).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (number, begins, ends, counts, crossing)],
                names=[doc_id, "section", "char_start", "char_end", "n_tokens", "n_crossing"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
