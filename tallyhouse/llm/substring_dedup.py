"""Remove words covered by a word sequence that occurs more than once, found by difference-cover anchors.

Only word grams that start at cover positions modulo ``period`` are hashed. For any two places there is a shift below
the period that moves both onto cover positions, so two equal windows share an aligned anchor. Phrases are the windows
around one anchor; extension settles which of them are equal (see :mod:`tallyhouse.llm.repeats`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.hashing import Prefix, mix, word_hashes, word_spans
from tallyhouse.llm.repeats import CROWD, _merged, repeated_windows
from tallyhouse.llm.stage import column_of, identified, split_bytes

LENGTH = 35
PERIOD = 21
# Bytes of text that are hashed, or cut, at a time: arrays of words take many times as much.
BLOCK = 1 << 20


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences reach every number modulo ``period``."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be positive")


def word_phrases(data: np.ndarray, offsets: np.ndarray, length: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """All windows around each anchor of each text, hashed in runs of texts of at most ``BLOCK`` bytes, or one longer
    text, so that the sums and the powers that a task remembers stay small."""
    found, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        own = offsets[first : last + 1]
        row, *rest = _phrases_of(data[own[0] : own[-1]], own - own[0], length, period, cover)
        found.append((row + first, *rest))
        first = last
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _phrases_of(data: np.ndarray, offsets: np.ndarray, length: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    begin, end = word_spans(data, offsets)
    hashes = word_hashes(data, begin, end)
    row = np.searchsorted(offsets, begin, "right") - 1
    head = np.searchsorted(begin, offsets)
    position = np.arange(len(begin)) - head[row]
    total = np.diff(head)[row]
    gram = length - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True
    at = np.flatnonzero(on_cover[position % period] & (total >= length) & (position + gram <= total))
    row, position, total = row[at], position[at], total[at]
    first = np.maximum(position - period + 1, 0)
    n = np.minimum(position, total - length) - first + 1
    origin = head[row]
    anchor = Prefix(hashes, 0).span(at, at + gram)
    shape = ((position - first) * period + n).astype(np.uint64)
    content = Prefix(hashes, 1).span(origin + first, origin + first + n - 1 + length) ^ mix(shape)
    return row, first, n, anchor, content


def word_windows(data: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every window of the given phrases, once, with 128 bits of its content."""
    begin, end = word_spans(data, np.array([0, len(data)]))
    hashes = word_hashes(data, begin, end)
    _, start, n = _merged(np.zeros(len(start), np.int64), start, n)
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    return at, Prefix(hashes, 0).span(at, at + length), Prefix(hashes, 1).span(at, at + length)


REMOVED = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.schema.get_field_index("spans")).fill_null([])
        bounds = np.asarray(spans.offsets)
        starts, counts = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for begin, stop, data, offsets in split_bytes(column_of(batch, f"row.{text}"), BLOCK):
            word, end = word_spans(data, offsets)
            head = np.searchsorted(word, offsets)
            kept = np.ones(len(word), bool)
            for row in range(stop - begin):
                span = slice(bounds[begin + row], bounds[begin + row + 1])
                if span.start < span.stop:
                    _, first, n = _merged(np.zeros(span.stop - span.start, np.int64), starts[span], counts[span] + length - 1)
                    for at, size in zip((first + head[row]).tolist(), n.tolist(), strict=True):
                        kept[at : at + size] = False
            # Kept words with one space each: mark their bytes and, where a word follows, the byte after it.
            size = np.where(kept, end - word + 1, 0)
            ends = np.cumsum(size)
            take = np.repeat(word - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            joined = np.append(data, np.uint8(32))[take]
            joined[ends[kept] - 1] = 32
            left = np.concatenate(([0], ends))[head]
            words, gone = np.diff(head), np.diff(np.concatenate(([0], np.cumsum(~kept)))[head])
            texts = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            original = batch.column(batch.schema.get_field_index("row")).slice(begin, stop - begin)
            columns = [pa.array(words), pa.array(gone), pa.array(texts, pa.binary())]
            yield pa.record_batch([original, *columns], names=["row", *REMOVED.names])


def remove_repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    period: int = PERIOD,
    crowd: int = CROWD,
) -> DataFrame:
    """Each input row as struct ``row`` with ``n_words``, ``n_removed`` and ``kept``, the kept words joined by a space.

    Words are runs of bytes other than space and 0x09 to 0x0D. A word is removed if it lies in a window of ``length``
    words whose sequence also starts anywhere else. NULL and empty texts have no words; texts shorter than a window
    are kept whole. Equal rows are one document and get the same result; different rows of one id, or without one,
    are different documents. Other columns only pass through ``row``. ``period`` and
    ``crowd`` change the work, not the result.
    """
    rows, repeated = identified(docs.withColumn(text, F.col(text).cast("string")), doc_id)
    spans = repeated_windows(
        rows.dropDuplicates(["doc", "tie"]) if repeated else rows,
        text,
        partial(word_phrases, length=length, period=period, cover=difference_cover(period)),
        partial(word_windows, length=length),
        every_copy=True,
        crowd=crowd,
    )
    joined = rows.join(spans, ["doc", "tie"], "left").select("row", "spans")
    schema = joined.select("row").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(partial(_cut, text=text, length=length), schema)
