"""Remove bytes that repeat an earlier part of the corpus.

Prefix-free parsing over Spark: rolling-hash triggers cut every text into phrases. Here the trigger of a window is the
smallest rolling hash of its grams, and neighbouring windows with one trigger make a phrase. Phrases overlap by a window
less one byte, so every window lies whole in one phrase and the parse of a text adds nothing beyond the places where
its phrases occur. Corpus order then combines two orders of bounded depth: the dictionary of distinct phrases is
sorted by content with its places (the parse), and the suffixes of those dictionary phrases that share a trigger with
another phrase are sorted by their first window. A window is removed if a smaller place has it.

Suffixes are ordered by 128-bit hashes of their first ``length`` bytes instead of the bytes; only equality counts here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.hashing import TABLES, Prefix, mix, sliding_min
from tallyhouse.llm.repeats import CROWD, _merged, repeated_windows
from tallyhouse.llm.stage import column_of, identified, split_bytes

LENGTH = 100
GRAM = 36
BLOCK = 1 << 17


def byte_phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int) -> tuple[np.ndarray, ...]:
    """Cut texts into phrases, in blocks so that memory does not follow the length of a text."""
    found = []
    for at in range(0, len(data) - length + 1, block):
        stop = min(at + block, len(data) - length + 1)
        part = data[at : stop + length - 1]
        grams = Prefix(TABLES[0][part], 0).rolling(gram)
        trigger = sliding_min(grams, length - gram + 1)
        # A phrase ends where its trigger, the first gram of the smallest hash, leaves the window. Windows of one phrase
        # thus hold the trigger at different places and are never equal to each other.
        left = np.flatnonzero((trigger[1:] != trigger[:-1]) | (grams[: len(trigger) - 1] == trigger[:-1])) + 1
        cuts = np.concatenate((offsets, offsets[1:] - length + 1)) - at
        cuts = cuts[(cuts > 0) & (cuts < stop - at)]
        begin = np.unique(np.concatenate(([0], left, cuts)))
        n = np.diff(np.append(begin, stop - at))
        row = np.searchsorted(offsets, begin + at, "right") - 1
        whole = begin + at + length <= offsets[row + 1]
        begin, n, row = begin[whole], n[whole], row[whole]
        content = Prefix(TABLES[1][part], 1).span(begin, begin + n - 1 + length) ^ mix(n.astype(np.uint64))
        found.append((row, begin + at - offsets[row], n, trigger[begin], content))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def byte_windows(data: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every window of the given phrases, once, with 128 bits of its content."""
    _, start, n = _merged(np.zeros(len(start), np.int64), start, n)
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    hashes = np.zeros((2, len(at)), np.uint64)
    for block in range(0, len(data), BLOCK):
        inside = slice(*np.searchsorted(at, (block, block + BLOCK)))
        if inside.start < inside.stop:
            part = data[block : block + BLOCK + length - 1]
            for which in (0, 1):
                hashes[which, inside] = Prefix(TABLES[which][part], which).rolling(length)[at[inside] - block]
    return at, hashes[0], hashes[1]


REMOVED = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.schema.get_field_index("spans")).fill_null([])
        bounds = np.asarray(spans.offsets)
        starts, counts = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for begin, stop, data, offsets in split_bytes(column_of(batch, f"row.{text}"), 16 << 20):
            rows = []
            for row in range(stop - begin):
                own = data[offsets[row] : offsets[row + 1]]
                span = slice(bounds[begin + row], bounds[begin + row + 1])
                if span.start == span.stop:
                    rows.append((len(own), 0, 0, own.tobytes()))
                    continue
                _, first, n = _merged(np.zeros(span.stop - span.start, np.int64), starts[span], counts[span] + length - 1)
                kept = np.ones(len(own), bool)
                for at, size in zip(first.tolist(), n.tolist(), strict=True):
                    kept[at : at + size] = False
                rows.append((len(own), int(n.sum()), len(first), own[kept].tobytes()))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), REMOVED.types, strict=True)]
            original = batch.column(batch.schema.get_field_index("row")).slice(begin, stop - begin)
            yield pa.record_batch([original, *columns], names=["row", *REMOVED.names])


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
    crowd: int = CROWD,
) -> DataFrame:
    """Each input row as struct ``row`` with ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept``.

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of a smaller id,
    or earlier in the same document. NULL and empty texts keep nothing; texts shorter than ``length`` are kept whole.
    Equal rows are one document and get the same result; different rows of one id are ordered by a hash of the row; a
    NULL id sorts before all others. Other columns only pass through ``row``.
    ``gram`` (the width of the rolling hash), ``block`` and ``crowd`` change the work, not the result.
    """
    rows, repeated = identified(docs.withColumn(text, F.col(text).cast("string")), doc_id)
    spans = repeated_windows(
        rows.dropDuplicates(["doc", "tie"]) if repeated else rows,
        text,
        partial(byte_phrases, length=length, gram=gram, block=block),
        partial(byte_windows, length=length),
        every_copy=False,
        crowd=crowd,
        width=length,
    )
    joined = rows.join(spans, ["doc", "tie"], "left").select("row", "spans")
    schema = joined.select("row").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(partial(_cut, text=text, length=length), schema)
