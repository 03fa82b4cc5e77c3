"""Find every fixed-length window that occurs elsewhere in the corpus, without sending one row per window.

Both repeat operators share the flow; they differ in how they choose anchors and in which copies count.

1. *Phrases.* A scan cuts each text into phrases: runs of neighbouring windows that hold one anchor. Windows that are
   equal have equal anchors, so a phrase only ever meets phrases of its own anchor. A phrase is sent as hashes of its
   anchor and of its whole content (128 bits together). Copies inside one batch are settled before anything is sent.
2. *Order.* Sorted by anchor, content and place, copies of a phrase are neighbours. All windows of a repeated phrase
   are settled at once. A phrase whose anchor has no other content cannot share a window with any other phrase.
3. *Suffixes.* What remains are anchors that occur within different phrases, where copies begin or end. Only the
   windows of one copy of each of these phrases are spelled out and sorted by content.

An anchor that many phrases of a batch hold is spread by content; a marker tells its other phrases that they are not
alone, so the third step decides about all of them. Groups of equal content are reduced to one row per batch before
they travel. So no group grows beyond the number of batches, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.hashing import mix
from tallyhouse.llm.stage import column_of, keep, longs, split_bytes

# Kinds of rows that leave a scan.
OPEN, SETTLED, MARKER, SPREAD = 0, 1, 2, 3
# An anchor with more phrases than this in one batch is spread over this many groups.
CROWD, GROUPS = 64, 256
BATCH_BYTES = 16 << 20

#: (bytes, offsets) -> row, start and number of its windows, anchor, content
Phrases = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
#: (bytes of a text, first windows, numbers of windows) -> windows, 64 + 64 bits of their content
Windows = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join runs of windows that touch; ``doc`` is a number of the row within its batch."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    # Ends never fall within a document once they are carried forward; documents are kept apart by an offset.
    apart = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + apart)
    first = np.ones(len(doc), bool)
    first[1:] = (start + apart)[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - apart[at] - start[at]


def _copies(keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether it is the first of its key by place, and how many rows share the key."""
    order = np.lexsort((*reversed(place), *reversed(keys)))
    new = np.ones(len(order), bool)
    same = np.ones(len(order) - 1, bool) if len(order) else np.ones(0, bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    new[1:] = ~same
    group = np.cumsum(new) - 1
    first, count = np.empty(len(order), bool), np.empty(len(order), np.int64)
    first[order] = new
    count[order] = np.bincount(group)[group]
    return first, count


def _ranks(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Place of each row of a batch in the order of documents."""
    order = np.lexsort((tie, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _rows(schema: pa.Schema, parts: list[tuple], *more: pa.Array) -> pa.RecordBatch:
    parts = [[c.view(np.int64) if c.dtype == np.uint64 else c for c in part] for part in parts]
    columns = [np.concatenate([part[i] for part in parts]) for i in range(len(schema) - len(more))]
    return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)), *more], schema=schema)


SCAN = pa.schema([(name, pa.int64()) for name in ("anchor", "content", "doc", "tie", "start", "n")] + [("kind", pa.int8())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to the size within which copies are settled."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, every_copy: bool, most: int) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(batches):
        docs, ties = longs(batch, "doc"), longs(batch, "tie")
        for begin, stop, data, offsets in split_bytes(column_of(batch, "text"), BATCH_BYTES):
            doc, tie = docs[begin:stop], ties[begin:stop]
            row, start, n, anchor, content = phrases(data, offsets)
            rank = _ranks(doc, tie)[row]
            first, copies = _copies((anchor, content), (rank, start))
            settled = copies > 1 if every_copy else ~first
            s_row, s_start, s_n = _merged(row[settled], start[settled], n[settled])
            parts = [(mix(s_row.astype(np.uint64) + s_start.astype(np.uint64)), np.zeros_like(s_row), doc[s_row], tie[s_row], s_start, s_n, np.full(len(s_row), SETTLED))]
            row, start, n, anchor, content, copies = (x[first] for x in (row, start, n, anchor, content, copies))
            values, inverse, crowd = np.unique(anchor, return_inverse=True, return_counts=True)
            spread = crowd[inverse] > most
            key = np.where(spread, mix(anchor + np.uint64(1) + (content & np.uint64(GROUPS - 1))), anchor)
            parts.append((key, content, doc[row], tie[row], start, n, np.where(spread, SPREAD, OPEN)))
            mark = values[crowd > most]
            none = np.zeros(len(mark), np.int64)
            parts.append((mark, none, none, none, none, none, np.full(len(mark), MARKER)))
            yield _rows(SCAN, parts)


SPELLED = pa.schema(
    [(name, pa.int64()) for name in ("key", "low", "doc", "tie", "start", "n")] + [("kind", pa.int8()), ("excerpt", pa.binary())]
)
REPEATED = pa.schema([(name, pa.int64()) for name in ("doc", "tie", "start", "n")])


def _spell(
    batches: Iterator[pa.RecordBatch], text: str, windows: Windows, every_copy: bool, width: int | None
) -> Iterator[pa.RecordBatch]:
    """Of each text, phrases of small groups as excerpts and the windows of other phrases one by one."""
    for batch in batches:
        docs, ties = longs(batch, "doc"), longs(batch, "tie")
        spans = batch.column(batch.schema.get_field_index("spans"))
        ends = np.asarray(spans.offsets)
        starts, counts, keys, small = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        for begin, stop, data, offsets in split_bytes(column_of(batch, f"row.{text}"), BATCH_BYTES // 4):
            doc, tie = docs[begin:stop], ties[begin:stop]
            rank, found = _ranks(doc, tie), []
            own = np.arange(ends[begin], ends[stop])
            row = np.repeat(np.arange(stop - begin), np.diff(ends[begin : stop + 1]))
            brief = small[own] if width else np.zeros(len(own), bool)
            at, rows = own[brief], row[brief]
            base = offsets[rows] + starts[at]
            cut = zip(base.tolist(), (base + counts[at] - 1 + (width or 0)).tolist(), strict=True)
            parts = [(keys[at], np.zeros_like(at), doc[rows], tie[rows], starts[at], counts[at], np.full(len(at), OPEN))]
            excerpts = [data[a:b].tobytes() for a, b in cut]
            own, row = own[~brief], row[~brief]
            for which in np.unique(row).tolist():
                span = own[row == which]
                at, high, low = windows(data[offsets[which] : offsets[which + 1]], starts[span], counts[span])
                found.append((np.full(len(at), which), at, high, low))
            if found:
                row, at, high, low = (np.concatenate(x) for x in zip(*found, strict=True))
                first, copies = _copies((high, low), (rank[row], at))
                settled = copies > 1 if every_copy else ~first
                s_row, s_start, s_n = _merged(row[settled], at[settled], np.ones(settled.sum(), np.int64))
                where = mix(s_row.astype(np.uint64) + s_start.astype(np.uint64))
                parts.append((where, np.zeros_like(s_row), doc[s_row], tie[s_row], s_start, s_n, np.full(len(s_row), SETTLED)))
                one = np.ones(first.sum(), np.int64)
                parts.append((high[first], low[first], doc[row[first]], tie[row[first]], at[first], one, np.full(len(one), OPEN)))
            total = sum(len(part[0]) for part in parts)
            yield _rows(SPELLED, parts, pa.array(excerpts + [None] * (total - len(excerpts)), pa.binary()))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut only between keys; at most one group is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = longs(batch, "key")
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _settle(batches: Iterator[pa.RecordBatch], windows: Windows, every_copy: bool) -> Iterator[pa.RecordBatch]:
    """Repeated windows among whole groups, which come sorted by key."""
    for group in _whole_groups(batches):
        key, low, doc, tie, start, n, kind = (group.column(i).to_numpy() for i in range(7))
        parts = [tuple(x[kind == SETTLED] for x in (doc, tie, start, n))]
        excerpts = group.column(7).combine_chunks()
        brief = np.asarray(excerpts.is_valid())
        single = (kind == OPEN) & ~brief
        found = [(doc[single], tie[single], start[single], key[single].view(np.uint64), low[single].view(np.uint64))]
        if brief.any():
            ((_, _, data, offsets),) = split_bytes(excerpts.filter(pa.array(brief)), 1 << 40)
            _, high, lower = windows(data, offsets[:-1], n[brief])
            row = np.repeat(np.flatnonzero(brief), n[brief])
            at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[brief]) - n[brief], n[brief])
            found.append((doc[row], tie[row], at, high, lower))
        doc, tie, at, high, low = (np.concatenate(x) for x in zip(*found, strict=True))
        first, copies = _copies((high, low), (doc, tie, at))
        settled = copies > 1 if every_copy else ~first
        parts.append((doc[settled], tie[settled], at[settled], np.ones(settled.sum(), np.int64)))
        yield _rows(REPEATED, parts)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int8(): "tinyint", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def repeated_windows(
    docs: DataFrame, text: str, phrases: Phrases, windows: Windows, every_copy: bool, crowd: int, width: int | None = None
) -> DataFrame:
    """Repeated windows of each document as ``doc``, ``tie`` and ``spans``, an array of runs (``start``, ``n`` windows).

    ``docs`` has ``doc``, ``tie`` (unique together) and ``row``, a struct with the text. With ``every_copy`` all
    occurrences of a repeated window count, else all but the first one by (doc, tie, start). Runs may overlap. An
    anchor with more than ``crowd`` phrases in one batch is spread. With ``width``, the bytes of a window, the third
    step sends phrases whose anchor has at most ``crowd`` of them as excerpts to one task, which spells them out.
    """
    place = ["doc", "tie", "start"]
    texts = docs.select("doc", "tie", F.col(f"row.`{text}`").cast("string").alias("text"))
    scanned = texts.mapInArrow(lambda batches: _scan(batches, phrases, every_copy, crowd), _ddl(SCAN))
    sorted_ = Window.partitionBy("anchor").orderBy("content", *place)
    whole = Window.partitionBy("anchor")
    row = F.col("kind").isin(OPEN, SPREAD)
    before, after = (F.coalesce(f("content").over(sorted_) == F.col("content"), F.lit(False)) for f in (F.lag, F.lead))
    alone = (F.min("content").over(whole) == F.max("content").over(whole)) & (F.max("kind").over(whole) < MARKER)
    small = (F.max("kind").over(whole) < MARKER) & (F.count(F.when(~F.col("before"), 1)).over(whole) <= crowd)
    classed = (
        scanned.withColumns({"before": before, "after": after})
        .withColumns({"alone": alone, "small": small})
        .withColumn("covered", (F.col("kind") == SETTLED) | (row & (F.col("before") | F.col("after") if every_copy else F.col("before"))))
        .withColumn("spelled", row & ~F.col("before") & ~F.col("alone"))
        .filter("covered OR spelled")
        .select(*place, "n", "covered", F.when(F.col("spelled"), F.struct("start", "n", "anchor", "small")).alias("phrase"))
    )
    classed = keep(classed, "phrases")
    spans = classed.filter("phrase IS NOT NULL").groupBy("doc", "tie").agg(F.collect_list("phrase").alias("spans"))
    spelled = (
        docs.join(spans, ["doc", "tie"])
        .select("doc", "tie", "row", "spans")
        .mapInArrow(lambda batches: _spell(batches, text, windows, every_copy, width), _ddl(SPELLED))
        .repartition("key")
        .sortWithinPartitions("key")
    )
    suffixes = spelled.mapInArrow(lambda batches: _settle(batches, windows, every_copy), _ddl(REPEATED))
    spans = classed.filter("covered").select(*place, "n").unionByName(suffixes)
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
