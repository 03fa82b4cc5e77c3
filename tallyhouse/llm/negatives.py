"""Hard negatives by the threshold algorithm over sorted lists of every dimension.

Vectors are stored as shards of one label, each with the order of its vectors in every dimension. An anchor reads these
lists in step, from the top where its own component is positive and from the bottom where it is negative, and scores
each vector when it meets it for the first time. The sum of the anchor's components times the last values read bounds
the score of every vector not met yet. An anchor leaves a shard when that threshold falls strictly below the k-th score
of each of its windows; these are carried from shard to shard within a task.

Anchors go over the shards in groups of checked size, each group sent to all tasks. The shards are stored once and read
as they are: nothing that grows with anchors times vectors is stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.stage import keep, longs, passes

SHARD, CHUNK = 2048, 256
SCALE = 256
EXACT = 2.0**53
# What one group of anchors may hold.
GROUP_BYTES, GROUP_ANCHORS = 16 << 20, 8192
# Positions of the lists read in the first step; each further step reads as many as all before it.
STEP = 32
LEAST, MOST = -(2**63), 2**63 - 1
SHARDS = "label long, n int, ids binary, ties binary, dims int, kind string, vectors binary, orders binary"
CHUNKS = "label long, n int, ids binary, ties binary, dims int, kind string, vectors binary, piece long, size long, windows binary"
FOUND = "anchor_id long, anchor_tie long, of_id long, of_tie long, of_score long, vec_id long, tie long, score long"
WINDOWS = "array<struct<id: long, tie: long, low: long, high: long, score: long>>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of the narrowest integers; shorter vectors are filled up with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    most = max(int(out.max(initial=0)), -int(out.min(initial=0)))
    return out.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Neighbouring rows of one label, at most ``size`` of them."""
    parts, held, label = [], 0, None
    for batch in batches:
        labels = longs(batch, "label")
        cuts = np.flatnonzero(np.diff(labels)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(labels)], strict=True):
            while begin < end:
                if parts and (label != labels[begin] or held == size):
                    yield pa.Table.from_batches(parts)
                    parts, held = [], 0
                label, taken = labels[begin], min(end - begin, size - held)
                parts.append(batch.slice(begin, taken))
                held, begin = held + taken, begin + taken
    if parts:
        yield pa.Table.from_batches(parts)


def _packed(table: pa.Table) -> tuple[dict, np.ndarray]:
    vectors = _matrix(table.column("vector").combine_chunks())
    ids, ties = (table.column(name).to_numpy() for name in ("vec_id", "tie"))
    row = {"label": table.column("label")[0].as_py(), "n": len(table), "ids": ids.tobytes(), "ties": ties.tobytes()}
    return row | {"dims": vectors.shape[1], "kind": vectors.dtype.name, "vectors": vectors.tobytes()}, vectors


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, size):
        row, vectors = _packed(table)
        # Values fall along each list.
        orders = np.argsort(-vectors.astype(np.int64), axis=0, kind="stable").astype(np.uint16).T
        yield pa.RecordBatch.from_pylist([row | {"orders": orders.tobytes()}], _schema(SHARDS))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Numbered chunks of at most ``size`` anchors."""
    for piece, table in enumerate(_runs(batches, size), TaskContext.get().partitionId() << 32):
        windows = [(i, w["id"], w["tie"], w["low"], w["high"], w["score"]) for i, own in enumerate(table.column("windows").to_pylist()) for w in own]
        row = _packed(table)[0] | {"windows": np.array(windows, np.int64).reshape(-1, 6).tobytes()}
        held = sum(len(row[name]) for name in ("ids", "ties", "vectors", "windows"))
        yield pa.RecordBatch.from_pylist([row | {"piece": piece, "size": held}], _schema(CHUNKS))


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["dims"]).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ties"], np.int64), vectors


class Shard:
    """Vectors of one label and their order in each dimension."""

    def __init__(self, row: dict):
        self.label = row["label"]
        self.ids, self.ties, self.vectors = _vectors(row)
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(row["dims"], row["n"])
        self.sorted = np.take_along_axis(self.vectors.T, self.orders.astype(np.int64), 1)
        self.most = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))
        self.floats = self.vectors.astype(np.float64)


class Anchor:
    """A vector and its windows: for each the best ``k`` rows of scores ``low`` to ``high``, ties to smaller ids."""

    def __init__(self, number: int, tie: int, vector: np.ndarray, windows: np.ndarray, k: int):
        self.id, self.tie, self.vector, self.windows, self.k = number, tie, vector, windows, k
        self.best = [np.zeros((0, 3), np.int64) for _ in windows]
        self.needed = [int(w[3]) for w in windows]

    def add(self, scores: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        order = None
        for i, window in enumerate(self.windows):
            inside = np.flatnonzero((scores >= self.needed[i]) & (scores <= window[4]))
            if len(inside):
                rows = np.concatenate((self.best[i], np.stack((scores[inside], ids[inside], ties[inside]), 1)))
                order = np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]
                self.best[i] = rows[order]
                if len(order) == self.k:
                    self.needed[i] = max(self.needed[i], int(rows[order[-1], 0]))

    def rows(self) -> Iterator[tuple]:
        for window, best in zip(self.windows.tolist(), self.best, strict=True):
            for score, number, tie in best.tolist():
                yield self.id, self.tie, window[1], window[2], window[5], number, tie, score


def search(anchor: Anchor, shard: Shard, step: int = STEP) -> int:
    """The threshold algorithm over one shard; how many vectors were scored. Rows of the anchor's id take no part."""
    n = len(shard.ids)
    dims = min(len(anchor.vector), shard.vectors.shape[1])
    own = anchor.vector[:dims]
    used = np.flatnonzero(own)
    weights = own[used]
    if shard.most * sum(abs(int(x)) for x in weights) >= 2**63:
        raise OverflowError("a score may leave 64 bits")
    exact_in_doubles = shard.most * float(np.abs(weights.astype(np.float64)).sum()) < EXACT
    rising, lists, heights = weights < 0, shard.orders[used], shard.sorted[used]
    met = np.zeros(n, bool)
    begin = 0
    while begin < n:
        end = min(n, max(step, 2 * begin)) if len(used) else n
        fresh = np.zeros(n, bool)
        if end < n:
            fresh[lists[~rising, begin:end]] = True
            fresh[lists[rising, n - end : n - begin]] = True
            fresh &= ~met
        else:
            # The lists have been read to their end, whatever their order.
            fresh = ~met
        met |= fresh
        new = np.flatnonzero(fresh & (shard.ids != anchor.id))
        if exact_in_doubles:
            scores = (shard.floats[new, :dims] @ own.astype(np.float64)).astype(np.int64)
        else:
            scores = shard.vectors[new, :dims] @ own
        anchor.add(scores, shard.ids[new], shard.ties[new])
        if end < n:
            last = np.where(rising, heights[:, n - end], heights[:, end - 1])
            # A vector not met yet that reaches the k-th score can still have the smaller id.
            if int(last @ weights) < min(anchor.needed):
                break
        begin = end
    return int(met.sum())


def _search(batches: Iterator[pa.RecordBatch], group, same_label: bool, k: int) -> Iterator[pa.RecordBatch]:
    by_label: dict[int, list[Anchor]] = {}
    for row in group.value.to_pylist():
        windows = np.frombuffer(row["windows"], np.int64).reshape(-1, 6)
        for i, (number, tie, vector) in enumerate(zip(*_vectors(row), strict=True)):
            if len(own := windows[windows[:, 0] == i]):
                by_label.setdefault(row["label"], []).append(Anchor(int(number), int(tie), vector, own, k))
    for batch in batches:
        for i in range(len(batch)):
            shard = Shard(batch.slice(i, 1).to_pylist()[0])
            for label, anchors in by_label.items():
                if (label == shard.label) == same_label:
                    for anchor in anchors:
                        search(anchor, shard)
    names = [part.split()[0] for part in FOUND.split(", ")]
    for anchors in by_label.values():
        found = [row for anchor in anchors for row in anchor.rows()]
        columns = zip(*found, strict=True) if found else [()] * len(names)
        yield pa.record_batch([pa.array(column, pa.int64()) for column in columns], names=names)


def _best(shards: DataFrame, anchors: DataFrame, same_label: bool, k: int, chunk: int, most_bytes: int, most_anchors: int) -> DataFrame:
    """The best ``k`` rows for each window of each anchor, of its own label or of all others; ``rank`` counts from 1."""
    spark = shards.sparkSession
    spread = anchors.repartitionByRange(max(1, -(-anchors.count() // most_anchors)), "label", "vec_id")
    packed = spread.sortWithinPartitions("label").mapInArrow(partial(_chunks, size=chunk), CHUNKS)
    chunks = keep(packed, "anchors")
    # Three numbers for each chunk of anchors, however many tasks these came from.
    groups = passes(map(tuple, chunks.select("piece", "size", "n").collect()), most_bytes, most_anchors)
    parts = []
    for first, last in groups or [(0, -1)]:
        group = spark.sparkContext.broadcast(chunks.filter(F.col("piece").between(first, last)).toArrow())
        found = shards.mapInArrow(partial(_search, group=group, same_label=same_label, k=k), FOUND)
        # With several groups each is finished before the next is sent.
        parts.append(found if len(groups) <= 1 else keep(found, "found"))
    window = Window.partitionBy("anchor_id", "anchor_tie", "of_id", "of_tie", "of_score")
    rank = F.row_number().over(window.orderBy(F.desc("score"), "vec_id", "tie"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard: int = SHARD,
    chunk: int = CHUNK,
    group_bytes: int = GROUP_BYTES,
    group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``vec_id``. Components become floor(256 * x); a row's score is its exact integer inner
    product with the anchor, higher scores come first, ties by smaller id. Positives of an anchor are its first rows of
    the same label; negatives of a positive are the first rows of other labels whose score is ``least`` to ``most`` per
    cent of the positive's.

    Rows without an id, a label or a vector, and vectors with a component that is NULL or not finite, take no part. A
    vector without components is all zero, and shorter vectors count as filled up with zeros. Equal rows are one row;
    different rows of one id are different rows, and rows of the anchor's own id take no part for it. A positive of
    negative score has no negatives. Scores that may leave 64 bits are an error. Labels are integers; other columns are
    ignored, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(*(F.col(f"`{name}`").alias(to) for name, to in ((vec_id, "vec_id"), (label, "label"), (vector, "vector"))))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    # A component beyond 64 bits would be cut off silently.
    scaled = F.transform("vector", lambda x: F.floor(F.when(F.abs(x * SCALE) < 2.0**62, x * SCALE).otherwise(F.raise_error(F.lit("a component leaves 62 bits")).cast("double"))).cast("long"))
    rows = rows.withColumn("vector", scaled)
    if rows.groupBy("vec_id").count().filter("count > 1").take(1):
        rows = rows.distinct().withColumn("tie", F.xxhash64("label", "vector"))
    else:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    # Neighbours share a label; the hash splits a label of many rows. As many tasks as keep every core busy, and
    # no more than 64 shards in one of them.
    many = rows.count()
    tasks = max(1, min(-(-many // shard), max(4 * spark.sparkContext.defaultParallelism, many // (64 * shard))))
    dealt = rows.repartitionByRange(tasks, "label", F.xxhash64("vec_id")).sortWithinPartitions("label")
    shards = keep(dealt.mapInArrow(partial(_shards, size=shard), SHARDS), "shards")

    own = keep(rows.filter(anchors), "anchor-vectors")
    whole = F.array(F.struct(F.lit(0).alias("id"), F.lit(0).alias("tie"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), F.lit(0).alias("score")))
    size = {"chunk": chunk, "most_bytes": group_bytes, "most_anchors": group_anchors}
    alike = _best(shards, own.withColumn("windows", whole.cast(WINDOWS)), True, positives, **size)
    # Exact integer limits: least * p <= 100 * n <= most * p; without any score between them there is no window.
    wide = F.col("score").cast("decimal(20,0)")
    low = F.ceil(wide * least / 100)
    high = F.floor(wide * most / 100)
    inside = F.struct(F.col("vec_id").alias("id"), F.col("tie"), F.greatest(low, F.lit(LEAST)).cast("long").alias("low"), F.least(high, F.lit(MOST)).cast("long").alias("high"), F.col("score"))
    windows = alike.filter(low <= high).groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_tie").alias("tie")).agg(F.collect_list(inside).cast(WINDOWS).alias("windows"))
    others = _best(shards, keep(own.join(windows, ["vec_id", "tie"]), "windows"), False, negatives, **size)
    return others.select(
        "anchor_id", F.col("of_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
