"""Exact top-k inner products by block-at-a-time pruning.

Vectors are stored once, as shards of blocks of neighbouring rows. The maximum and minimum of every component (term) of
a block, each weighted by the query, bound every score in it. A query visits the blocks of a shard by falling bound,
scores them through their forward index (the stored vectors), and stops when the bound falls below its k-th score.

Queries come in groups of a checked size, each a broadcast that passes over all shards. A query starts with its k-th
score in a few seed shards, and a task carries the k-th scores from shard to shard, so bounds prune across shards. What
is stored grows with the vectors and with the results, never with queries times vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.stage import keep, passes

# Rows of a block and of a shard, and shards that give each query its first bound.
BLOCK, SHARD, SEEDS = 64, 4096, 4
# Bytes of the queries of one pass.
GROUP_BYTES = 16 * 2**20
# Shards that one task passes over, where the table is large.
TASK_SHARDS = 64
SCALE = 256
EXACT = 2.0**53
NONE, NO_ID = -np.iinfo(np.int64).max, np.iinfo(np.int64).max
PACKED = "ids binary, dims int, vectors binary"
QUERIES = "piece long, size long, ids binary, dims int, vectors binary, least binary"


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _packed(ids: np.ndarray, matrix: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    """One row."""
    columns = {"ids": pa.array([ids.tobytes()], pa.binary()), "dims": pa.array([matrix.shape[1]], pa.int32()), "vectors": pa.array([matrix.tobytes()], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | more)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dims"])


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            yield _packed(part.column(0).to_numpy(), _matrix(part.column(1)))


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles, which are faster, where no sum can leave their exact range."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if most < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("a score may leave 62 bits")
    return queries @ vectors.T


def _wider(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1]))) if matrix.shape[1] < dims else matrix


class Search:
    """The ``k`` best scores and ids that each query has met so far; ``least`` is a bound that its k-th score reaches."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.queries, self.least = ids, queries, least
        self.score, self.found = np.full((len(ids), k), NONE), np.full((len(ids), k), NO_ID)

    def add(self, ids: np.ndarray, vectors: np.ndarray, block: int) -> int:
        """Pass over a shard; returns how many pairs of query and vector were scored."""
        if not len(self.ids) or not len(ids):
            return 0
        dims = max(self.queries.shape[1], vectors.shape[1])
        queries, vectors = _wider(self.queries, dims), _wider(vectors, dims)
        starts = np.arange(0, len(ids), block)
        bounds = _product(np.maximum(queries, 0), np.maximum.reduceat(vectors, starts)) + _product(np.minimum(queries, 0), np.minimum.reduceat(vectors, starts))
        row = np.flatnonzero(bounds.max(axis=1) >= self.needed())
        bounds, own = bounds[row], np.arange(len(row))
        order = np.argsort(-bounds, axis=1, kind="stable")
        scored = 0
        for turn in range(len(starts)):
            # An equal bound can still hold a smaller id of equal score.
            own = own[bounds[own, order[own, turn]] >= self.needed(row[own])]
            if not len(own):
                break
            blocks = order[own, turn]
            for number in np.unique(blocks):
                at = row[own[blocks == number]]
                names = ids[starts[number] : starts[number] + block]
                new = _product(queries[at], vectors[starts[number] : starts[number] + block])
                scored += new.size
                new[self.ids[at][:, None] == names[None, :]] = NONE
                score = np.concatenate((self.score[at], new), axis=1)
                found = np.concatenate((self.found[at], np.broadcast_to(names, new.shape)), axis=1)
                first = np.lexsort((found, -score), axis=1)[:, : self.score.shape[1]]
                self.score[at], self.found[at] = np.take_along_axis(score, first, 1), np.take_along_axis(found, first, 1)
        return scored

    def needed(self, at=slice(None)) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.least[at])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of what may be among the best of all."""
        which, place = np.nonzero((self.score > NONE) & (self.score >= self.least[:, None]))
        return self.ids[which], self.found[which, place], self.score[which, place]


def _pieces(batches: Iterator[pa.RecordBatch], seeds, k: int, block: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Queries with their first bound, in pieces of at most ``most_bytes`` of ids and vectors, or of one row."""
    piece = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
        step = max(1, most_bytes // (8 * (matrix.shape[1] + 1)))
        for at in range(0, len(ids), step):
            own = slice(at, at + step)
            search = Search(ids[own], matrix[own], np.full(len(ids[own]), NONE), k)
            for row in seeds.value.to_pylist():
                search.add(*_unpacked(row), block)
            more = {"piece": pa.array([piece]), "size": pa.array([ids[own].nbytes + matrix[own].nbytes]), "least": pa.array([search.needed().tobytes()], pa.binary())}
            yield _packed(ids[own], matrix[own], **more).select([part.split()[0] for part in QUERIES.split(", ")])
            piece += 1


def _search(batches: Iterator[pa.RecordBatch], group, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """The best rows of all shards of a task, for each query of the group."""
    rows = group.value.to_pylist()
    parts = [_unpacked(row) for row in rows]
    dims = max((matrix.shape[1] for _, matrix in parts), default=0)
    none = np.zeros(0, np.int64)
    search = Search(
        np.concatenate([none, *(ids for ids, _ in parts)]),
        np.concatenate([np.zeros((0, dims), np.int64), *(_wider(matrix, dims) for _, matrix in parts)]),
        np.concatenate([none, *(np.frombuffer(row["least"], np.int64) for row in rows)]),
        k,
    )
    for batch in batches:
        for i in range(len(batch)):
            search.add(*_unpacked(batch.slice(i, 1).to_pylist()[0]), block)
    yield pa.record_batch([pa.array(column) for column in search.rows()], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` best rows for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of other ids. Components become
    floor(256 * x); a score is their inner product, ties go to the smaller id. Rows without an id or vector, and
    vectors with a component that is NULL or not finite, take no part; a vector without components is all zero, and
    shorter vectors count as filled up with zeros. Equal rows are one row. Components and scores that may leave 62 bits
    are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable)
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0**62, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component leaves 62 bits")).cast("long"))
    rows = rows.withColumn("vector", F.transform("vector", whole).cast("array<long>"))
    if rows.groupBy("vec_id").count().filter("count > 1").take(1):
        rows = rows.distinct()
    # As many tasks as keep every core busy, and no more than so many shards in one of them.
    many = rows.count()
    tasks = max(1, min(-(-many // shard), max(4 * spark.sparkContext.defaultParallelism, many // (TASK_SHARDS * shard))))
    shards = keep(rows.repartition(tasks, "vec_id").mapInArrow(partial(_shards, size=shard), PACKED), "shards")
    seeds = spark.sparkContext.broadcast(shards.limit(SEEDS).toArrow())
    queries = rows.filter(F.col("vec_id") % every == 0)
    size = queries.agg(F.sum(8 * (F.size("vector") + 1)).alias("size")).first()["size"] or 0
    parts = queries.repartition(max(1, -(-size // group_bytes)), "vec_id")
    packed = keep(parts.mapInArrow(partial(_pieces, seeds=seeds, k=k, block=block, most_bytes=group_bytes), QUERIES), "queries")
    # Two numbers for each piece, which is one Arrow batch of queries.
    groups = passes(map(tuple, packed.select("piece", "size").collect()), group_bytes)
    found = []
    for first, last in groups or [(0, -1)]:
        group = spark.sparkContext.broadcast(packed.filter(F.col("piece").between(first, last)).toArrow())
        best = shards.mapInArrow(partial(_search, group=group, k=k, block=block), "query_id long, vec_id long, score long")
        # With several groups each is finished before the next is sent.
        found.append(best if len(groups) <= 1 else keep(best, "found"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.union, found)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
