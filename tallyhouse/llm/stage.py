"""What the operators share: the folder for intermediate tables, document identity, Arrow columns as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Documents without an id sort before all others.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks share one disk, may get its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyhouse-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no more than the running step."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passes(pieces: Iterable[tuple[int, ...]], *most: int) -> list[tuple[int, int]]:
    """First and last number of each run of ``pieces`` (number, sizes) that is sent at once: in order of their numbers,
    as many as keep the sum of every size within its limit, or one larger piece. Whatever task made them."""
    runs: list[tuple[int, int]] = []
    held = [0] * len(most)
    for number, *sizes in sorted(pieces):
        together = [a + b for a, b in zip(held, sizes, strict=True)]
        if runs and all(a <= b for a, b in zip(together, most, strict=True)):
            runs[-1], held = (runs[-1][0], number), together
        else:
            runs, held = [*runs, (number, number)], sizes
    return runs


def identified(docs: DataFrame, doc_id: str) -> tuple[DataFrame, bool]:
    """Columns ``doc``, ``tie`` and ``row``, the struct of all input columns; and whether rows may share both.

    ``doc`` orders the documents. ``tie`` is 0 unless some id is NULL or repeated; then it is a hash of the whole row,
    so different rows of one id are different documents, and equal rows are one document.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    repeated = bool(ids.filter("doc IS NULL OR n > 1").take(1))
    row = F.struct(*(F.col(f"`{name}`") for name in docs.columns))
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        (F.xxhash64(row) if repeated else F.lit(0).cast("long")).alias("tie"),
        row.alias("row"),
    ), repeated


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dot a field of a struct column."""
    outer, _, inner = name.partition(".")
    column = batch.column(batch.schema.get_field_index(outer))
    return column.field(column.type.get_field_index(inner)) if inner else column


def split_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer row: (first row, end, bytes, row offsets).

    NULL counts as an empty text.
    """
    if not len(texts):
        return
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return column_of(batch, column).to_numpy(zero_copy_only=False)
