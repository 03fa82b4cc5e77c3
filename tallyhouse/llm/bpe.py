"""Byte-level BPE: long texts are encoded as overlapping chunks that are stitched where their pre-tokens agree.

The pattern's matches are decided by what follows them, so two runs over one text that share a boundary agree from
there on. A chunk reads on into the next one; the first boundary that both find in the overlap is where the next piece
begins. Pieces are then encoded on their own. Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyhouse.llm.stage import column_of, identified

CHUNK, OVERLAP = 32_768, 2_048
# The pattern looks at most this far past the end of a match.
LOOKAHEAD = 3
_ENCODINGS: dict[int, tuple[tiktoken.Encoding, list[bytes]]] = {}


class Vocabulary:
    """Ranks and pre-token pattern, read once on the driver and sent to the tasks; some 50,000 entries."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = pattern
        self.key = hash((pattern, path, len(ranks)))
        self.ranks = spark.sparkContext.broadcast(ranks)

    def load(self) -> tuple[tiktoken.Encoding, list[bytes]]:
        if self.key not in _ENCODINGS:
            ranks = self.ranks.value
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            _ENCODINGS[self.key] = encoding, table
        return _ENCODINGS[self.key]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: results are several times as large as the texts."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for value in column_of(batch, name):
        yield value.as_py() or ""


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str, passed: str) -> Iterator[pa.RecordBatch]:
    encoding, _ = vocabulary.load()
    for batch in _small(batches):
        ids = [encoding.encode_to_numpy(value, disallowed_special=()).view(np.int32) for value in _texts(batch, text)]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        columns = [batch.column(batch.schema.get_field_index(passed)), pa.ListArray.from_arrays(offsets, values)]
        yield pa.record_batch(columns, names=[passed, "ids"])


PARTS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("last", pa.bool_())])


def _cut(batches: Iterator[pa.RecordBatch], text: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("doc", "tie")]
        for doc, tie, value in zip(*keys, _texts(batch, text), strict=True):
            rows = [
                (doc, tie, number, value[at : at + chunk + overlap], at + chunk >= len(value))
                for number, at in enumerate(range(0, len(value), chunk))
            ]
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)


def _boundaries(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Where pre-tokens begin in the overlap with the chunk before and in that with the chunk after, counted from the
    beginning of that overlap. Behind white space nothing is cut: a match there depends on what follows."""
    # The other engine's \s is the Unicode property.
    split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    for batch in batches:
        heads, tails = [], []
        for value, last in zip(_texts(batch, "text"), batch.column("last").to_pylist(), strict=True):
            trusted = len(value) - (0 if last else LOOKAHEAD)
            head, tail = [0], []
            for match in split.finditer(value):
                end = match.end()
                if end > trusted or value[end - 1].isspace():
                    continue
                if end < overlap:
                    head.append(end)
                elif chunk <= end:
                    tail.append(end - chunk)
            heads.append(head)
            tails.append(tail)
        kind = pa.list_(pa.int32())
        columns = [*batch.columns, pa.array(heads, kind), pa.array(tails, kind)]
        yield pa.record_batch(columns, names=[*batch.schema.names, "head", "tail"])


def _pieces(long: DataFrame, vocabulary: Vocabulary, text: str, chunk: int, overlap: int) -> DataFrame:
    """``doc``, ``tie``, ``piece``, ``text``: texts cut where the encoding can be cut.

    If a pair of chunks does not meet, its text is kept whole: it holds a pre-token longer than the overlap.
    """
    cut = long.mapInArrow(
        partial(_cut, text=f"row.{text}", chunk=chunk, overlap=overlap),
        "doc long, tie long, part int, text string, last boolean",
    ).repartition("doc", "tie", "part")
    marked = cut.mapInArrow(
        partial(_boundaries, pattern=vocabulary.pattern, chunk=chunk, overlap=overlap),
        "doc long, tie long, part int, text string, last boolean, head array<int>, tail array<int>",
    )
    own = Window.partitionBy("doc", "tie")
    ordered = own.orderBy("part")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(ordered)))
    begin = F.when(F.col("part") == 0, 0).otherwise(met)
    marked = marked.withColumn("begin", begin).drop("head", "tail")
    stop = F.when(F.col("last"), F.length("text")).otherwise(chunk + F.lead("begin").over(ordered))
    marked = marked.withColumn("whole", F.max(F.col("begin").isNull()).over(own)).withColumn("stop", stop)
    first = F.when(F.col("whole"), 0).otherwise(F.col("begin"))
    size = F.when(F.col("whole"), F.when(F.col("last"), F.length("text")).otherwise(chunk)).otherwise(F.col("stop") - F.col("begin"))
    cut = marked.select(
        "doc", "tie", "part", F.when(F.col("whole"), 0).otherwise(F.col("part")).alias("piece"), F.col("text").substr(first + 1, size).alias("text")
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return cut.groupBy("doc", "tie", "piece").agg(joined.alias("text"))


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Each input row as struct ``row`` with its token ``ids``, as the library encodes the text without special tokens.

    Texts of at most ``chunk`` characters are one piece and are encoded where they are read. NULL counts as empty and
    has no ids. Every row is encoded, repeated ones too, and other columns only pass through ``row``.
    """
    rows, repeated = identified(docs.withColumn(text, F.col(text).cast("string")), doc_id)
    is_long = F.coalesce(F.length(F.col(f"row.`{text}`")) > chunk, F.lit(False))
    schema = rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))
    short = rows.filter(~is_long).select("row").mapInArrow(partial(_encode, vocabulary=vocabulary, text=f"row.{text}", passed="row"), schema)
    long = rows.filter(is_long)
    pieces = _pieces(long.dropDuplicates(["doc", "tie"]) if repeated else long, vocabulary, text, chunk, overlap)
    pieces = pieces.withColumn("key", F.struct("doc", "tie", "piece")).select("key", "text")
    encoded = pieces.mapInArrow(
        partial(_encode, vocabulary=vocabulary, text="text", passed="key"), pieces.select("key").schema.add("ids", T.ArrayType(T.IntegerType()))
    ).select("key.*", "ids")
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]))
    encoded = encoded.groupBy("doc", "tie").agg(ids.alias("ids"))
    return short.unionByName(long.join(encoded, ["doc", "tie"]).select("row", "ids"))


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    _, table = vocabulary.load()
    for batch in _small(batches):
        ids = batch.column(batch.schema.get_field_index("ids"))
        bounds = np.asarray(ids.offsets)
        values, bounds = ids.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]
        texts = []
        for i, valid in enumerate(ids.is_valid().to_pylist()):
            texts.append(b"".join([table[x] for x in values[bounds[i] : bounds[i + 1]].tolist()]) if valid else None)
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``decoded``, the bytes of the ``ids`` put together; NULL stays NULL."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(partial(_decode, vocabulary=vocabulary), schema)
