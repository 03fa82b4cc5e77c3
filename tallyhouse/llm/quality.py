"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents is reduced to latent vectors by a truncated singular value decomposition. They
are sent to every task, which projects its documents in blocks, takes their exact cosine products with all labelled
vectors, and lets the nearest vote with their similarity as weight. A sampled document also stands for the labelled ones
of its label that were left out, so votes follow the ratio of all labels whatever the sample holds of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.features import LETTERS, SHAPES, letter_trigrams, repetition, shape_trigrams
from tallyhouse.llm.stage import column_of, keep, split_bytes

PER_LABEL = 1000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 8
THRESHOLD = 0.7
ROWS = 256
FEATURES = LETTERS + SHAPES + 3


def vector(text: np.ndarray) -> np.ndarray:
    """Square roots of shares: letters, shapes and repetition each of about the same length."""
    spelled, shapes = letter_trigrams(text), shape_trigrams(text)
    parts = (x / max(1, x.sum()) for x in (spelled, shapes))
    return np.sqrt(np.concatenate((*parts, repetition(text)))).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and values of what is not zero in each text's vector."""
    for batch in batches:
        found = []
        for begin, stop, data, offsets in split_bytes(column_of(batch, "text"), 4 << 20):
            for i in range(stop - begin):
                own = vector(data[offsets[i] : offsets[i + 1]])
                at = np.flatnonzero(own).astype(np.uint16)
                found.append((at.tobytes(), own[at].tobytes()))
        columns = [pa.array([row[k] for row in found], pa.binary()) for k in (0, 1)]
        yield pa.record_batch([batch.column(0), *columns], names=["label", "at", "value"])


class Model:
    """Latent vectors of the sample with their labels, and the projection that gave them."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, totals: tuple[int, int], dimensions: int):
        """``totals``: all documents of label 0 and of label 1 that the sample stands for. ``vectors`` is overwritten."""
        self.labels = labels.astype(np.float64)
        self.prior = totals[1] / sum(totals) if len(labels) else 1.0
        sampled = np.bincount(labels, minlength=2)
        self.stands_for = (np.array(totals) / np.maximum(sampled, 1))[labels]
        # Rare features weigh more, as in any latent semantic index.
        self.weight = np.log((1 + len(vectors)) / (1 + np.count_nonzero(vectors, axis=0))).astype(np.float32) + 1
        # One dense array of the sample, no copies of it: the driver's memory is bounded.
        vectors *= self.weight
        values, left = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
        order = np.argsort(-values)[: min(dimensions, len(vectors))]
        left = (left[:, order] / np.sqrt(np.maximum(values[order], 1e-12))).astype(np.float32)
        self.basis = vectors.T @ left
        self.latent = self._latent(vectors)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return self._latent(vectors * self.weight)

    def _latent(self, weighted: np.ndarray) -> np.ndarray:
        latent = weighted @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, vectors: np.ndarray, neighbours: int, sharpness: int) -> np.ndarray:
        """Share of label 1 in the weighted vote; its share in all labels where nothing is similar."""
        if not len(self.labels):
            return np.ones(len(vectors))
        near = self.project(vectors) @ self.latent.T
        k = min(neighbours, near.shape[1])
        which = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, which, 1).astype(np.float64), 0) ** sharpness
        weight *= self.stands_for[which]
        total = weight.sum(axis=1)
        vote = (weight * self.labels[which]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", per_label: int = PER_LABEL, dimensions: int = DIMENSIONS) -> Model:
    """Learn from at most ``per_label`` documents of each label, those of the smallest id hashes.

    Labels of one id that contradict each other, NULL labels and NULL ids are not learned from; of several texts of
    one id the smallest is. Only the sample and the number of all documents of each label reach the driver.
    """
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    known = known.filter("label = most").select("doc_id", "label")
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    present = keep(known.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    counted = {row["label"]: row["count"] for row in present.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [present.filter(F.col("label") == label).orderBy(*order).limit(per_label) for label in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("label", "text").mapInArrow(_vectors, "label int, at binary, value binary").toArrow()
    vectors = np.zeros((len(rows), FEATURES), np.float32)
    for own, at, value in zip(vectors, rows.column("at"), rows.column("value"), strict=True):
        own[np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(value.as_buffer(), np.float32)
    return Model(vectors, rows.column("label").to_numpy().astype(np.int64), (counted.get(0, 0), counted.get(1, 0)), dimensions)


def _scores(batches: Iterator[pa.RecordBatch], model, text: str, neighbours: int, sharpness: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        found = []
        for begin, stop, data, offsets in split_bytes(column_of(batch, f"row.{text}"), 4 << 20):
            for at in range(0, stop - begin, ROWS):
                block = [vector(data[offsets[i] : offsets[i + 1]]) for i in range(at, min(at + ROWS, stop - begin))]
                found.append(model.score(np.array(block), neighbours, sharpness))
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["row", "score"])


def scores(docs: DataFrame, model: Model, text: str = "text", neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> DataFrame:
    """Each input row as struct ``row`` with its ``score``, 0 to 1.

    NULL and empty texts resemble nothing and get the share of label 1 in all labels learned from; without any labelled document
    nothing speaks against a text and all scores are 1. Repeated rows get equal scores; ids, labels and other columns
    are never looked at.
    """
    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    rows = rows.select(F.struct(*(F.col(f"`{name}`") for name in rows.columns)).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_scores, model=shared, text=text, neighbours=neighbours, sharpness=sharpness), schema)
