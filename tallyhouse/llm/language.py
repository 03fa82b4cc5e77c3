"""Languages of a text as a mixture, inferred by expectation-maximisation over n-gram likelihoods.

Each language is a distribution of letter trigrams. For a text, expectation-maximisation estimates the share of each
language. Sets of the largest shares are tried from one language on, as long as the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.features import LETTERS, letter_trigrams
from tallyhouse.llm.stage import column_of, split_bytes

PER_LANGUAGE = 2000
# Expectation-maximisation ends when no share moves by more than this, or after so many rounds.
TOLERANCE, ROUNDS = 2e-3, 200
# Parts in which the texts of one language are ranked before the best of all parts are.
SALTS = 64
SMOOTHING = 0.5
UNKNOWN = "und"
ROWS = 128


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in a batch."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        languages = column_of(batch, "lang").to_pylist()
        for begin, _, data, offsets in split_bytes(column_of(batch, "text"), 4 << 20):
            for i in range(len(offsets) - 1):
                own = sums.setdefault(languages[begin + i], np.zeros(LETTERS, np.int64))
                own += letter_trigrams(data[offsets[i] : offsets[i + 1]])
        rows = [(name, gram, int(own[gram])) for name, own in sums.items() for gram in np.flatnonzero(own).tolist()]
        if rows:
            types = (pa.string(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["lang", "gram", "n"])


class Model:
    """One distribution of trigrams for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.grams = smooth / smooth.sum(axis=1, keepdims=True) if len(languages) else smooth

    def climb(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Shares of the best likelihood among those that are not zero at the start; settled texts drop out."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        shares, left = shares.copy(), np.arange(len(counts))
        for _ in range(ROUNDS):
            own, mine = shares[left], counts[left]
            new = own * ((mine / np.maximum(own @ self.grams, 1e-300)) @ self.grams.T) / total[left]
            shares[left] = new
            left = left[np.abs(new - own).max(axis=1) > TOLERANCE]
            if not len(left):
                break
        return shares

    def shares(self, counts: np.ndarray, penalty: float) -> np.ndarray:
        """Share of each language in each text, zero outside the chosen set."""
        words = np.log(counts.sum(axis=1) + 1)
        whole = self.climb(counts, np.full((len(counts), len(self.languages)), 1 / len(self.languages)))
        rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
        best, score, left = np.zeros_like(whole), np.full(len(counts), -np.inf), np.arange(len(counts))
        for size in range(1, len(self.languages) + 1):
            chosen = np.where(rank[left] < size, np.maximum(whole[left], 1e-9), 0)
            chosen = chosen / chosen.sum(axis=1, keepdims=True)
            chosen = self.climb(counts[left], chosen) if size > 1 else chosen
            fit = (counts[left] * np.log(np.maximum(chosen @ self.grams, 1e-300))).sum(axis=1) - penalty * size * words[left]
            better = fit > score[left]
            left = left[better]
            best[left], score[left] = chosen[better], fit[better]
            if not len(left):
                break
        return best


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` texts of each language, those of the smallest hashes of id and text.

    Rows without a language are not learned from; rows without an id are, and rows of equal id and text count once.
    Only sums of trigram counts reach the driver: languages times ``LETTERS`` numbers.
    """
    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").cast("string").alias("id"))
    own = own.filter("lang IS NOT NULL").select("lang", "text", F.xxhash64("id", "text").alias("at"))
    # Only hashes are ranked, first in parts of a language: one may have any share of the texts.
    hashes = own.select("lang", "at").distinct().withColumn("part", F.pmod("at", F.lit(SALTS)))
    for part in (("lang", "part"), ("lang",)):
        first = F.row_number().over(Window.partitionBy(*part).orderBy("at"))
        hashes = hashes.withColumn("rank", first).filter(F.col("rank") <= per_language)
    limits = hashes.groupBy("lang").agg(F.max("at").alias("limit"))
    sample = own.join(F.broadcast(limits), "lang").filter("at <= limit").dropDuplicates(["lang", "at"]).select("lang", "text")
    rows = sample.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({row["lang"] for row in rows})
    counts = np.zeros((len(languages), LETTERS))
    for row in rows:
        counts[languages.index(row["lang"]), row["gram"]] = row["n"]
    return Model(languages, counts)


def _predict(batches: Iterator[pa.RecordBatch], model, penalty: float) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        names, shares, sets = [], [], []
        for begin, stop, data, offsets in split_bytes(column_of(batch, "text"), 4 << 20):
            for at in range(0, stop - begin, ROWS):
                texts = [data[offsets[i] : offsets[i + 1]] for i in range(at, min(at + ROWS, stop - begin))]
                spoken = [any(map(str.isalpha, t.tobytes().decode("utf-8", "ignore"))) for t in texts]
                if not model.languages:
                    spoken = [False] * len(texts)
                found = np.zeros((len(texts), len(model.languages)))
                if any(spoken):
                    counts = np.array([letter_trigrams(t) for t, s in zip(texts, spoken, strict=True) if s], np.float64)
                    found[spoken] = model.shares(counts, penalty)
                for is_spoken, own in zip(spoken, found, strict=True):
                    top = int(own.argmax()) if is_spoken else -1
                    names.append(model.languages[top] if is_spoken else UNKNOWN)
                    shares.append(min(1.0, float(own[top])) if is_spoken else 0.0)
                    sets.append([model.languages[i] for i in np.flatnonzero(own > 0).tolist()])
        columns = [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
        yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "languages"])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = 2.0) -> DataFrame:
    """``doc_id``, ``lang_pred``, its share ``score`` and the chosen ``languages`` for every row, from the text alone.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Of
    equal shares the first language by name wins. Repeated rows get equal results; other columns are ignored.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(
        partial(_predict, model=shared, penalty=penalty),
        "doc_id long, lang_pred string, score double, languages array<string>",
    )
