"""A training corpus from raw documents: five stages, each over all that the one before kept.

``documents`` has ``doc_id``, ``text`` and any other columns, which pass through. Stages treat NULL and empty texts,
repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from tallyhouse.llm.queries import byte_vocabulary, quality_model, ship_package, table
from tallyhouse.llm.stage import identified, keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Lists of ids counted to be no longer than this are sent to every executor; longer ones are joined by shuffle.
BROADCAST_IDS = 500_000


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows, as ``identified`` gives them, whose ``doc`` and ``tie`` are not together in ``gone``."""
    gone = keep(gone.select("doc", "tie").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, ["doc", "tie"], "left_anti")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them if there is no label to learn from."""
    ship_package(spark)
    scored = quality.scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, those without an id last.

    Each row is judged by itself: different rows of one id, or without an id, are different documents, of which a hash
    of the row decides the order; rows equal in all columns are one document.
    """
    ship_package(spark)
    rows, repeated = identified(docs, "doc_id")
    left = without(rows, simhash.later_copies(rows))
    if repeated and rows.groupBy("doc", "tie").count().filter("count > 1").take(1):
        left = left.dropDuplicates(["doc", "tie"])
    return left.select("row.*")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the parts that repeat an earlier document; characters cut in part become U+FFFD.

    All documents stay, those that were repeated whole with an empty text.
    """
    ship_package(spark)
    cut = suffix_dedup.remove_repeats(docs)
    own = F.when(F.col("row.text").isNotNull(), F.make_valid_utf8(F.col("kept").cast("string")))
    text = F.when(F.col("n_removed") > 0, own).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*(changed.get(name, F.col(f"row.`{name}`")).cast(kind).alias(name) for name, kind in docs.dtypes))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    ship_package(spark)
    rows, _ = identified(docs, "doc_id")
    texts = rows.select(F.struct("doc", "tie").alias("key"), F.col("row.text").alias("text"))
    leaks = decontaminate.find_leaks(texts, table(spark, sf_dir, "benchmark"), doc_id="key")
    return without(rows, leaks.filter("n_hit > 0").select("doc_id.doc", "doc_id.tie")).select("row.*")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ``ids`` of each document, their number, and as ``text`` what they decode to."""
    ship_package(spark)
    vocabulary = byte_vocabulary(spark)
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    others = [F.col(f"row.`{name}`") for name in docs.columns if name not in ("text", "ids", "n_tokens")]
    return coded.select(*others, F.col("decoded").cast("string").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", reject_low_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode_bytes),
]

# SQL has neither the classifier nor XXH64 nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
