"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook import compare
from tallyhouse.llm import queries, sql
from tests.llm.test_repeats import by_bytes
from tests.llm.test_search import leaks
from tests.llm.test_simhash import fingerprint, smallest

SQL = sql.oracle_sql()


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf):
    connection = compare.connect(sf)
    relation = connection.execute(SQL[name])
    names = sorted(column[0] for column in relation.description)
    picked = [[c[0] for c in relation.description].index(n) for n in names]
    theirs = sorted(tuple(row[i] for i in picked) for row in relation.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.queries()[name](spark, sf).collect()) == theirs


def test_pipeline(spark, sf):
    """Every stage against brute force over what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf).cache()
    scored = {r.doc_id for r in queries.op8_quality_classifier(spark, sf).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == scored and good.columns == docs.columns

    import numpy as np

    single = stages["simhash near-dedup"](spark, good, sf).cache()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    prints = np.unique(np.array([fingerprint(text) for _, text in rows], np.uint64))
    group, _ = smallest(prints)
    first = {}
    for doc, text in rows:
        first.setdefault(group[int(np.searchsorted(prints, np.uint64(fingerprint(text))))], doc)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())

    fresh = stages["suffix-array dedup"](spark, single, sf).cache()
    kept = by_bytes([(r.doc_id, r.text) for r in single.collect()], 100)
    assert {r.doc_id: r.text for r in fresh.collect()} == {d: k[3].decode("utf-8", "replace") for d, k in kept.items()}
    assert fresh.filter("n_chars <> length(text) AND length(text) = 0").count() == 0

    clean = stages["benchmark decontamination"](spark, fresh, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {doc for doc, _, n, _ in leaks([(r.doc_id, r.text) for r in fresh.collect()], items) if n}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in fresh.collect()} - hit

    coded = stages["byte-level bpe"](spark, clean, sf)
    assert sorted((r.doc_id, r.text) for r in coded.collect()) == sorted((r.doc_id, r.text) for r in clean.collect())
    assert coded.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_edges(spark, sf):
    """NULL ids and texts, repeated rows, extra columns with clashing names, and no rows at all."""
    text = "the thing ered and that " * 8
    rows = [(None, text, 1), (None, None, 2), (1, "", 3), (1, "", 3), (2, None, 4), (3, "Thing ered that. " * 20, 5), (3, "und die keit " * 20, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for start in (docs, docs.limit(0)):
        left = start
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, sf).cache()
            if name != "byte-level bpe":
                assert left.columns == start.columns
        assert left.count() <= start.count()


def test_pipeline_keeps_exact_rows(spark, sf):
    """Rows go by themselves: another row of the same id, or without an id, neither takes them along nor saves them."""
    stages = dict(corpus_pipeline.STAGES)
    one, two, three, four = ("red fox " * 20, "seven tall ships sail " * 20, "ein kleines Haus am See " * 20, "pan y agua para todos " * 20)
    rows = [
        (1, one, "a"), (None, one, "b"), (None, two, "c"),  # two is like no other text
        (2, three, "d"), (2, one, "e"), (2, four, "f"),  # different texts of one id
        (3, "solo " * 9, "g"), (3, "solo " * 9, "g"),  # one document
        (None, "nobody has this id " * 9, "h"), (None, "nobody has this id " * 9, "i"), (None, "nobody has this id " * 9, "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    left = sorted(r.mark for r in stages["simhash near-dedup"](spark, docs, sf).collect())
    assert left in (list("acdfgh"), list("acdfgi"))

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    rows = [(None, item, "a"), (None, one, "b"), (None, None, "c"), (5, item, "d"), (5, two, "e"), (6, one, "f"), (6, one, "f"), (7, item, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    left = sorted(r.mark for r in stages["benchmark decontamination"](spark, docs, sf).collect())
    assert left == list("bceff")
