"""Hard negatives against brute force, and that the threshold saves scoring."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyhouse.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, n int, kind string"


def brute(rows, every=10, first=5, k=5):
    usable = set()
    for number, vector, label in rows:
        if number is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.add((number, tuple(math.floor(256 * x) for x in vector), label))
    out = []
    for anchor, a, own in usable:
        if anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), i, label) for i, v, label in usable if i != anchor]
        alike = sorted((-s, i) for s, i, label in scored if label == own)[:first]
        for minus, positive in alike:
            inside = sorted((-s, i) for s, i, label in scored if label != own and 80 * -minus <= 100 * s <= 100 * -minus)
            out += [(anchor, positive, rank, i, -minus, -s) for rank, (s, i) in enumerate(inside[:k], 1)]
    return sorted(out)


def found(table, **more):
    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, **more)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(row[name] for name in names) for row in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"shard": 20, "chunk": 3, "group_anchors": 12}])
def test_against_brute_force(spark, sizes):
    """Ties, negative ids and scores, unusable rows, short vectors, one label for a third of all rows, columns of the
    names that are used inside."""
    pick = random.Random(3)
    some = lambda: [pick.choice([-0.5, 0.25, 0.1, 0.003, 1.0, 0.0]) for _ in range(5)]
    rows = [(i, some(), pick.choice([1, 1, 2, 3, 4])) for i in range(-60, 200)]
    rows += [(1000, None, 1), (1010, [None, 1.0], 1), (1020, [math.nan], 2), (1030, [math.inf], 2), (1040, [], 1), (1050, [2.0], 2), (None, [1.0], 1), (1060, [0.5], None)]
    rows += [(300 + i, [0.5] * 5, i % 2) for i in range(40)] + [(1070, [-1.0] * 5, 7), (1080, [0.0] * 5, 8)]
    rows += rows[5:9]
    table = spark.createDataFrame([(*row, 0, "x") for row in rows], SCHEMA).repartition(3)
    assert found(table, **sizes) == brute(rows)


def test_empty_and_alone(spark):
    table = spark.createDataFrame([(10, [1.0], 1, 0, "")], SCHEMA)
    assert found(table) == [] and found(table.limit(0)) == []


def test_different_rows_of_one_id(spark):
    """They are different rows, and take no part for an anchor of their id."""
    rows = [(10, [1.0], 1), (10, [0.9], 2), (11, [1.0], 1), (11, [0.9], 2), (11, [0.9], 2)]
    got = found(spark.createDataFrame([(*row, 0, "") for row in rows], SCHEMA))
    assert got == sorted([(10, 11, 1, 11, 256 * 256, 256 * 230)])


def test_large_components(spark):
    """Sums beyond the exact range of doubles stay exact; beyond 64 bits they are an error."""
    rows = [(10, [2.0**22, 1.0], 1), (11, [2.0**22 + 1 / 256, 1.0], 1), (12, [2.0**22, 0.996], 2), (13, [2.0**22 - 1 / 256, 1.0], 2)]
    assert found(spark.createDataFrame([(*row, 0, "") for row in rows], SCHEMA)) == brute(rows)
    for large in (2.0**30, 1e20):
        with pytest.raises(Exception, match="64 bits|62 bits"):
            found(spark.createDataFrame([(10, [large], 1, 0, ""), (11, [large], 1, 0, "")], SCHEMA))


def test_threshold_stops_early():
    """With one strong dimension an anchor meets few vectors; ties with the k-th score are not missed."""
    values = np.zeros((1000, 4), np.int64)
    values[:, 0] = np.arange(1000)[::-1]
    order = np.argsort(-values, axis=0, kind="stable").astype(np.uint16).T
    ids = np.arange(1000, dtype=np.int64)
    row = {"label": 1, "n": 1000, "dims": 4, "kind": "int64", "ids": ids.tobytes(), "ties": (ids * 0).tobytes(), "vectors": values.tobytes(), "orders": order.tobytes()}
    whole = np.array([[0, 0, 0, negatives.LEAST, negatives.MOST, 0]])
    anchor = negatives.Anchor(-1, 0, np.array([3, 0, 0, 0]), whole, 5)
    assert negatives.search(anchor, negatives.Shard(row)) < 100
    assert [r[5] for r in anchor.rows()] == [0, 1, 2, 3, 4]
