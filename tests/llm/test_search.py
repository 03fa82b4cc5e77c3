"""Decontamination and exact top-k against brute force."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, stage, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, found = words(text), set()
        hit = [0] * len(own)
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    found |= windows[tuple(own[i : i + size])]
                    hit[i : i + size] = [1] * size
        out.append((doc, len(own), sum(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [500_000, 1])
def test_leaks(spark, broadcast_rows):
    """Few words, so that k-grams meet by chance; items shorter than a k-gram and than a window; all joins."""
    pick = random.Random(5)
    some = lambda n: " ".join(pick.choice(["a", "B", "c1", "Éte", "über", "x"]) for _ in range(n))
    items = [(i, some(pick.choice([3, 7, 9, 10, 12, 30]))) for i in range(25)] + [(100, None), (101, "..."), (None, some(12))]
    docs = [(i, " ".join(pick.choice([some(pick.randint(0, 12)), pick.choice(items)[1] or ""]) for _ in range(pick.randint(0, 8)))) for i in range(80)]
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, "a b"), (3, "a b"), (202, "über " * 3000)]
    table = spark.createDataFrame([(*doc, 0) for doc in docs], "doc_id long, text string, code int").repartition(4)
    found = decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=str) == leaks(docs, items)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_leaks(docs, none).collect()] == [(1, 3, 0, [])]
    assert decontaminate.find_leaks(docs.limit(0), none).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.find_leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("shard, group, block", [(4096, 2**24, 64), (50, 170, 7)])
def test_top_k(spark, shard, group, block):
    pick = random.Random(1)
    rows = [(i, [pick.choice([-0.5, 0.25, 0.1, 0.003, 1.0]) for _ in range(6)]) for i in range(-100, 300)]
    rows += [(1000, None), (1050, [None, 1.0]), (1100, [math.nan]), (1150, [math.inf]), (1200, []), (1250, [2.0]), (None, [1.0]), (3, [0.1] * 6)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)] + [(5, rows[105][1])]
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for query, q in usable:
        if query % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != query)
            expected |= {(query, rank, i, -score) for rank, (score, i) in enumerate(scored[:5], 1)}
    table = spark.createDataFrame([(*row, 0) for row in rows], "vec_id long, embedding array<double>, chunk int").repartition(3)
    found = topk.top_k(table, shard=shard, group_bytes=group, block=block).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_bounds_prune_across_shards():
    """A query that knows its k-th score, from seeds or from an earlier shard, scores fewer blocks; results stay."""
    pick = np.random.default_rng(3)
    centres = pick.integers(-100, 100, (40, 16))
    vectors = (centres[np.arange(4000) // 100] + pick.integers(-9, 9, (4000, 16))).astype(np.int64)
    ids, queries = np.arange(4000), vectors[::50]
    shards = [(ids[at : at + 500], vectors[at : at + 500]) for at in range(0, 4000, 500)]
    apart = carried = 0
    search = topk.Search(ids[::50], queries, np.full(80, topk.NONE), 5)
    for shard in shards:
        apart += topk.Search(ids[::50], queries, np.full(80, topk.NONE), 5).add(*shard, 64)
        carried += search.add(*shard, 64)
    seeded = topk.Search(ids[::50], queries, search.score[:, -1], 5)
    knowing = sum(seeded.add(*shard, 64) for shard in shards)
    assert knowing < carried < apart < 80 * 4000
    plain = queries @ vectors.T
    for row, (own, scores) in enumerate(zip(ids[::50], plain, strict=True)):
        best = sorted((-score, i) for i, score in enumerate(scores.tolist()) if i != own)[:5]
        for done in (search, seeded):
            assert list(zip((-done.score[row]).tolist(), done.found[row].tolist(), strict=True)) == best


def test_top_k_stores_no_product(spark):
    """What is stored grows as the vectors do, however many passes there are over them."""
    sizes = []
    for n in (2000, 8000):
        folder = Path(stage.shared_folder(spark).removeprefix("file:")) / "llm"
        old = set(folder.glob("*"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: (F.xxhash64("id", x) % 1000) / 1000)
        rows = spark.range(n).select(F.col("id").alias("vec_id"), vector.alias("embedding"))
        assert topk.top_k(rows, every=100, shard=250, group_bytes=2**12).count() == 5 * n // 100
        new = [path for path in folder.glob("shards-*") if path not in old]
        sizes.append(sum(file.stat().st_size for path in new for file in path.glob("*.parquet")))
    assert sizes[1] < 5 * sizes[0]


def test_top_k_overflow(spark):
    for large in (1e20, 2.0**40):
        rows = spark.createDataFrame([(0, [large, 1.0]), (1, [large, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="62 bits"):
            topk.top_k(rows).collect()


def test_passes():
    """Pieces go together up to each limit, in whatever order they come and from however many tasks."""
    assert stage.passes([], 10) == []
    pieces = [(2 << 32, 4), (0, 4), (1, 6), (1 << 32, 11), (3 << 32, 1)]
    assert stage.passes(pieces, 10) == [(0, 1), (1 << 32, 1 << 32), (2 << 32, 3 << 32)]
    assert stage.passes([(number << 32, 10, 1) for number in range(211)], 16 << 20, 100) == [(0, 99 << 32), (100 << 32, 199 << 32), (200 << 32, 210 << 32)]
