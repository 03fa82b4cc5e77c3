"""Divergence of sources against brute force, and the perfect hash."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm.divergence import source_divergence
from tallyhouse.llm.perfect_hash import PerfectHash, build, hashes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, lang string, source string, text string, term int, slot string"


def brute(docs, least, most):
    texts = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in docs]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        times = Counter(term for _, _, terms in own for term in set(terms))
        kept = sorted(term for term, n in times.items() if n >= least)
        counts = {source: Counter() for _, source, _ in own}
        for _, source, terms in own:
            counts[source].update(t for t in terms if times[t] >= least)
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in counts.items()}
        total = sum(counts.values(), Counter())
        q = {t: share(total[t], total.total()) for t in kept}
        for source in counts:
            pairs = [(-sum(abs(p[source][t] - p[other][t]) for t in kept), other) for other in counts if other != source]
            terms = [(q[t] - p[source][t], t) for t in kept if counts[source][t] and p[source][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:top]
                out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard": 10, "group_bytes": 4000, "held": 10, "most_slots": 8, "tile": 2}])
def test_against_brute_force(spark, sizes):
    """Shards, passes, flushed slots and tiles; NULLs, empty texts, a language without terms, one with one source."""
    pick = random.Random(4)
    words = ["the", "The", "ÉTÉ", "été", "日本", "x", "öl", "zz", "a1b", "und", "l'eau", "\x00q", "no-go"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(pick.choice(["en", "en", "de", None, ""]), pick.choice(["a", "b", "c", "d", "é", None]), " ".join(pick.choice(words) for _ in range(pick.randint(0, 25)))) for _ in range(200)]
    docs += [("fr", "a", "seul"), ("fr", "b", "autre"), ("it", "z", "uno " * 20), ("en", "silent", None), ("en", "silent", ""), ("en", "silent", "42 !"), ("de", "x", "und " * 5000)]
    docs += [docs[0]] * 30
    table = spark.createDataFrame([(i % 50, *doc, i, "s") for i, doc in enumerate(docs)], SCHEMA).repartition(5)
    got = source_divergence(table, least_docs=8, most_terms=6, **sizes).collect()
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in got) == brute(docs, 8, 6)


def test_nothing(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert source_divergence(table).count() == 0
    lone = spark.createDataFrame([(1, "en", "a", "one two", 0, ""), (2, "en", "b", None, 0, "")], SCHEMA)
    assert sorted((r.source, r.part, r["item"], r.value) for r in source_divergence(lone).collect()) == [("a", "pair", "b", 0), ("b", "pair", "a", 0)]


def test_perfect_hash(spark):
    keys = [f"key {i}".encode() for i in range(5000)] + [b"", "é".encode()]
    table = PerfectHash(*build(keys))
    numbers = table.numbers(keys, hashes(keys))
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    assert [table.keys[n] for n in numbers] == keys
    foreign = [f"other {i}".encode() for i in range(5000)]
    assert set(table.numbers(foreign, hashes(foreign)).tolist()) == {-1}
    with pytest.raises(ValueError):
        build([b"a", b"a"])
    assert build([]) == ([], b"", []) and PerfectHash([], b"", []).numbers([b"a"], hashes([b"a"])).tolist() == [-1]
    column = spark.createDataFrame([(bytearray(key),) for key in keys], "k binary").select(F.xxhash64("k")).collect()
    assert [row[0] % 2**64 for row in column] == hashes(keys).tolist()
