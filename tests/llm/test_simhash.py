"""SimHash near-dedup: fingerprints, trie links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from tallyhouse.llm import simhash
from tallyhouse.llm.components import components


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def smallest(prints):
    """Smallest index of each component of distinct fingerprints."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 2) + i + 1:
            links += 1
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return [root(i) for i in range(len(prints))], links


def clustered():
    """Chains of small steps, and one dense ball that shares its first bits."""
    pick = random.Random(5)
    base = [pick.getrandbits(64) for _ in range(150)]
    prints = list(base)
    for x in base[:30]:
        for _ in range(20):
            x ^= 1 << pick.randrange(64)
            prints.append(x)
    prints += [base[0] ^ sum({1 << pick.randrange(40) for _ in range(pick.randint(0, 3))}) for _ in range(1500)]
    return np.unique(np.array(prints, np.uint64))


def test_trie_links_find_every_pair():
    prints = clustered()
    _, links = smallest(prints)
    found = {(int(i), int(j)) for a, b in simhash.trie_links(prints, None, 2, chunk=64) for i, j in zip(a, b)}
    assert len(found) == links
    left, right = prints[::2], prints[1::2]
    between = sum(len(a) for a, _ in simhash.trie_links(left, right, 2))
    within = sum(len(a) for part in (left, right) for a, _ in simhash.trie_links(part, None, 2))
    assert between + within == links


def test_links_over_cut_nodes_give_the_components(spark):
    prints = clustered()
    expected, _ = smallest(prints)
    signed = [int(x) for x in prints.view(np.int64)]
    table = spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(3)
    for node_size in (40, 4096):
        tree = {r.a: r.b for r in components(simhash.fingerprint_links(table, 2, node_size)).collect()}
        groups = {}
        for own, first in zip(signed, expected):
            groups.setdefault(first, []).append(own)
        assert all(tree.get(x, x) == min(group) for group in groups.values() for x in group)


def test_documents(spark):
    texts = [None, "", " \t", "one", "one two", "A b C d", "a B c D", "x y z " * 50, "été ÉTÉ foo", "one"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1), (None, "alone here now", 1), (3, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted((g[1] for g in got)) == sorted(fingerprint(row[1]) for row in rows)
    component = {doc: c for doc, _, c in got if doc is not None}
    assert component[0] == component[1] == component[2] == 0
    assert component[9] == component[3] == 3 and component[6] == component[5] == 5
    assert sorted((c for doc, _, c in got if doc is None), key=str) == sorted([3, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    tree = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert tree == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}
