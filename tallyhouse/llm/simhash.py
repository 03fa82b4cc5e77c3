"""Near-duplicates by SimHash fingerprints, linked by a self-join of their binary trie.

The trie of all distinct fingerprints is cut where its nodes are small. Pairs of these nodes are traversed together
from the root; a pair is dropped as soon as its paths differ in more bits than allowed. Each surviving pair of cut
nodes is one group of a shuffle, and its task goes on with the same traversal below. A fingerprint has a bounded number
of partners whatever the size of the corpus, since copies share a fingerprint; a task passes on a forest of its links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.hashing import word_spans
from tallyhouse.llm.stage import NO_ID, column_of, keep, split_bytes

SHINGLE = 3
MAX_BITS = 2
FIRST_DEPTH, MORE_DEPTH, BITS = 12, 4, 64
NODE_SIZE = 4096


def _fingerprint(text: np.ndarray, shingle: int) -> int:
    """Bits set in more than half of the hashes of the word shingles, repeats included; 0 without words."""
    begin, end = word_spans(text, np.array([0, len(text)]))
    if not len(begin):
        return 0
    size = end - begin + 1
    stop = np.cumsum(size)
    joined = np.append(text, np.uint8(32))[np.repeat(begin - stop + size, size) + np.arange(stop[-1])]
    joined[stop - 1] = 32
    joined = joined.tobytes()
    first = (stop - size).tolist()
    last = (stop[min(shingle, len(size)) - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), 1 << 14):
        hashes = [digest(joined[a:b], 42) for a, b in zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=False)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(last)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for begin, stop, data, offsets in split_bytes(column_of(batch, "text"), 4 << 20):
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
            found += [_fingerprint(data[offsets[i] : offsets[i + 1]], shingle) for i in range(stop - begin)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=[batch.schema.names[0], "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long, for every row."""
    columns = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return columns.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fingerprint long")


def cut_trie(prints: DataFrame, node_size: int) -> list[tuple[int, int]]:
    """Nodes (depth, path) that together hold all fingerprints, at most ``node_size`` each.

    The size is raised with the corpus so that there are never more than some thousands of nodes; only counts of nodes
    come to the driver, and nodes are counted more finely only below those that are too large.
    """
    def counted(df: DataFrame) -> list[tuple[int, int]]:
        path = F.shiftrightunsigned("fingerprint", BITS - depth)
        return [tuple(row) for row in df.groupBy(path.alias("path")).count().collect()]

    counts: dict[tuple[int, int], int] = {}
    known, depth = 0, FIRST_DEPTH
    level = counted(prints)
    node_size = max(node_size, sum(n for _, n in level) >> FIRST_DEPTH)
    while True:
        for path, n in level:
            counts[depth, path] = n
            for up in range(depth - 1, known if known else -1, -1):
                above = up, path >> (depth - up)
                counts[above] = counts.get(above, 0) + n
        large = [path for path, n in level if n > node_size]
        if not large or depth == BITS:
            break
        inside = F.shiftrightunsigned("fingerprint", BITS - depth).isin(large)
        known, depth = depth, min(BITS, depth + MORE_DEPTH)
        level = counted(prints.filter(inside))
    nodes, stack = [], [(0, 0)] if level else []
    while stack:
        node = stack.pop()
        below = [x for x in ((node[0] + 1, 2 * node[1] + 1), (node[0] + 1, 2 * node[1])) if x in counts]
        if counts[node] > node_size and below:
            stack += below
        else:
            nodes.append(node)
    return nodes


def node_pairs(nodes: list[tuple[int, int]], max_bits: int) -> list[tuple[int, int]]:
    """Numbers of the node pairs, each node with itself included, whose common bits differ in at most ``max_bits``."""
    begin = [path << (BITS - depth) for depth, path in nodes]
    found, stack = [], [(0, len(nodes), 0, len(nodes), 0, 0)] if nodes else []

    def halves(lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
        """The two sides of a node at a bit; a cut node that ends above has no bit there."""
        if hi - lo == 1 and nodes[lo][0] <= depth:
            return [(lo, hi, -1)]
        bit = BITS - 1 - depth
        mid = bisect_left(begin, (begin[lo] >> bit | 1) << bit, lo, hi)
        return [x for x in ((lo, mid, 0), (mid, hi, 1)) if x[0] < x[1]]

    while stack:
        a0, a1, b0, b1, differ, depth = stack.pop()
        if a1 - a0 == b1 - b0 == 1 and (nodes[a0][0] <= depth or nodes[b0][0] <= depth):
            found.append((a0, b0))
            continue
        for x0, x1, x in halves(a0, a1, depth):
            for y0, y1, y in halves(b0, b1, depth):
                more = differ + (x != y and x >= 0 and y >= 0)
                if more <= max_bits and (x0, x1) <= (y0, y1):
                    stack.append((x0, x1, y0, y1, more, depth + 1))
    return found


DEALT = "cell int, side int, prints binary"


def _deal(batches: Iterator[pa.RecordBatch], begin: np.ndarray, cells: list[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.sort(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        bounds = np.append(np.searchsorted(prints, begin), len(prints))
        rows = [
            (cell, side, prints[bounds[node] : bounds[node + 1]].tobytes())
            for node in np.flatnonzero(np.diff(bounds)).tolist()
            for cell, side in cells[node]
        ]
        if rows:
            columns = zip(*rows, strict=True)
            types = (pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cell", "side", "prints"])


def trie_links(left: np.ndarray, right: np.ndarray | None, max_bits: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct fingerprints that differ in at most ``max_bits`` bits; without ``right`` within
    ``left``. Node pairs are pairs of ranges; they are taken depth first in chunks, so memory stays bounded."""
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    stack = [(0, *(np.array([x], np.int64) for x in (0, len(left), 0, len(right), 0)))]

    def middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        rest = np.uint64(BITS - 1 - depth)
        first_set = ((values[lo] >> rest) | np.uint64(1)) << rest
        return np.clip(np.searchsorted(values, first_set), lo, hi)

    while stack:
        depth, a0, a1, b0, b1, differ = stack.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, differ))), (depth, *(x[half:] for x in (a0, a1, b0, b1, differ)))]
            continue
        few = (a1 - a0) * (b1 - b0) <= 16
        if few.any():
            wide = (b1 - b0)[few]
            size = (a1 - a0)[few] * wide
            which = np.repeat(np.arange(len(size)), size)
            number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = a0[few][which] + number // wide[which], b0[few][which] + number % wide[which]
            near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, differ = (x[~few] for x in (a0, a1, b0, b1, differ))
        if not len(a0):
            continue
        am, bm = middle(left, a0, a1, depth), middle(right, b0, b1, depth)
        same = (a0 == b0) & (a1 == b1) if own else np.zeros(len(a0), bool)
        sides = [(a0, am, b0, bm, differ, None), (am, a1, bm, b1, differ, None), (a0, am, bm, b1, differ + 1, None), (am, a1, b0, bm, differ + 1, ~same)]
        parts = []
        for x0, x1, y0, y1, more, wanted in sides:
            take = (x0 < x1) & (y0 < y1) & (more <= max_bits)
            if wanted is not None:
                take &= wanted
            parts.append([x[take] for x in (x0, x1, y0, y1, more)])
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))


def _link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of each pair; every node then points at the smallest of its tree."""
    while True:
        i, j = parent[i], parent[j]
        apart = i != j
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _cell_links(table: pa.Table, max_bits: int) -> pa.Table:
    sides = [[], []]
    for side, prints in zip(table.column("side").to_pylist(), table.column("prints").to_pylist(), strict=True):
        sides[side].append(np.frombuffer(prints, np.uint64))
    left = np.sort(np.concatenate(sides[0])) if sides[0] else np.zeros(0, np.uint64)
    right = np.sort(np.concatenate(sides[1])) if sides[1] else None
    both = left if right is None else np.concatenate((left, right))
    parent = np.arange(len(both))
    if right is not None or table.column("cell")[0].as_py() % 2 == 0:
        for i, j in trie_links(left, right, max_bits):
            parent = _link(parent, i, j if right is None else j + len(left))
    linked = np.flatnonzero(parent != np.arange(len(both)))
    return pa.table({"a": both[linked].view(np.int64), "b": both[parent[linked]].view(np.int64)})


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints within ``max_bits`` bits; ``prints`` is distinct."""
    nodes = cut_trie(prints, node_size)
    cells: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for number, (a, b) in enumerate(node_pairs(nodes, max_bits)):
        # Even numbers are nodes with themselves.
        cells[a].append((2 * number + (a != b), 0))
        if a != b:
            cells[b].append((2 * number + 1, 1))
    begin = np.array([path << (BITS - depth) for depth, path in nodes], np.uint64)
    dealt = prints.select("fingerprint").mapInArrow(partial(_deal, begin=begin, cells=cells), DEALT)
    return dealt.groupBy("cell").applyInArrow(lambda cell: _cell_links(cell, max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, node_size: int = NODE_SIZE
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` for every row.

    Letters A to Z are lower-cased; words are runs of bytes other than space and 0x09 to 0x0D. A text of fewer words
    than a shingle is one shingle; a text without words, empty or NULL, has fingerprint 0 and links like any other. The
    component is the smallest id reachable over links of at most ``max_bits`` differing bits; NULL ids never name one
    unless a component has no other. Repeated rows share their component. Other columns are ignored.
    """
    own = keep(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = keep(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    tree = components(fingerprint_links(distinct, max_bits, node_size))
    members = tree.unionByName(tree.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "fingerprint")
    smallest = members.join(distinct, "fingerprint").groupBy("b").agg(F.min("first").alias("reached"))
    reached = members.join(smallest, "b").select("fingerprint", "reached")
    named = distinct.join(reached, "fingerprint", "left").select(
        "fingerprint", F.coalesce("reached", "first").alias("component_id")
    )
    # Stored, so that both sides of the join are plain shuffles and a fingerprint of many documents can be split.
    return own.join(keep(named, "named"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def later_copies(rows: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """``doc``, ``tie`` of all documents but the first of each component; ``rows`` is from ``identified``.

    The first has the smallest id, then the smallest tie; documents without an id come after all others. Components are
    those of ``near_duplicates``, known by a fingerprint instead of an id.
    """
    texts = rows.select(F.struct("doc", "tie").alias("key"), F.col(f"row.`{text}`").cast("string").alias("text"))
    found = texts.mapInArrow(partial(_fingerprints, shingle=shingle), "key struct<doc:long,tie:long>, fingerprint long")
    order = F.struct((F.col("key.doc") == NO_ID).alias("unnamed"), "key.doc", "key.tie")
    own = keep(found.select(order.alias("at"), "fingerprint"), "fingerprints")
    distinct = keep(own.groupBy("fingerprint").agg(F.min("at").alias("first")), "distinct")
    tree = components(fingerprint_links(distinct, max_bits, node_size))
    members = tree.unionByName(tree.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "fingerprint")
    smallest = members.join(distinct, "fingerprint").groupBy("b").agg(F.min("first").alias("reached"))
    reached = members.join(smallest, "b").select("fingerprint", "reached")
    firsts = distinct.join(reached, "fingerprint", "left").select("fingerprint", F.coalesce("reached", "first").alias("first"))
    # Stored for the same reason as in near_duplicates.
    later = own.join(keep(firsts, "firsts"), "fingerprint").filter("at <> first")
    return later.select("at.doc", "at.tie")
