"""How far the sources of a language differ in their use of words: an exact count, a recount through perfect hashes.

The first pass counts in how many documents of its language each term occurs, and keeps the frequent ones. They go into
shards of a minimal perfect hash, which are sent to all tasks in groups of checked size. The second pass looks every
term up, compares it with the stored key and adds to a dense array of slots for each (language, source). Shares are
integers from there on, so all results are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.perfect_hash import PerfectHash, build, hashes
from tallyhouse.llm.stage import keep

# Fixed value: terms are runs of letters and of all that is not ASCII; only A to Z are lower-cased.
# As a table of bytes: terms in lower case, blanks between them.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE, SMOOTHING = 1_000_000_000, 5
LEAST_DOCS, MOST_TERMS = 30, 50
# Keys of one shard on average; what one group of shards may hold; terms a task counts before it passes them on.
SHARD, GROUP_BYTES, HELD = 16_384, 32 << 20, 200_000
# Slots a task holds for all its groups before it passes the counts on.
SLOTS = 8 << 20
# Sources of one tile and slots of one block, where shares are compared.
TILE, BLOCK_BITS = 256, 10
LOCAL_BITS = 24
COUNTED = "lang binary, source binary, slot long, n long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield lang.as_py(), source.as_py(), text.as_py().translate(TERMS).split()


def _document_counts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, number of documents), summed until ``held`` terms are counted."""
    counts: dict[bytes, Counter] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            yield pa.record_batch([pa.array([lang] * len(found), pa.binary()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "term", "docs"])

    for lang, _, terms in _documents(batches):
        own = counts.setdefault(lang, Counter())
        size -= len(own)
        own.update(set(terms))
        size += len(own)
        if size > held:
            yield from out()
            counts.clear()
            size = 0
    yield from out()


def _build(table: pa.Table) -> pa.Table:
    """One shard: the perfect hash over the terms of one language and part."""
    sizes, bits, keys = build(table.column("term").to_pylist())
    if len(keys) >= 1 << LOCAL_BITS:
        raise ValueError("a shard holds too many terms; the hash of its parts is uneven")
    row = {"lang": table.column("lang")[0].as_py(), "part": table.column("part")[0].as_py(), "sizes": sizes, "bits": bits, "terms": keys, "n": len(keys), "bytes": sum(map(len, keys)) + 48 * len(keys)}
    return pa.Table.from_pylist([row], _SHARD)


SHARDS = "lang binary, part long, sizes array<long>, bits binary, terms array<binary>, n long, bytes long"
_SHARD = pa.schema([("lang", pa.binary()), ("part", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("terms", pa.list_(pa.binary())), ("n", pa.int64()), ("bytes", pa.int64())])


class Slots:
    """Dense counts of the groups that a task meets, one array of slots for each shard of the group's language."""

    def __init__(self, shards: list[dict], parts: int, most: int):
        self.parts, self.most, self.size = parts, most, 0
        self.hash: dict[bytes, dict[int, PerfectHash]] = {}
        for row in shards:
            self.hash.setdefault(row["lang"], {})[row["part"]] = PerfectHash(row["sizes"], row["bits"], row["terms"])
        self.counts: dict[tuple[bytes, bytes], dict[int, np.ndarray]] = {}

    def add(self, lang: bytes, by_source: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        """Count what the sources of a language have; each of its terms is looked up once, whatever the source."""
        shards = self.hash.get(lang)
        terms = list(set().union(*by_source.values())) if shards else []
        if not terms:
            return
        hashed, known = hashes(terms), {}
        part = (hashed & np.uint64(self.parts - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if (number := int(part[at[0]])) in shards:
                own = [terms[i] for i in at.tolist()]
                place = shards[number].numbers(own, hashed[at])
                known.update(zip(own, np.where(place < 0, -1, number << LOCAL_BITS | place).tolist(), strict=True))
        for source, found in by_source.items():
            slot = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
            times = np.fromiter(found.values(), np.int64, len(found))[slot >= 0]
            slot = slot[slot >= 0]
            arrays = self.counts.setdefault((lang, source), {})
            part = slot >> LOCAL_BITS
            for number in np.unique(part).tolist():
                if number not in arrays:
                    arrays[number] = np.zeros(len(shards[number].keys), np.int64)
                    self.size += len(arrays[number])
                # Each term comes once, so no two additions meet in a slot.
                at = part == number
                arrays[number][slot[at] & ((1 << LOCAL_BITS) - 1)] += times[at]
            if self.size > self.most:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), arrays in self.counts.items():
            for number, counts in arrays.items():
                at = np.flatnonzero(counts)
                columns = [pa.array([name] * len(at), pa.binary()) for name in (lang, source)]
                yield pa.record_batch([*columns, pa.array(number << LOCAL_BITS | at), pa.array(counts[at])], names=["lang", "source", "slot", "n"])
        self.counts.clear()
        self.size = 0


def _recount(batches: Iterator[pa.RecordBatch], sent, parts: int, held: int, most_slots: int) -> Iterator[pa.RecordBatch]:
    slots = Slots(sent.value.to_pylist(), parts, most_slots)
    waiting: dict[bytes, dict[bytes, Counter]] = {}
    size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        for lang, by_source in waiting.items():
            yield from slots.add(lang, by_source)
        waiting.clear()

    for lang, source, terms in _documents(batches):
        own = waiting.setdefault(lang, {}).setdefault(source, Counter())
        size -= len(own)
        own.update(terms)
        size += len(own)
        if size > held:
            yield from settle()
            size = 0
    yield from settle()
    yield from slots.out()


def _shard_groups(shards: DataFrame, parts: int, most_bytes: int) -> tuple[DataFrame, int]:
    """Shards with a ``group``, and the number of groups. A group is a run of parts that is no larger than it may be;
    parts are alike, and one by itself is small."""
    total = shards.agg(F.sum("bytes")).first()[0] or 0
    run = max(1, min(parts, parts * most_bytes // max(1, total)))
    while True:
        dealt = shards.withColumn("group", F.floor(F.col("part") / run))
        if run == 1 or not dealt.groupBy("group").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > most_bytes).take(1):
            return dealt, -(-parts // run)
        run = -(-run // 2)


def _tile(table: pa.Table) -> pa.Table:
    """Sums of differences between the sources of two tiles over one block of slots.

    Rows of slot -1 name a source and its share ``p`` of a term that it lacks. ``met`` is the number of slots that any
    source of the two tiles has here.
    """
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    tile, slot, p = (table.column(name).to_numpy() for name in ("tile", "slot", "p"))
    names = table.column("source").to_pylist()
    lacking = slot < 0
    index = {names[i]: k for k, i in enumerate(np.flatnonzero(lacking).tolist())}
    side = {names[i]: tile[i] for i in np.flatnonzero(lacking).tolist()}
    none = np.zeros(len(index), np.int64)
    for i in np.flatnonzero(lacking).tolist():
        none[index[names[i]]] = p[i]
    places, column = np.unique(slot[~lacking], return_inverse=True)
    shares = np.repeat(none[:, None], len(places), 1)
    rows = np.fromiter((index[names[i]] for i in np.flatnonzero(~lacking).tolist()), np.int64)
    shares[rows, column] = p[~lacking]
    left = [name for name in index if side[name] == low]
    right = [name for name in index if side[name] == high]
    out = {"source": [], "item": [], "value": [], "met": []}
    other = shares[[index[name] for name in right]]
    for name in left:
        out["source"] += [name] * len(right)
        out["item"] += right
        out["value"] += np.abs(other - shares[index[name]]).sum(axis=1, dtype=np.int64).tolist()
        out["met"] += [len(places)] * len(right)
    lang = pa.array([table.column("lang")[0].as_py()] * len(out["source"]), pa.binary())
    return pa.table([lang, *(pa.array(out[name], kind) for name, kind in (("source", pa.binary()), ("item", pa.binary()), ("value", pa.int64()), ("met", pa.int64())))], names=["lang", *out])


def _share(times: Column) -> Column:
    """1 + floor(SCALE * (count + s) / (N + s * V)) in whole numbers of any size."""
    wide = (times + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (F.col("total") + SMOOTHING * F.col("v")).cast("decimal(20,0)"))


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    most_terms: int = MOST_TERMS,
    shard: int = SHARD,
    group_bytes: int = GROUP_BYTES,
    held: int = HELD,
    most_slots: int = SLOTS,
    tile: int = TILE,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every (lang, source) group of the documents.

    A language keeps the V terms in at least ``least_docs`` of its documents. With N the occurrences of kept terms in a
    group, the share of a term that occurs ``count`` times there is p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).
    Part ``pair``: ``item`` is each other source of the language, ``value`` the sum of the differences of their shares
    over all kept terms, 0 if there is none. Part ``term``: ``item`` is each kept term of the group whose share is above
    that of the whole language, ``value`` the difference, to rank ``most_terms``. Ranks count from 1 by falling value,
    then by the bytes of the item.

    NULL in ``text``, ``lang`` or ``source`` counts as an empty string, and groups without a term take part. Each row is
    a document, repeated ones too; other columns are ignored, and an empty table gives no rows. A text of any length is
    read once in each pass; one must fit a worker's memory together with its terms.
    """
    spark = docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary").alias(to) for name, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = read.mapInArrow(partial(_document_counts, held=held), "lang binary, term binary, docs long")
    kept = keep(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs), "terms")
    terms = kept.count()
    # A power of two, so that the low bits of the hash name the part.
    parts = 1 << max(0, (-(-terms // shard) - 1).bit_length())
    dealt = kept.withColumn("part", F.xxhash64("term").bitwiseAND(F.lit(parts - 1)))
    shards = keep(dealt.groupBy("lang", "part").applyInArrow(_build, SHARDS), "shards")
    shards, passes = _shard_groups(shards, parts, group_bytes)
    cells = []
    for number in range(passes if terms else 0):
        sent = spark.sparkContext.broadcast(shards.filter(F.col("group") == number).select("lang", "part", "sizes", "bits", "terms").toArrow())
        found = read.mapInArrow(partial(_recount, sent=sent, parts=parts, held=held, most_slots=most_slots), COUNTED)
        cells.append(keep(found.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "cells"))
    cells = reduce(DataFrame.union, cells) if cells else spark.createDataFrame([], COUNTED)

    # One row for each group, with its total, the size of its language's vocabulary and the tile it is compared in.
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = groups.join(totals, ["lang", "source"], "left").join(tiles, "lang").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    groups = keep(groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "groups")

    shares = cells.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n")))
    whole = cells.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    whole = whole.join(of_lang, "lang").select("lang", "slot", _share(F.col("n")).alias("q"))
    value = F.col("p") - F.col("q")
    named = shards.select("lang", "part", F.posexplode("terms").alias("local", "item"))
    named = named.select("lang", F.shiftleft("part", LOCAL_BITS).bitwiseOR(F.col("local")).alias("slot"), "item")
    whole = whole.join(named, ["lang", "slot"])
    terms = shares.join(whole, ["lang", "slot"]).filter(value > 0).select("lang", "source", "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)

    # Every pair of tiles meets in every block of slots; a source is there even without a term in the block.
    block = F.shiftright("slot", BLOCK_BITS).alias("block")
    missing = groups.filter("v > 0").withColumn("p", _share(F.lit(0)))
    blocks = kept.select("lang").distinct().join(cells.select("lang", block).distinct(), "lang")
    absent = missing.join(blocks, "lang").select("lang", "source", "tile", "tiles", "block", F.lit(-1).cast("long").alias("slot"), "p")
    there = shares.select("lang", "source", "tile", "tiles", block, "slot", "p")
    with_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")
    met = there.union(absent).select("*", with_tile).select("*", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"))
    met = met.groupBy("lang", "block", "low", "high").applyInArrow(_tile, "lang binary, source binary, item binary, value long, met long")
    # A tile meets itself once and gives both orders; two different tiles give one, the other is its mirror.
    sums = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met")).filter("source <> item")
    place = groups.select("lang", "source", "tile", "v")
    if groups.filter("tiles > 1").take(1):
        place_of_item = place.select("lang", F.col("source").alias("item"), F.col("tile").alias("item_tile"))
        across = sums.join(place.select("lang", "source", "tile"), ["lang", "source"]).join(place_of_item, ["lang", "item"]).filter("tile <> item_tile")
        sums = sums.union(across.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value", "met"))
    bare = missing.select("lang", "source", "p", "v")
    other = bare.select("lang", F.col("source").alias("item"), F.col("p").alias("item_p"))
    pairs = sums.join(bare, ["lang", "source"]).join(other, ["lang", "item"])
    rest = (F.col("v") - F.col("met")) * F.abs(F.col("p") - F.col("item_p"))
    pairs = pairs.select("lang", "source", "item", (F.col("value") + rest).alias("value"))
    # Languages without a kept term: all their sources are alike.
    alike = groups.filter("v = 0").select("lang", "source")
    pairs = pairs.union(alike.join(alike.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long")))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    named = [rows.withColumn("part", F.lit(part)) for rows, part in ((pairs, "pair"), (terms, "term"))]
    texts = [F.col(name).cast("string").alias(name) for name in ("lang", "source")]
    return named[0].unionByName(named[1]).select(*texts, "part", F.col("item").cast("string").alias("item"), "value", "rank")
