"""Find passages of benchmark items in documents by winnowing; built-in functions only.

Of every ``length`` neighbouring words the k-gram of the smallest hash is kept, in items and documents alike, so each
shared span of that length shares a kept k-gram. Kept grams of documents are joined with those of the items; around
each hit the words are compared with whole item windows. Grams carry their neighbourhood, so texts are read once and
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.stage import keep

LENGTH = 10
GRAM = 5
# Item tables counted to be no longer than this are sent to every executor; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Positions within a window are told apart by their last bits.
SLOT_BITS = 5
# Code of the one row per document that carries its counts; codes of grams are not negative.
COUNTS = -1


def words(text: Column) -> Column:
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(WORD), F.lit(0))


def _up_to(last: Column, f) -> Column:
    """``f`` of 0 .. ``last``; nothing if ``last`` is negative."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), f))


def _code(first: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``first`` on, without the bits of a slot."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(size), *(F.get("words", first + j) for j in range(size))), SLOT_BITS)


def _text(items: Column) -> Column:
    return F.array_join(items, " ")


def _winnowed(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds ``grams``, the codes of all k-grams with their slots, and ``kept``, the positions that are the minimum of
    some window. Both stay columns of their own: an array that is spelled out inside a lambda is made anew for every
    element."""
    n, window, slot = F.col("n_words"), length - gram + 1, 2**SLOT_BITS
    slotted = _up_to(n - gram, lambda i: F.shiftleft(_code(i, gram), SLOT_BITS) + i % slot)
    df = df.withColumn("grams", F.when(n >= length, slotted))
    least = lambda i: F.least(*(F.get("grams", i + j) for j in range(window)))
    place = _up_to(n - length, lambda i: (i + F.pmod(least(i) - i, F.lit(slot))).cast("int"))
    return df.withColumn("kept", F.array_distinct(place))


def _code_at(p: Column) -> Column:
    return F.shiftrightunsigned(F.element_at("grams", p + 1), SLOT_BITS)


def _found(length: int, gram: int, short: list[int]) -> Column:
    """What a document offers to the join: kept grams with their surroundings, and whole grams of the short lengths."""
    n = F.col("n_words")

    def around(p: Column) -> Column:
        base = F.greatest(p - (length - gram), F.lit(0))
        stop = F.least(p + length, n)
        return F.struct(
            _code_at(p).alias("code"),
            base.alias("base"),
            F.lit(length).alias("size"),
            _text(F.slice("words", base + 1, stop - base)).alias("context"),
        )

    def exactly(size: int):
        def one(i: Column) -> Column:
            context = _text(F.slice("words", i + 1, size))
            return F.struct(_code(i, size).alias("code"), i.alias("base"), F.lit(size).alias("size"), context.alias("context"))

        return one

    counts = F.array(
        F.struct(F.lit(COUNTS).cast("long").alias("code"), n.alias("base"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("context"))
    )
    none = F.slice(counts, 1, 0)
    parts = [F.transform("kept", around)] + [_up_to(n - size, exactly(size)) for size in short]
    return F.concat(counts, *(F.coalesce(part, none) for part in parts))


def _join(left: DataFrame, right: DataFrame, on: str, how: str, limit: int) -> DataFrame:
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids as sorted strings) for every row of ``docs``.

    A window is ``length`` neighbouring words of an item, or all words of a shorter item; a document word inside an
    occurrence of a window is hit. NULL and empty texts have no words: such documents are clean, such items have no
    window. Rows equal in id and text get equal results, one row each; rows of one id and different texts are
    judged apart; items of NULL id hit words but are not listed. Other columns are ignored.
    """
    listed = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{item_text}`").cast("string")).alias("words"))
    listed = keep(listed.withColumn("n_words", F.size("words")).filter("n_words > 0"), "items")
    short = sorted(row[0] for row in listed.filter(F.col("n_words") < length).select("n_words").distinct().collect())

    size = F.least("n_words", F.lit(length))
    spelled = _up_to(F.col("n_words") - size, lambda i: _text(F.slice("words", i + 1, size)))
    windows = listed.select("item", F.explode(F.array_distinct(spelled)).alias("window"))
    windows = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = keep(windows.withColumn("set", F.xxhash64("items")), "windows")
    sets = keep(windows.groupBy("set").agg(F.first("items").alias("items")), "sets")
    kept = _winnowed(listed, length, gram).select(F.explode(F.transform("kept", _code_at)).alias("code"))
    for m in short:
        kept = kept.union(listed.filter(F.col("n_words") == m).select(_code(F.lit(0), m)))
    codes = keep(kept.union(listed.sparkSession.range(1).select(F.lit(COUNTS).cast("long"))).distinct(), "codes")

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("words"))
    own = _winnowed(own.withColumn("n_words", F.size("words")), length, gram)
    offered = own.select("doc_id", "tie", F.explode(_found(length, gram, short)).alias("g")).select("doc_id", "tie", "g.*")
    hits = _join(offered, codes, "code", "left_semi", broadcast_rows)

    # Around a hit, all windows that hold the gram; the row of counts has none and stays by itself.
    context = F.split("context", " ")
    spelled = _up_to(F.size(context) - F.col("size"), lambda d: F.struct((F.col("base") + d).alias("start"), _text(F.slice(context, d + 1, F.col("size"))).alias("window")))
    hits = hits.select("doc_id", "tie", "code", "base", "size", F.explode_outer(F.when(F.col("code") != COUNTS, spelled)).alias("w"))
    hits = hits.select("doc_id", "tie", "code", "base", "size", "w.*")
    found = _join(hits, windows.select("window", "set"), "window", "left", broadcast_rows)
    found = found.filter((F.col("code") == COUNTS) | F.col("set").isNotNull())
    per_doc = found.groupBy("doc_id", "tie").agg(
        F.max(F.when(F.col("code") == COUNTS, F.col("base"))).alias("n_words"),
        F.count(F.when(F.col("code") == COUNTS, 1)).alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("code") != COUNTS, F.struct("start", "size")))).alias("spans"),
        F.collect_set("set").alias("sets"),
    )

    def cover(state: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        fresh = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct((state["hit"] + fresh).alias("hit"), F.greatest(state["end"], end).alias("end"))

    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    per_doc = per_doc.withColumn("n_hit", F.aggregate("spans", start, cover, lambda state: state["hit"])).drop("spans")
    named = per_doc.withColumn("set", F.explode_outer("sets")).drop("sets")
    named = _join(named, sets, "set", "left", broadcast_rows).withColumn("item", F.explode_outer("items"))
    # One row for each item of a document, so the counts are equal in all rows of a group.
    named = named.groupBy("doc_id", "tie").agg(
        *(F.max(name).cast("long").alias(name) for name in ("n_words", "n_hit", "rows")),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "rows"))
    return named.select("doc_id", "n_words", "n_hit", "items", copies.alias("copy")).drop("copy")
