"""Incremental loads that replace re-issued months.

The pieces are lazy DataFrame functions; :func:`month_batch` composes them into the table a load leaves behind and
:func:`load_month_batch` writes only the months that change.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID, month_id
from tallyhouse.operators.lookups import BROADCAST_ROWS, hot_keys
from tallyhouse.sources import sinks

LATEST = "latest"
ALL_PENDING = "all_pending"


def _newest(df: DataFrame, load_ts: str) -> Column:
    """Highest load time as a scalar subquery: one value, computed once, that also reaches the scan as a filter."""
    return df.agg(F.max(load_ts)).scalar()


def touched_months(source: DataFrame, ts: str = "txn_time", load_ts: str = "load_ts") -> DataFrame:
    """Months that hold rows of the latest load."""
    latest = source.filter(F.col(load_ts) == _newest(source, load_ts))
    month = F.col(MONTH_ID) if MONTH_ID in source.columns else month_id(F.col(ts))
    return latest.select(month.alias(MONTH_ID)).distinct()


def pending_months(
    source: DataFrame, target: DataFrame, ts: str = "txn_time", load_ts: str = "load_ts"
) -> DataFrame:
    """Months of every load the target has not seen, for runs that skipped a load."""
    month = F.col(MONTH_ID) if MONTH_ID in source.columns else month_id(F.col(ts))
    return newer_than(source, target, load_ts).select(month.alias(MONTH_ID)).distinct()


def file_month(uri: Column) -> Column:
    """Month in a file name that ends in ``yymm.csv``; two-digit years from 69 on belong to the last century."""
    stamp = F.replace(F.right(uri, F.lit(8)), F.lit(".csv"), F.lit(""))
    year = F.substring(stamp, 1, 2).cast("int")
    century = F.when(year >= 69, 1900).otherwise(2000)
    first_day = F.make_date(century + year, F.substring(stamp, 3, 2).cast("int"), F.lit(1))
    return month_id(first_day)


def touched_months_from_files(catalog: DataFrame, uri: str = "uri", load_ts: str = "load_ts") -> DataFrame:
    """Months that the names of the newest files stand for."""
    latest = catalog.filter(F.col(load_ts) == _newest(catalog, load_ts))
    return latest.select(file_month(F.col(uri)).alias(MONTH_ID)).distinct()


def drop_months(target: DataFrame, months: DataFrame) -> DataFrame:
    """The target without those months. Distinct months are few whatever the table holds."""
    return target.join(F.broadcast(months.select(MONTH_ID).distinct()), MONTH_ID, "left_anti").select(*target.columns)


def drop_files(target: DataFrame, files: DataFrame, uri: str = "uri") -> DataFrame:
    """The target without the lines of those files, for files that hold lines outside their month."""
    names = files.select(F.col(uri).alias("src_file")).distinct()
    return target.join(names, "src_file", "left_anti").select(*target.columns)


def newer_than(source: DataFrame, target: DataFrame, load_ts: str = "load_ts") -> DataFrame:
    """Source rows loaded after everything in the target; all of them if the target is empty."""
    newest = _newest(target, load_ts)
    return source.filter(newest.isNull() | (F.col(load_ts) > newest))


def newer_than_month(source: DataFrame, target: DataFrame, load_ts: str = "load_ts") -> DataFrame:
    """Source rows loaded after the start of the target's latest load month."""
    newest = target.agg(F.date_trunc("month", F.max(load_ts))).scalar()
    return source.filter(newest.isNull() | (F.col(load_ts) > newest))


def append_columns(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Both tables' rows; a column only one side has is NULL for the other."""
    return target.unionByName(updates, allowMissingColumns=True)


# A membership filter has this many bits for each key, and at most so many 64-bit words. With more keys it has fewer bits
# for each, down to the least that still tells.
FILTER_BITS, FILTER_WORDS, LEAST_BITS = 16, 1 << 20, 2
# Copies of those updates' keys that own many stored rows, which are dealt over them.
SALTS = 16


def _positions(key: str, words: int) -> list[tuple[Column, Column]]:
    """Word and bit of a key in a membership filter, twice, from two hashes."""
    places = (F.xxhash64(key), F.xxhash64(F.lit(1), key))
    return [(F.pmod(F.shiftrightunsigned(x, 6), F.lit(words)).cast("int"), F.pmod(x, F.lit(64)).cast("int")) for x in places]


def membership(updates: DataFrame, key: str, count: int, asked: str | None = None) -> Column | None:
    """A Bloom filter over the keys of ``updates``, which hold about ``count`` of them: whether the key of a row of
    another table may be among them, which is in the column ``asked`` there if not in ``key``. None beyond the size that
    every task can hold.

    It never says no to a key that is there; about one foreign key in seventy passes, and two in five where the least
    bits are left. The filter is one array, built by sums of bits in the tasks and read as a scalar subquery by the scan.
    """
    if LEAST_BITS * count > 64 * FILTER_WORDS:
        return None
    words = max(1, min(-(-FILTER_BITS * count // 64), FILTER_WORDS))
    places = [F.struct(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")) for word, bit in _positions(key, words)]
    # Words without a bit are rows like the others: one sort makes the array, no word is looked up.
    empty = updates.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    bits = updates.select(F.inline(F.array(*places))).unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = bits.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    array = held.select(F.col("held.bits").alias("words")).scalar()
    hits = [F.getbit(F.get(array, word), bit) == 1 for word, bit in _positions(asked or key, words)]
    return hits[0] & hits[1]


def merge_by_key(target: DataFrame, updates: DataFrame, key: str, count: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Upsert: updates replace target rows of equal key and are added otherwise.

    A NULL key equals nothing, so such rows skip the join and cannot pile up in one task. Two updates for one stored
    row are an error that fails the job; repeated keys the target does not hold are all added.

    Updates that were counted to be few are sent to every task, and stored rows stay where they are. Otherwise stored
    rows whose key cannot be among the updates, as a membership filter tells, stay where they are, and only the others
    are shuffled; there the rows of a key that owns many are dealt over several tasks. ``count`` is the number of
    updates, which are counted if it is not given.
    """
    named = updates.filter(F.col(key).isNotNull())
    count = named.count() if count is None else count
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("_updates"))
    clash = F.concat(F.lit(f"several updates for one stored row, {key} = "), F.col(key))
    clear = F.when(F.col("_updates") > 1, F.raise_error(clash).cast("boolean")).otherwise(F.col("_updates").isNull())
    if count <= max_rows:
        kept = target.join(F.broadcast(counts), key, "left").filter(clear)
        return append_columns(kept.select(*target.columns), updates)
    may_hold = membership(named, key, count, "_asked")
    # A generated column: a key that is an expression is computed once for a row and not for each word and bit.
    asked = target.withColumn("_asked", F.explode(F.array(key)))
    # Of a NULL key nothing is possible.
    possible = F.col("_asked").isNotNull() & (F.lit(True) if may_hold is None else may_hold)
    met = asked.filter(possible).drop("_asked")
    hot = F.broadcast(hot_keys(met, [key]))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*target.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = met.join(hot, key, "left").withColumn("_salt", salt)
    last = F.when(F.col("_hot"), SALTS - 1).otherwise(F.lit(0))
    copies = counts.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    kept = salted.join(copies, [key, "_salt"], "left").filter(clear).select(*target.columns)
    untouched = asked.filter(~F.coalesce(possible, F.lit(False))).drop("_asked")
    return append_columns(append_columns(untouched, kept), updates)


def _named_or_newer(source: DataFrame, months: DataFrame, newest: Column, load_ts: str) -> DataFrame:
    """Every source row of the named months, and of the others those of a newer load."""
    marked = source.join(F.broadcast(months.select(MONTH_ID, F.lit(True).alias("_named")).distinct()), MONTH_ID, "left")
    rows = marked.filter(F.coalesce("_named", F.lit(False)) | newest.isNull() | (F.col(load_ts) > newest))
    return rows.select(*source.columns)


def month_batch(
    target: DataFrame | None,
    source: DataFrame,
    months: DataFrame,
    key: str | None,
    load_ts: str = "load_ts",
    files: DataFrame | None = None,
) -> DataFrame:
    """The table after a load: first run everything, later runs with the touched months replaced.

    A touched month is replaced by all that the source holds of it; of other months only rows of a newer load are taken.
    ``files`` makes the load replace the lines of those files instead of whole months. Only stored lines in months of
    the updates take part in the merge, since the line id covers the time.
    """
    if target is None:
        return source
    if files is None:
        remaining = drop_months(target, months)
        updates = _named_or_newer(source, months, _newest(remaining, load_ts), load_ts)
    else:
        remaining = drop_files(target, files)
        names = files.select(F.col("uri").alias("src_file")).distinct()
        newer = newer_than(source.join(names, "src_file", "left_anti").select(*source.columns), remaining, load_ts)
        updates = newer.unionByName(source.join(names, "src_file", "left_semi").select(*source.columns))
    if key is None:
        return append_columns(remaining, updates)
    met = F.broadcast(updates.select(MONTH_ID).distinct())
    merged = merge_by_key(remaining.join(met, MONTH_ID, "left_semi").select(*remaining.columns), updates, key)
    return append_columns(remaining.join(met, MONTH_ID, "left_anti").select(*remaining.columns), merged)


def months_of(*frames: DataFrame) -> set:
    """Distinct months as a list the driver can hold: they follow the calendar, whatever the tables hold."""
    months = reduce(DataFrame.union, (df.select(MONTH_ID) for df in frames)).distinct()
    return {row[0] for row in months.collect()}


def in_months(months: set) -> Column:
    known = F.coalesce(F.col(MONTH_ID).isin(*(m for m in months if m is not None)), F.lit(False))
    return known | F.col(MONTH_ID).isNull() if None in months else known


def replace_months(spark: SparkSession, path: str, table: DataFrame, changed: set, placed: bool = False) -> None:
    """Make the stored table equal ``table`` in the changed months; months without rows are emptied.

    ``table`` holds rows of these months only. ``placed`` is that of ``sinks.store_months``.
    """
    sinks.store_months(table, path, changed, placed=placed)


# So many files are named in a plan to keep them from being read; beyond, old exports are read and filtered by month.
NAMED_FILES = 10_000


def _not_read_for(known: DataFrame, lost: set) -> list[str] | None:
    """Files, with their load times, of which the stored lines show that they hold none of the lost months."""
    mark = F.concat("src_file", F.lit("|"), F.unix_micros("load_ts").cast("string")).alias("mark")
    files = known.filter("src_file IS NOT NULL").groupBy("src_file", "load_ts").agg(F.bool_or(in_months(lost)).alias("asked"))
    names = [row.mark for row in files.filter("NOT asked").select(mark).limit(NAMED_FILES + 1).collect()]
    return names if len(names) <= NAMED_FILES else None


def load_month_batch(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    months: DataFrame | None = None,
    key: str | None = "txn_id",
    load_ts: str = "load_ts",
    mode: str = LATEST,
    files: DataFrame | None = None,
    only_newer: bool = True,
    before: Callable[[set], None] | None = None,
    placed: bool = False,
) -> set:
    """Run one load into the month-partitioned table at ``path``; the months whose rows it changed.

    ``months`` defaults to the months of the latest load, or of all unseen loads with ``mode="all_pending"``. A named
    month is replaced by all that the source holds of it, whatever its load time, so it is emptied only if the source
    has none; of other months the source's newer rows are merged. ``files`` names files whose lines are replaced
    instead, by all that the source holds of them. A load may be repeated: the same call leaves the same table. It is
    atomic: a run that fails leaves the table as it was, and one that stops while it swaps directories is finished by
    the next access.

    Months and load time enter the plans as literals: they prune the target's directories and, where the load time is
    that of a file, the source's files. They come from the files that the table keeps beside each month, so no stored
    line outside the changed months is read. An update can match a stored row only inside its own month, because the
    line id covers the time. Stored columns the source lacks stay. ``only_newer=False`` takes every source row, for
    sources that hold nothing but the new lines. ``before`` is called with the changed months when all is staged and
    nothing is changed yet. ``placed`` says that the source's lines lie by month already, as those staged ``by_month``.
    """
    path = path.rstrip("/")
    target = sinks.read_table(spark, path)
    before = before or (lambda _: None)
    if target is None:
        aside = sinks.stage_months(source, path, load_ts, placed)
        arriving = sinks.stored_months(spark, aside)
        before(arriving)
        sinks.take_months(spark, aside, path)
        return arriving
    known = sinks.remember_files(spark, path, load_ts)
    names = None if files is None else files.select(F.col("uri").alias("src_file")).distinct()
    if names is not None:
        others = known.join(names, "src_file", "left_anti")
        lost = months_of(known.join(names, "src_file", "left_semi"))
    else:
        if months is None and mode == ALL_PENDING:
            seen = known.agg(F.unix_micros(F.max("load_ts"))).first()[0]
            months = source if seen is None else source.filter(_newer(load_ts, seen))
        lost = months_of(touched_months(source, load_ts=load_ts) if months is None else months) - {None}
        others = known.filter(~in_months(lost))
    newest = others.agg(F.unix_micros(F.max("load_ts"))).first()[0] if only_newer else None
    if newest is None:
        updates = source
    elif names is None:
        updates = source.filter(_newer(load_ts, newest) | in_months(lost))
        # Which of the older files need not be opened; a file that changed in place has another load time.
        if "src_file" in source.columns and (spared := _not_read_for(known, lost)):
            mark = F.concat("src_file", F.lit("|"), F.unix_micros(F.col(load_ts)).cast("string"))
            updates = updates.filter(_newer(load_ts, newest) | F.coalesce(~mark.isin(spared), F.lit(True)))
    else:
        newer = source.join(names, "src_file", "left_anti").select(*source.columns).filter(_newer(load_ts, newest))
        updates = newer.unionByName(source.join(names, "src_file", "left_semi").select(*source.columns))
    aside = sinks.stage_months(updates, path, load_ts, placed)
    held, arriving = sinks.stored_months(spark, path), sinks.stored_months(spark, aside)
    changed = lost | arriving
    before((held & lost) | arriving)
    # Months that keep stored lines: without files, those that gain lines but were not named.
    mixed = held & (arriving - lost if names is None else changed)
    if not mixed:
        sinks.take_months(spark, aside, path, changed)
    else:
        keep = target.filter(in_months(mixed))
        keep = keep if names is None else keep.join(names, "src_file", "left_anti").select(*target.columns)
        # The staged rows are moved out of the way of the next ones.
        moved = sinks.scratch_path(spark, "updates")
        sinks._move(spark, aside, moved)
        staged = sinks.read_table(spark, moved)
        count = sinks.read_files(spark, moved).agg(F.sum("lines")).first()[0] or 0
        result = merge_by_key(keep, staged, key, count) if key else append_columns(keep, staged)
        try:
            sinks.store_months(result, path, changed, load_ts)
        finally:
            sinks.delete(spark, moved)
    return (held & lost) | arriving


def _newer(load_ts: str, newest: int) -> Column:
    return F.col(load_ts) > F.timestamp_micros(F.lit(newest))
