"""Data checks. Each returns the offending rows as (check, key, detail): an empty result is a pass.

``keys`` are extra leading columns of checks on lines; with the month among them a load can check the months it changes
and keep what was found in the others.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import says_worked_days
from tallyhouse.operators.lookups import BROADCAST_ROWS, Keys, is_small


def _offenders(rows: DataFrame, check: str, key: Column, detail: Column, keys: Keys = ()) -> DataFrame:
    return rows.select(
        *keys, F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def repeated_prints(df: DataFrame, *columns: str, keys: Keys = ()) -> DataFrame:
    """Hashes that more than one row has. Every value that occurs more than once is among them, in ``df`` and in any part
    of its rows; only the hashes travel, not the values."""
    prints = df.dropna(subset=list(columns)).groupBy(F.xxhash64(*keys, *columns).alias("_print"))
    return prints.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_print")


def check_unique(
    df: DataFrame, *columns: str, keys: Keys = (), prints: DataFrame | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Values that occur more than once, with their count. NULL is the business of ``check_not_null``.

    ``prints`` is a stored table of ``repeated_prints`` of these rows or of more: values that are not among them are
    left where they are.
    """
    named = df.select(*keys, *columns).dropna(subset=list(columns))
    if prints is not None:
        suspects = F.broadcast(prints) if is_small(prints, max_rows) else prints
        named = named.withColumn("_print", F.xxhash64(*keys, *columns)).join(suspects, "_print", "left_semi")
    counts = named.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _offenders(counts, f"unique:{','.join(columns)}", F.concat_ws("|", *columns), F.col("_n"), keys)


def check_not_null(df: DataFrame, column: str, show: str | None = None, keys: Keys = ()) -> DataFrame:
    """Rows without a value; ``show`` names a column that helps to find them."""
    detail = F.col(show) if show else F.lit(None)
    return _offenders(df.filter(F.col(column).isNull()), f"not_null:{column}", F.col(column), detail, keys)


def check_relationship(
    df: DataFrame, column: str, reference: DataFrame, reference_column: str, max_rows: int = BROADCAST_ROWS, keys: Keys = ()
) -> DataFrame:
    """Values that the reference column does not hold, with their count.

    Values are counted before the join, so a value carried by most rows is one row there.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = reference.select(F.col(reference_column).alias("_value")).distinct()
    if is_small(known, max_rows):
        known = F.broadcast(known)
    missing = values.join(known, "_value", "left_anti")
    return _offenders(missing, f"relationship:{column}", F.col("_value"), F.col("_n"), keys)


def check_net_le_gross(pay: DataFrame) -> DataFrame:
    """Pay months whose net exceeds the gross."""
    key = F.concat_ws("-", "year", "month")
    return _offenders(pay.filter(F.col("net") > F.col("gross")), "net_le_gross", key, F.col("net"))


def check_value_for_tag(fact: DataFrame, keys: Keys = ()) -> DataFrame:
    """Tagged lines without a tag value."""
    bad = fact.filter(F.col("tag").isNotNull() & F.col("tag_value").isNull())
    return _offenders(bad, "value_for_tag", F.col("txn_id"), F.col("tag"), keys)


def check_worked_days(fact: DataFrame, keys: Keys = ()) -> DataFrame:
    """Worked-days comments that do not start with a number."""
    bad = fact.filter(says_worked_days(F.col("comment")) & F.col("worked_days").isNull())
    return _offenders(bad, "worked_days", F.col("txn_id"), F.col("comment"), keys)


def check_readable(feed: DataFrame) -> DataFrame:
    """Exported lines that could not be read whole, or that name no time, with the line or what was read of it."""
    # An expression the reader cannot evaluate early: it would ask for the line before it has failed to parse it.
    unread = F.coalesce("bad_line", F.lit("")) != ""
    bad = feed.filter(unread | F.col("occurred_at").isNull())
    # All columns are shown, since the reader only tries those that are asked for.
    shown = F.coalesce("bad_line", F.to_json(F.struct(*feed.columns)))
    return _offenders(bad, "readable", F.col("src_file"), shown)


def check_freshness(
    df: DataFrame,
    column: str,
    as_of: datetime,
    warn_after: timedelta | None = None,
    error_after: timedelta | None = None,
) -> DataFrame:
    """One row if the newest time in ``column`` is too old at ``as_of``; an empty table is infinitely old."""
    newest = df.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("_newest"))

    def older_than(age: timedelta | None) -> Column:
        if age is None:
            return F.lit(False)
        limit = F.lit(as_of - age).cast("timestamp_ntz")
        return F.col("_newest").isNull() | (F.col("_newest") < limit)

    status = F.when(older_than(error_after), "error").when(older_than(warn_after), "warn")
    stale = newest.withColumn("_status", status).filter(F.col("_status").isNotNull())
    key = F.date_format("_newest", "yyyy-MM-dd HH:mm:ss")
    return _offenders(stale, f"freshness:{column}", key, F.col("_status"))


def check_range(df: DataFrame, column: str, low=None, high=None, show: str | None = None) -> DataFrame:
    """Values outside the inclusive bounds; NULL is not out of range."""
    value = F.col(column)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < F.lit(low))
    if high is not None:
        outside = outside | (value > F.lit(high))
    key = F.col(show) if show else F.lit(None)
    return _offenders(df.filter(outside), f"range:{column}", key, value)
