"""Joins of many lines with few rows, and the helpers that let every operator serve one or many ledgers.

``keys`` are extra leading columns (say, a ledger owner) that keep ledgers apart inside one table. Without keys a table
is one ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Keys = Sequence[str]

# A lookup is sent to every executor only after it was counted to be at most this long.
BROADCAST_ROWS = 100_000
# A key is hot if it owns more than one in HOT_SHARE lines, so there are always fewer than HOT_SHARE hot keys.
HOT_SHARE = 1_000
SALTS = 1_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows; reads no more than it must to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def hot_keys(lines: DataFrame, on: Keys, share: int = HOT_SHARE) -> DataFrame:
    """The fewer than ``share`` keys that own more than one in ``share`` lines, marked ``_hot``."""
    counts = lines.groupBy(*on).agg(F.count(F.lit(1)).alias("_lines"))
    everything = counts.agg(F.sum("_lines")).scalar()
    return counts.filter(F.col("_lines") * share > everything).select(*on, F.lit(True).alias("_hot"))


def lookup_join(
    lines: DataFrame,
    lookup: DataFrame,
    on: Keys,
    spread: Column,
    max_rows: int = BROADCAST_ROWS,
    share: int = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Left join of lines with a lookup that is unique on ``on``.

    A lookup counted as small is broadcast and the lines stay where they are. A longer one is joined by shuffle. There
    the lines of hot keys, and those without a key, are spread over many tasks by the hash of ``spread``, and only the
    lookup rows of hot keys are copied to all of these. So one key may own any share of the lines. A key is hot from
    one in ``share`` lines on and is spread over ``salts`` tasks.
    """
    on = list(on)
    if is_small(lookup, max_rows):
        return lines.join(F.broadcast(lookup), on, "left")
    hot = F.broadcast(hot_keys(lines, on, share))
    keyless = reduce(or_, (F.col(name).isNull() for name in on))
    spread_out = F.coalesce(F.col("_hot"), F.lit(False)) | keyless
    salt = F.when(spread_out, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(F.lit(0)))
    salted = lines.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    copied = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied, [*on, "_salt"], "left").drop("_salt")


def by(keys: Keys, *columns: str) -> list[str]:
    return [*keys, *columns]


def attach(left: DataFrame, right: DataFrame, keys: Keys, how: str = "left") -> DataFrame:
    """Put the one row per ledger of ``right`` next to the rows of ``left``.

    Without keys that row is one scalar subquery. It is NULL in all columns if ``right`` has no row.
    """
    if keys:
        return left.join(right, list(keys), how)
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def side_by_side(frames: Sequence[DataFrame], keys: Keys) -> DataFrame:
    """Frames of one row per ledger as one row per ledger."""
    return reduce(lambda left, right: attach(left, right, keys, "full"), frames)


def running(keys: Keys, order: str) -> WindowSpec:
    """From the first row of a ledger to the current one; meant for rows already summed per day or month."""
    spec = Window.orderBy(order) if not keys else Window.partitionBy(*keys).orderBy(order)
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_rows(df: DataFrame, keys: Keys, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each ledger. Both forms cut down to ``n`` before rows travel."""
    if not keys:
        return df.orderBy(*order).limit(n)
    spec = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(spec)).filter(F.col("_rank") <= n)
    return ranked.drop("_rank").orderBy(*keys, *order)
