"""Stored states of a ledger that answer for whole months: sums of every cell, and the largest lines.

Both are replaced month by month with the lines they come from, so a load maintains them at the cost of the months it
changes. Both have the columns that the operators ask of money lines and are passed to them in the lines' place; bounds
inside a month are served by the lines of that month.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.calendar import MONTH_ID, Dates, date_range, first_day
from tallyhouse.functions.money import TOTAL, main_amount, total
from tallyhouse.operators.lookups import Keys, running
from tallyhouse.policy import Policy

# What the sums are kept apart by; every condition on money lines that the dashboard sums under is one on these.
CELL = (MONTH_ID, "account", "flow", "category", "subcategory", "concept")
# So many lines of a cell are kept, and so many can be asked for.
LARGEST = 100


def month_cells(fact: DataFrame, keys: Keys = ()) -> DataFrame:
    """Sum of the amounts, number of lines and newest load time of each cell of each month of each ledger."""
    amount = total(main_amount()).alias("amount_main")
    return fact.groupBy(*keys, *CELL).agg(amount, F.count(F.lit(1)).alias("lines"), F.max("load_ts").alias("load_ts"))


def as_lines(cells: DataFrame) -> DataFrame:
    """A cell in the place of its lines, at the first day of its month."""
    return cells.withColumn("txn_time", first_day(F.col(MONTH_ID)).cast("timestamp_ntz"))


def _classes(policy: Policy) -> list[Column]:
    """What a list of largest lines may be asked under, besides flow and category."""
    hidden = F.lower("concept").isin(*policy.top_expense_hidden_concepts)
    return [hidden.alias("_hidden"), (F.col("subcategory") == policy.tracked).alias("_tracked")]


def largest_lines(fact: DataFrame, policy: Policy, n: int = LARGEST, keys: Keys = ()) -> DataFrame:
    """The ``n`` largest lines of each month, flow, category and class of each ledger, ties to the smaller id.

    Whatever is in the first ``n`` under a condition on these is in the first ``n`` of its own cell, so the largest
    lines of any months are those of the union of their lists.
    """
    cell = Window.partitionBy(*keys, MONTH_ID, "flow", "category", *_classes(policy))
    rank = F.row_number().over(cell.orderBy(F.col("amount_main").desc_nulls_last(), "txn_id"))
    return fact.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def running_sums(moves: DataFrame, carried: DataFrame | None) -> DataFrame:
    """Sums of all moves up to the end of each month; ``carried`` has those of the newest month before."""
    names = [name for name in moves.columns if name != MONTH_ID]
    months = moves if carried is None else moves.unionByName(carried.select(*moves.columns))
    return months.select(*(F.sum(name).over(running((), MONTH_ID)).cast(TOTAL).alias(name) for name in names), MONTH_ID)


def by_months(dates: Dates) -> tuple[Dates, list[tuple[date, date]]]:
    """Whole months of an inclusive range, None if there is none, and the days before and after them."""
    start, end = dates or (None, None)
    edges = []
    if start is not None and start.day > 1:
        last = start.replace(day=monthrange(start.year, start.month)[1])
        edges.append((start, last if end is None else min(last, end)))
        start = last + timedelta(days=1)
    if end is not None and (end + timedelta(days=1)).day > 1 and (start is None or end >= start):
        edges.append((max(end.replace(day=1), start) if start else end.replace(day=1), end))
        end = end.replace(day=1) - timedelta(days=1)
    return (None if start and end and start > end else (start, end)), edges


def routed(state: DataFrame, lines: DataFrame, dates: Dates) -> DataFrame:
    """Rows for the dates: of the stored state for whole months, of the lines for days at the ends of the range."""
    whole, edges = by_months(dates)
    parts = [date_range(state, whole)] if whole is not None else []
    parts += [date_range(lines, edge) for edge in edges]
    names = [name for name in state.columns if name in lines.columns]
    return reduce(DataFrame.unionByName, (part.select(*names) for part in parts))
