"""Months, quarters and date ranges of zone-free times."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Dates = tuple[date | None, date | None] | None

MONTH_ID = "month_id"


def month_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "MM")


def quarter_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "quarter")


def month_id(moment: Column) -> Column:
    """Month as the integer yyyymm, the partition value of every ledger table."""
    return (F.year(moment) * 100 + F.month(moment)).cast("int")


def first_day(month: Column) -> Column:
    """First day of a month yyyymm. Lines are grouped by the month number, which the scan takes from the directory
    name, and only the summed rows are turned into dates."""
    return F.make_date(((month - month % 100) / 100).cast("int"), month % 100, F.lit(1))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def in_range_of_months(dates: Dates) -> Column:
    """Months, as yyyymm, that have a day in an inclusive range."""
    start, end = dates or (None, None)
    after = F.col(MONTH_ID) >= start.year * 100 + start.month if start else F.lit(True)
    return after & (F.col(MONTH_ID) <= end.year * 100 + end.month) if end else after


def date_range(df: DataFrame, dates: Dates, column: str = "txn_time") -> DataFrame:
    """Keep rows whose date in ``column`` lies between the two inclusive, optional bounds.

    The bounds compare with the bare column, so they reach the Parquet footer statistics. Where the table also carries
    its month partition, the implied months are added: Spark cannot derive them from the time bound.
    """
    start, end = dates or (None, None)
    has_months = column == "txn_time" and MONTH_ID in df.columns
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
        if has_months:
            df = df.filter(F.col(MONTH_ID) >= start.year * 100 + start.month)
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end + timedelta(days=1)))
        if has_months:
            df = df.filter(F.col(MONTH_ID) <= end.year * 100 + end.month)
    return df
