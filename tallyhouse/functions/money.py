"""Decimal arithmetic and conditional sums."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Twenty integer digits: room for sums over any ledger, and small enough that a quotient keeps its decimals.
TOTAL = "decimal(24,4)"
ZERO = Decimal("0.0000")


def main_amount() -> Column:
    """Amount of a line in the ledger's main currency."""
    return F.col("amount_main")


def total(amount: Column) -> Column:
    return F.sum(amount).cast(TOTAL)


def total_when(condition: Column, amount: Column) -> Column:
    """Sum of ``amount`` where ``condition`` is true; other rows count as zero, so a group is never NULL for them."""
    return total(F.when(condition, amount).otherwise(F.lit(ZERO)))


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(ZERO))


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Rounded quotient, NULL where the denominator is zero."""
    return F.round(F.try_divide(numerator, denominator), digits)


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; zero unless ``whole`` is positive."""
    return F.when(whole > 0, F.try_divide(part * 100, whole)).otherwise(F.lit(ZERO))


def plain_number(amount: Column) -> Column:
    """Decimal as text without trailing zeros: 45.5, 100, 0.125."""
    return F.rtrim(F.rtrim(amount.cast("string"), F.lit("0")), F.lit("."))
