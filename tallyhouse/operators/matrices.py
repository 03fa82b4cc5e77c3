"""Dashboard queries on life cost, habits and the tracked subcategory; most return dense matrices in long form.

Where the columns of a matrix are fixed, each is one conditional sum of the same aggregation: a missing cell is zero by
construction and nothing is joined to fill it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID, Dates, date_range, day_label, first_day, month_label
from tallyhouse.functions.money import TOTAL, ZERO, main_amount, or_zero, percent_of, total, total_when
from tallyhouse.functions.text import text_or
from tallyhouse.operators.lookups import Keys, attach, by, first_rows, side_by_side
from tallyhouse.policy import NO_COMPANION, NO_CONCEPT, Policy


def _dense(lines: DataFrame, group: list[str], cells: Mapping[str, Column], amount: Column, label: str, value: str):
    """One row per group and cell, zero where no line falls into the cell."""
    wide = lines.groupBy(*group).agg(
        *(or_zero(total_when(cell, amount)).alias(f"_{i}") for i, cell in enumerate(cells.values()))
    )
    kept = [_month() if name == MONTH_ID else name for name in group]
    pairs = F.array(
        *(F.struct(F.lit(name).alias(label), F.col(f"_{i}").alias(value)) for i, name in enumerate(cells))
    )
    return wide.select(*kept, F.inline(pairs))


def _month() -> Column:
    return month_label(first_day(F.col(MONTH_ID))).alias("month")


def _tracked(policy: Policy) -> Column:
    return F.coalesce(F.col("subcategory") == policy.tracked, F.lit(False))


def life_cost_kpis(life: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Hours of work in each fixed bucket. The tracked subcategory wins over the category; letter case is ignored."""
    tracked = F.coalesce(F.lower("subcategory") == policy.tracked.lower(), F.lit(False))
    cells = {bucket: ~tracked & (F.lower("category") == category) for bucket, category in policy.life_buckets}
    cells[policy.tracked_bucket] = tracked
    return _dense(date_range(life, dates), list(keys), cells, F.col("cost_hours"), "bucket", "hours")


def life_cost_details(
    life: DataFrame, category: str, policy: Policy, dates: Dates = None, keys: Keys = ()
) -> DataFrame:
    """Lines of one category without the tracked subcategory, or only that subcategory, dearest first."""
    if category == policy.tracked:
        lines = life.filter(F.col("subcategory") == policy.tracked)
    else:
        lines = life.filter((F.col("category") == category) & ~_tracked(policy))
    # The id as second sort key also spreads equal hours over the tasks of the sort.
    return (
        date_range(lines, dates)
        .orderBy(*keys, F.col("cost_hours").desc_nulls_last(), "txn_id")
        .select(
            *keys,
            day_label(F.col("txn_time")).alias("date"),
            *(text_or(F.col(name), "").alias(name) for name in ("category", "subcategory", "concept")),
            *(or_zero(F.col(name)).alias(name) for name in ("amount_main", "cost_hours", "hours_worked")),
            or_zero(F.col("pay_per_hour")).alias("pay_per_hour"),
        )
    )


def life_cost_matrix(life: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Hours by month and fixed category, without the tracked subcategory."""
    lines = date_range(life, dates).filter(F.col("category").isin(*policy.life_categories) & ~_tracked(policy))
    cells = {name: F.col("category") == name for name in policy.life_categories}
    matrix = _dense(lines, by(keys, MONTH_ID), cells, F.col("cost_hours"), "category", "hours")
    return matrix.orderBy(*keys, "month", "category")


def habit_matrix(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Spend by month and habit item, one item split by category.

    That item under any third category fits no cell; such a line only makes its month appear.
    """
    concept, category = F.col("concept"), F.col("category")
    split = concept == policy.habit_split_item
    lines = date_range(fact, dates).filter(
        concept.isin(*policy.habit_items, policy.habit_split_item, policy.habit_split_synonym)
        & category.isin(*policy.habit_categories)
    )
    cells = {name: concept == name for name in policy.habit_items}
    cells[policy.habit_home_label] = (concept == policy.habit_split_synonym) | (
        split & (category == policy.habit_split_home)
    )
    cells[policy.habit_out_label] = split & (category == policy.habit_split_out)
    matrix = _dense(lines, by(keys, MONTH_ID), cells, main_amount(), "item", "amount")
    return matrix.orderBy(*keys, "month", "item")


def tagged_kpis(
    fact: DataFrame, share: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()
) -> DataFrame:
    """Tracked spend gross, refunded and net, and its share of income."""
    lines = date_range(fact, dates).filter(F.col("subcategory") == policy.tracked)
    spend = lines.groupBy(*keys).agg(
        or_zero(total_when(F.col("flow") == policy.expense, main_amount())).alias("_gross"),
        or_zero(total_when(F.col("category") == policy.refunds, main_amount())).alias("_refunds"),
    )
    months = date_range(share, dates, "month_start").groupBy(*keys).agg(
        total(F.col("tracked_spend")).alias("_spend"), total(F.col("income_total")).alias("_income")
    )
    row = side_by_side([spend, months], keys)
    gross, refunds = or_zero(F.col("_gross")), or_zero(F.col("_refunds"))
    return row.select(
        *keys,
        gross.alias("gross_spend"),
        refunds.alias("refunds"),
        (gross - refunds).cast(TOTAL).alias("net_spend"),
        or_zero(percent_of(F.col("_spend"), F.col("_income"))).alias("share_pct"),
    )


def tagged_trend(share: DataFrame, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Tracked spend month by month."""
    rows = date_range(share, dates, "month_start")
    return rows.select(
        *keys,
        month_label(F.col("month_start")).alias("month"),
        or_zero(F.col("tracked_spend")).alias("tracked_spend"),
    ).orderBy(*keys, "month")


def tagged_top(fact: DataFrame, policy: Policy, dates: Dates = None, n: int = 100, keys: Keys = ()) -> DataFrame:
    """The largest tracked expenses without loans and refunds."""
    lines = date_range(fact, dates).filter(
        ~F.col("category").isin(policy.loans, policy.refunds)
        & (F.col("flow") == policy.expense)
        & (F.col("subcategory") == policy.tracked)
    )
    shown = lines.select(
        *keys, "txn_id",
        day_label(F.col("txn_time")).alias("date"),
        text_or(F.col("concept"), NO_CONCEPT).alias("concept"),
        "amount_main",
        text_or(F.col("tag_value"), "").alias("tag_value"),
    )
    top = first_rows(shown, keys, n, F.col("amount_main").desc_nulls_last(), F.col("txn_id"))
    return top.withColumn("amount", or_zero(F.col("amount_main"))).drop("amount_main")


def tagged_by_category(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Tracked spend per category; anything but an expense counts negative, refunds are left out."""
    lines = date_range(fact, dates).filter(
        (F.col("subcategory") == policy.tracked) & (F.col("category") != policy.refunds)
    )
    signed = F.when(F.col("flow") == policy.expense, main_amount()).otherwise(-main_amount())
    sums = lines.groupBy(*keys, "category").agg(or_zero(total(signed)).alias("amount"))
    return sums.orderBy(*keys, F.col("amount").desc(), "category")


def shared_spend(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Signed spend by companion and month, every companion with every month.

    Refunds lower a cell, and a cell of refunds alone is dropped before the matrix is filled. Months are calendar-bound
    per ledger, so a companion carries them as one small map; companions are never paired with each other.
    """
    signed = F.when(F.col("flow") == policy.expense, main_amount()).otherwise(-main_amount())
    spent = F.coalesce(F.col("category") != policy.refunds, F.lit(False))
    companion = text_or(F.col("tag_value"), NO_COMPANION).alias("companion")
    cells = (
        date_range(fact, dates)
        .filter(F.col("tag") == policy.companion_tag)
        .groupBy(*keys, companion, MONTH_ID)
        .agg(or_zero(total(signed)).alias("amount"), F.max(spent).alias("_spent"))
        .filter("_spent")
        .select(*keys, "companion", _month(), "amount")
    )
    rows = cells.groupBy(*keys, "companion").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "amount"))).alias("_amounts")
    )
    months = cells.groupBy(*keys).agg(F.collect_set("month").alias("_months"))
    filled = attach(rows, months, keys).select(*keys, "companion", "_amounts", F.explode("_months").alias("month"))
    amount = F.coalesce(F.try_element_at("_amounts", F.col("month")), F.lit(ZERO)).cast(TOTAL)
    return filled.select(*keys, "month", "companion", amount.alias("amount")).orderBy(*keys, "month", "companion")
