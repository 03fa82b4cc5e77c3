"""Dashboard queries on the money lines: flow of cash, spend and income, coverage by passive income."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.calendar import (
    MONTH_ID,
    Dates,
    date_range,
    day_label,
    first_day,
    in_range_of_months,
    month_label,
    quarter_start,
)
from tallyhouse.functions.money import TOTAL, main_amount, or_zero, percent_of, total, total_when
from tallyhouse.functions.text import like_any, text_or
from tallyhouse.operators.lookups import Keys, first_rows, running
from tallyhouse.policy import NO_CATEGORY, NO_CONCEPT, NO_PERCENT, NO_VERDICT, UNKNOWN_UPDATE, Policy


def last_update(fact: DataFrame, keys: Keys = ()) -> DataFrame:
    """Latest load time as text in UTC form, or the stand-in for an empty ledger."""
    latest = F.max("load_ts")
    micros = F.date_format(latest, ".SSSSSS")
    shown = F.concat(
        F.date_format(latest, "yyyy-MM-dd HH:mm:ss"),
        F.when(micros != ".000000", micros).otherwise(F.lit("")),
        F.date_format(latest, "xxx"),
    )
    return fact.groupBy(*keys).agg(F.coalesce(shown, F.lit(UNKNOWN_UPDATE)).alias("last_update"))


def cash_flow(
    fact: DataFrame, policy: Policy, dates: Dates = None, grain: str = "month", keys: Keys = ()
) -> DataFrame:
    """Income, spend as negative numbers, balance and running balance per day or month."""
    if grain not in ("day", "month"):
        raise ValueError(f"grain must be 'day' or 'month', not {grain!r}")
    by_day = grain == "day"
    group = F.to_date("txn_time").alias("_period") if by_day else F.col(MONTH_ID).alias("_period")
    period = F.col("_period") if by_day else first_day(F.col("_period"))
    income, expense = F.col("flow") == policy.income, F.col("flow") == policy.expense
    periods = date_range(fact, dates).groupBy(*keys, group).agg(
        or_zero(total_when(income, main_amount())).alias("income"),
        or_zero(total_when(expense, -main_amount())).alias("expenses"),
    )
    periods = periods.select(*keys, day_label(period).alias("period"), "income", "expenses")
    return (
        periods.withColumn("balance", (F.col("income") + F.col("expenses")).cast(TOTAL))
        .withColumn("running_balance", F.sum("balance").over(running(keys, "period")).cast(TOTAL))
        .orderBy(*keys, "period")
    )


def _month() -> Column:
    return month_label(first_day(F.col(MONTH_ID))).alias("month")


def _by_category(lines: DataFrame, amount: Column, keys: Keys) -> DataFrame:
    sums = lines.groupBy(*keys, "category").agg(or_zero(total(amount)).alias("amount"))
    return sums.orderBy(*keys, F.col("amount").desc(), "category")


def spend_by_category(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Expenses per reported category. Lines without a concept are left out together with the hidden concepts."""
    lines = date_range(fact, dates).filter(
        (F.col("flow") == policy.expense)
        & ~F.col("concept").isin(*policy.report_hidden_concepts)
        & F.col("category").isin(*policy.report_categories)
    )
    return _by_category(lines, main_amount(), keys)


def income_by_category(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Income per category without refunds."""
    lines = date_range(fact, dates).filter(
        (F.col("flow") == policy.income) & ~F.col("category").isin(policy.refunds)
    )
    return _by_category(lines, main_amount(), keys)


def quarter_balance(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Signed balance per quarter; a flow that does not match a positive pattern counts negative, as does none."""
    signed = F.when(like_any(F.lower("flow"), policy.positive_patterns), main_amount()).otherwise(-main_amount())
    months = date_range(fact, dates).groupBy(*keys, MONTH_ID).agg(total(signed).alias("_balance"))
    quarter = day_label(quarter_start(first_day(F.col(MONTH_ID)))).alias("quarter")
    quarters = months.groupBy(*keys, quarter).agg(or_zero(total(F.col("_balance"))).alias("balance"))
    return quarters.orderBy(*keys, "quarter")


def _largest(lines: DataFrame, n: int, keys: Keys) -> DataFrame:
    """Top lines by amount. The line id decides ties, so a rerun returns the same lines."""
    shown = lines.select(
        *keys, "txn_id",
        day_label(F.col("txn_time")).alias("date"),
        text_or(F.col("category"), NO_CATEGORY).alias("category"),
        text_or(F.col("concept"), NO_CONCEPT).alias("description"),
        "amount_main",
    )
    top = first_rows(shown, keys, n, F.col("amount_main").desc_nulls_last(), F.col("txn_id"))
    return top.withColumn("amount", or_zero(F.col("amount_main"))).drop("amount_main")


def top_expenses(
    fact: DataFrame,
    policy: Policy,
    dates: Dates = None,
    category: str | None = None,
    n: int = 10,
    keys: Keys = (),
) -> DataFrame:
    """The ``n`` largest expenses without payroll deductions; lines without a concept are left out."""
    lines = date_range(fact, dates).filter(
        (F.col("flow") == policy.expense)
        & ~F.lower("concept").isin(*policy.top_expense_hidden_concepts)
    )
    if category:
        lines = lines.filter(F.col("category") == category)
    return _largest(lines, n, keys)


def top_income(
    fact: DataFrame,
    policy: Policy,
    dates: Dates = None,
    category: str | None = None,
    n: int = 10,
    keys: Keys = (),
) -> DataFrame:
    """The ``n`` largest incomes outside the hidden categories."""
    lines = date_range(fact, dates).filter(
        (F.col("flow") == policy.income)
        & ~F.lower("category").isin(*policy.top_income_hidden_categories)
    )
    if category:
        lines = lines.filter(F.col("category") == category)
    return _largest(lines, n, keys)


def budget_report(
    compliance: DataFrame,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
    keys: Keys = (),
) -> DataFrame:
    """Budget compliance of the chosen years, months and categories, with stand-ins for what is missing."""
    rows = compliance
    if years:
        rows = rows.filter(F.year("month_start").isin(*years))
    if months:
        rows = rows.filter(F.month("month_start").isin(*months))
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    return rows.select(
        *keys,
        day_label(F.col("month_start")).alias("date"),
        "category",
        or_zero(F.col("spent")).alias("spent"),
        or_zero(F.col("budget")).alias("budget"),
        F.coalesce("used", F.lit(NO_PERCENT)).alias("used"),
        or_zero(F.col("remaining")).alias("remaining"),
        F.coalesce("verdict", F.lit(NO_VERDICT)).alias("verdict"),
    ).orderBy(*keys, "date", "category")


def essential_split(fact: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Monthly essential and discretionary spend without investments and voluntary debt payments."""
    essential = F.col("category").isin(*policy.essential)
    months = (
        date_range(fact, dates)
        .filter((F.col("flow") == policy.expense) & ~F.col("category").isin(policy.investments, policy.debt))
        .groupBy(*keys, MONTH_ID)
        .agg(
            or_zero(total_when(essential, main_amount())).alias("_essential"),
            or_zero(total_when(~essential, main_amount())).alias("_other"),
        )
    )
    whole = (F.col("_essential") + F.col("_other")).cast(TOTAL)
    return months.select(
        *keys, _month(),
        F.round("_essential", 2).alias("essential"),
        F.round("_other", 2).alias("discretionary"),
        F.round(percent_of(F.col("_essential"), whole), 1).alias("essential_pct"),
    ).orderBy(*keys, "month")


def net_income_series(income: DataFrame, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Net income month by month, from the income summary."""
    rows = date_range(income, dates, "month_start")
    return rows.select(
        *keys, month_label(F.col("month_start")).alias("month"), or_zero(F.col("net")).alias("net")
    ).orderBy(*keys, "month")


def passive_income(fact: DataFrame, policy: Policy, keys: Keys = (), dates: Dates = None, carried: DataFrame | None = None) -> DataFrame:
    """Passive income per month, of the months of ``dates``, and since the beginning.

    ``carried`` stands in for the lines before the range, as in ``wealth.net_worth``.
    """
    months = (
        fact.filter(F.col("category") == policy.passive)
        .groupBy(*keys, MONTH_ID)
        .agg(or_zero(total(main_amount())).alias("amount"))
    )
    if carried is not None:
        months = months.unionByName(carried.select(*keys, MONTH_ID, F.col("passive").alias("amount")))
    to_date = F.sum("amount").over(running(keys, MONTH_ID)).cast(TOTAL)
    shown = months.withColumn("running_amount", to_date).filter(in_range_of_months(dates))
    return shown.select(*keys, _month(), "amount", "running_amount").orderBy(*keys, "month")


def coverage_by_month(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Passive income in percent of indispensable spend, every month that has either."""
    passive = F.col("category") == policy.passive
    indispensable = F.col("category").isin(*policy.indispensable) & (F.col("flow") == policy.expense)
    months = (
        fact.filter((passive | indispensable) & F.col(MONTH_ID).isNotNull())
        .groupBy(*keys, MONTH_ID)
        .agg(
            or_zero(total_when(passive, main_amount())).alias("passive"),
            or_zero(total_when(indispensable, main_amount())).alias("indispensable"),
        )
    )
    coverage = F.round(percent_of(F.col("passive"), F.col("indispensable")), 1)
    return months.select(*keys, _month(), "passive", "indispensable", coverage.alias("coverage_pct"))


def financial_freedom(fact: DataFrame, policy: Policy, months: int = 12, keys: Keys = ()) -> DataFrame:
    """Coverage of the last twelve months that have passive income or indispensable spend."""
    latest = first_rows(coverage_by_month(fact, policy, keys), keys, months, F.col("month").desc())
    return latest.orderBy(*keys, "month")


def latest_coverage(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Coverage of the last month, or of the one before while the last is the still open current month."""
    by_age = Window.orderBy(F.col("month").desc())
    if keys:
        by_age = Window.partitionBy(*keys).orderBy(F.col("month").desc())
    rows = coverage_by_month(fact, policy, keys).withColumn("_age", F.row_number().over(by_age)).filter("_age <= 2")
    last, before = (F.max(F.when(F.col("_age") == age, F.col("coverage_pct"))) for age in (1, 2))
    last_month = F.max(F.when(F.col("_age") == 1, F.col("month")))
    current = f"{policy.as_of:%Y-%m}"
    shown = F.when((last_month == current) & before.isNotNull(), before).otherwise(last)
    return rows.groupBy(*keys).agg(or_zero(shown).alias("latest_coverage_pct"))
