"""Growth figures and net worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID, Dates, date_range, first_day, in_range_of_months, month_id, month_label
from tallyhouse.functions.money import TOTAL, ZERO, main_amount, or_zero, percent_of, total, total_when
from tallyhouse.operators.lookups import Keys, attach, first_rows, running, side_by_side
from tallyhouse.operators.marts import prepayment, reit_purchase
from tallyhouse.policy import Policy


def _latest_budget(budget: DataFrame, keys: Keys) -> DataFrame:
    """Budget rows of the latest date, even if that date lies ahead."""
    if not keys:
        return budget.filter(F.col("month_start") == budget.agg(F.max("month_start")).scalar())
    latest = budget.groupBy(*keys).agg(F.max("month_start").alias("month_start"))
    return budget.join(latest, [*keys, "month_start"], "left_semi")


def survival_cost(budget: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Latest monthly budget: essential categories only, and everything."""
    return _latest_budget(budget, keys).groupBy(*keys).agg(
        or_zero(total_when(F.col("category").isin(*policy.essential), F.col("budget"))).alias("strict_cost"),
        or_zero(total(F.col("budget"))).alias("life_cost"),
    )


def median_net_income(income: DataFrame, dates: Dates = None, keys: Keys = ()) -> DataFrame:
    """Exact median of monthly net income, from the income summary; zero without months."""
    months = date_range(income, dates, "month_start")
    return months.groupBy(*keys).agg(F.coalesce(F.median("net"), F.lit(0.0)).alias("median_net_income"))


def wealth_rates(
    fact: DataFrame, mortgage: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()
) -> DataFrame:
    """What income went into, in percent: consumption, wealth building, and the cash that stayed.

    Principal, whether voluntary or part of a paid installment, builds wealth and is taken out of consumption.
    """
    savings = F.col("account").isin(*policy.savings_accounts)
    moved = F.when(savings & (F.col("flow") == policy.transfer_in), main_amount()).when(
        savings & (F.col("flow") == policy.transfer_out), -main_amount()
    )
    flows = date_range(fact, dates).groupBy(*keys).agg(
        or_zero(total_when(F.col("flow") == policy.income, main_amount())).alias("income"),
        or_zero(total_when(F.col("flow") == policy.expense, main_amount())).alias("_spent"),
        or_zero(total_when(reit_purchase(policy), main_amount())).alias("_reits"),
        or_zero(total_when((F.col("category") == policy.debt) | prepayment(policy), main_amount())).alias("_voluntary"),
        or_zero(total(F.coalesce(moved, F.lit(ZERO)))).alias("_savings"),
    )
    installments = date_range(mortgage.filter("paid"), dates, "due_date").groupBy(*keys).agg(
        or_zero(total(F.col("principal"))).alias("_principal")
    )
    parts = attach(flows, installments, keys).withColumn("_principal", or_zero(F.col("_principal")))
    in_assets = F.col("_reits") + F.col("_voluntary") + F.col("_principal")
    parts = parts.withColumn("consumption", (F.col("_spent") - in_assets).cast(TOTAL)).withColumn(
        "wealth_building", (in_assets + F.col("_savings")).cast(TOTAL)
    )
    consumed = percent_of(F.col("consumption"), F.col("income"))
    built = percent_of(F.col("wealth_building"), F.col("income"))
    kept = F.when(F.col("income") > 0, F.lit(100) - consumed - built).otherwise(F.lit(ZERO))
    return parts.select(
        *keys,
        "income",
        "consumption",
        "wealth_building",
        consumed.alias("consumption_rate"),
        built.alias("wealth_rate"),
        kept.alias("cash_rate"),
    )


def debt_to_income(
    budget: DataFrame, income: DataFrame, policy: Policy, dates: Dates = None, keys: Keys = ()
) -> DataFrame:
    """Latest budgeted obligatory debt in percent of the median net income; zero unless that is positive."""
    debt = _latest_budget(budget, keys).groupBy(*keys).agg(
        or_zero(total_when(F.col("category") == policy.essential_debt, F.col("budget"))).alias("essential_debt")
    )
    both = side_by_side([debt, median_net_income(income, dates, keys)], keys)
    owed, median = or_zero(F.col("essential_debt")), F.coalesce("median_net_income", F.lit(0.0))
    rate = F.when(median > 0, owed.cast("double") / median * 100).otherwise(F.lit(0.0))
    return both.select(
        *keys,
        owed.alias("essential_debt"),
        median.alias("median_net_income"),
        rate.alias("debt_to_income_pct"),
    )


def growth_kpis(
    fact: DataFrame,
    budget: DataFrame,
    mortgage: DataFrame,
    income: DataFrame,
    policy: Policy,
    dates: Dates = None,
    keys: Keys = (),
) -> DataFrame:
    """All growth figures in one row per ledger, rates to one digit."""
    frames = [
        survival_cost(budget, policy, keys),
        wealth_rates(fact, mortgage, policy, dates, keys).select(
            *keys, "consumption_rate", "wealth_rate", "cash_rate"
        ),
        debt_to_income(budget, income, policy, dates, keys),
    ]
    row = side_by_side(frames, keys)
    return row.select(
        *keys,
        F.lit(policy.emergency_fund).cast(TOTAL).alias("emergency_fund"),
        or_zero(F.col("strict_cost")).alias("strict_cost"),
        or_zero(F.col("life_cost")).alias("life_cost"),
        F.coalesce("median_net_income", F.lit(0.0)).alias("median_net_income"),
        *(F.round(or_zero(F.col(rate)), 1).alias(rate) for rate in ("consumption_rate", "wealth_rate", "cash_rate")),
        or_zero(F.col("essential_debt")).alias("essential_debt"),
        F.round(F.coalesce("debt_to_income_pct", F.lit(0.0)), 1).alias("debt_to_income_pct"),
    )


def month_moves(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """What each month adds to the series that are summed since the first line."""
    savings = F.col("account").isin(*policy.savings_accounts)
    came_in = F.col("flow").isin(policy.income, policy.transfer_in)
    went_out = F.col("flow").isin(policy.expense, policy.transfer_out)
    balance = F.when(F.col("flow") == policy.income, main_amount()).when(F.col("flow") == policy.expense, -main_amount())
    return fact.groupBy(*keys, MONTH_ID).agg(
        or_zero(total_when(reit_purchase(policy), main_amount())).alias("reits"),
        or_zero(
            total(F.when(savings & came_in, main_amount()).when(savings & went_out, -main_amount()).otherwise(F.lit(ZERO)))
        ).alias("savings"),
        or_zero(total(F.coalesce(balance, F.lit(ZERO)))).alias("balance"),
        or_zero(total_when(F.col("category") == policy.passive, main_amount())).alias("passive"),
    )


def net_worth(
    fact: DataFrame, mortgage: DataFrame, policy: Policy, keys: Keys = (), dates: Dates = None, carried: DataFrame | None = None
) -> DataFrame:
    """Monthly equity, REITs, savings, cash, pending debt and net worth, summed since the first line.

    Every series is a running sum over one union of months, so a month without movement carries the last value. The
    series is shown from ``series_start`` on, and for the months of ``dates``; what came before is in the sums. Debt
    starts with the first installment. ``carried``, the ``month_moves`` of all earlier months summed up in one row of a
    month before the range, stands in for their lines.
    """
    nothing = F.lit(ZERO).cast(TOTAL)
    moves = month_moves(fact, policy, keys)
    moves = moves if carried is None else moves.unionByName(carried)
    moves = moves.select(
        *keys, MONTH_ID, F.col("reits").alias("_reits"), F.col("savings").alias("_savings"), F.col("balance").alias("_balance"),
        nothing.alias("_equity"), F.lit(False).alias("_due"),
    )
    dues = (
        mortgage.filter(F.col("due_date") <= F.lit(policy.as_of))
        .groupBy(*keys, month_id(F.col("due_date")).alias(MONTH_ID))
        .agg(
            nothing.alias("_reits"),
            nothing.alias("_savings"),
            nothing.alias("_balance"),
            or_zero(total_when(F.col("paid"), F.col("principal_total"))).alias("_equity"),
            F.lit(True).alias("_due"),
        )
    )
    parts = ("_reits", "_savings", "_balance", "_equity")
    months = (
        moves.unionByName(dues)
        .groupBy(*keys, MONTH_ID)
        .agg(*(total(F.col(name)).alias(name) for name in parts), F.max("_due").alias("_due"))
    )
    since_start = running(keys, MONTH_ID)
    sums = months.select(
        *keys, MONTH_ID, month_label(first_day(F.col(MONTH_ID))).alias("month"),
        *(F.sum(name).over(since_start).cast(TOTAL).alias(name) for name in parts),
        F.max("_due").over(since_start).alias("_mortgaged"),
    )
    loan = mortgage.groupBy(*keys).agg(or_zero(total(F.col("principal_total"))).alias("_loan"))
    sums = attach(sums, loan, keys)
    pending = F.when(F.col("_mortgaged"), F.col("_loan") - F.col("_equity")).otherwise(F.lit(ZERO)).cast(TOTAL)
    return (
        sums.withColumn("_pending", pending)
        .withColumn("_cash", (F.col("_balance") - F.col("_savings")).cast(TOTAL))
        .filter((F.col("month") >= policy.series_start) & in_range_of_months(dates))
        .select(
            *keys, "month",
            F.round("_equity", 2).alias("mortgage_equity"),
            F.round("_reits", 2).alias("reits"),
            F.round("_savings", 2).alias("savings"),
            F.round("_cash", 2).alias("cash"),
            F.round("_pending", 2).alias("pending_debt"),
            F.round(
                F.col("_equity") + F.col("_reits") + F.col("_savings") + F.col("_cash") - F.col("_pending"), 2
            ).alias("net_worth"),
        )
        .orderBy(*keys, "month")
    )


def net_worth_snapshot(series: DataFrame, keys: Keys = ()) -> DataFrame:
    """The last month of the net worth series."""
    return first_rows(series, keys, 1, F.col("month").desc())
