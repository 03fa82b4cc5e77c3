"""The eight marts. Sums are taken per month before anything is joined or ordered, so no step holds a month's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.calendar import MONTH_ID, day_label, first_day, month_id, month_start
from tallyhouse.functions.money import TOTAL, main_amount, plain_number, ratio, total, total_when
from tallyhouse.operators.lookups import BROADCAST_ROWS, Keys, attach, by, first_rows, lookup_join
from tallyhouse.policy import OVER_BUDGET, PREPAYMENT, REIT_PURCHASE, SAVINGS_DEPOSIT, WITHIN_BUDGET, Policy


def hourly_pay(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Per year and month: gross salary, what is taken off it, worked hours and pay per hour."""
    salary = F.col("category") == policy.salary
    lines = fact.filter(
        salary
        | F.col("concept").isin(*policy.pay_concepts)
        | F.col("concept").like(policy.pay_concept_pattern)
    )
    months = lines.groupBy(*keys, MONTH_ID).agg(
        F.max("txn_time").alias("txn_time"),
        F.max("load_ts").alias("load_ts"),
        total_when(salary, main_amount()).alias("gross"),
        total_when(F.col("category") != policy.salary, main_amount()).alias("deductions"),
        total_when(salary, F.col("worked_days")).alias("worked_days"),
    )
    months = months.withColumn("year", F.year(first_day(F.col(MONTH_ID)))).withColumn(
        "month", F.month(first_day(F.col(MONTH_ID)))
    )
    net_days = F.round(F.col("worked_days") * F.lit(policy.effective_day_factor), 2).cast("decimal(20,2)")
    hours = (F.col("net_days") * policy.hours_per_day).cast("decimal(20,2)")
    pay = ratio(F.col("net"), F.nullif(F.col("hours"), F.lit(0)), 2)
    return (
        months.withColumn("net_days", net_days)
        .withColumn("hours", hours)
        .withColumn("net", (F.col("gross") - F.col("deductions")).cast(TOTAL))
        .select(
            *keys, "txn_time", "year", "month", "worked_days", "net_days", "hours", "gross", "deductions", "net",
            pay.cast("decimal(18,2)").alias("pay_per_hour"),
            F.lit(policy.currency).alias("currency"),
            "load_ts",
        )
    )


def life_cost(
    fact: DataFrame, pay: DataFrame, policy: Policy, keys: Keys = (), max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Each expense in hours of work, at its own month's pay, else at the latest month's.

    Hours and rate fall back separately. Without any pay month no line has a price, and none is returned.
    """
    rates = pay.select(*keys, "year", "month", "hours", "pay_per_hour")
    latest = first_rows(rates, keys, 1, F.col("year").desc(), F.col("month").desc()).select(
        *keys,
        F.lit(True).alias("_priced"),
        F.col("hours").alias("_last_hours"),
        F.col("pay_per_hour").alias("_last_pay"),
    )
    months = rates.select(
        *keys, (F.col("year") * 100 + F.col("month")).cast("int").alias(MONTH_ID), "hours", "pay_per_hour"
    )
    lines = fact.filter(F.col("flow") == policy.expense)
    if keys:
        # One price for each month of each ledger, so that the lines are joined once. Lines without a month have one too.
        lines = lines.withColumn("_cell", F.coalesce(F.col(MONTH_ID), F.lit(0)))
        months = months.withColumnRenamed(MONTH_ID, "_cell")
        cells = lines.select(*keys, "_cell").distinct()
        prices = cells.join(months, by(keys, "_cell"), "left").join(latest, list(keys), "left")
        priced = lookup_join(lines, prices, by(keys, "_cell"), F.col("txn_time"), max_rows)
    else:
        return priced_at_latest(life_cost_lines(fact, pay, policy), pay)
    priced = priced.filter("_priced")
    hours = F.coalesce("hours", "_last_hours")
    rate = F.coalesce("pay_per_hour", "_last_pay")
    return priced.select(*keys, *_expense(hours, rate))


def _expense(hours: Column, rate: Column) -> list[Column]:
    return [
        F.col("txn_time"), F.col("txn_id"), F.col(MONTH_ID),
        F.year("txn_time").alias("year"),
        F.month("txn_time").alias("month"),
        *map(F.col, ("account", "category", "subcategory", "concept", "comment", "amount_main")),
        hours.alias("hours_worked"),
        rate.alias("pay_per_hour"),
        ratio(main_amount(), rate, 3).cast(TOTAL).alias("cost_hours"),
        F.col("load_ts"),
    ]


def life_cost_lines(fact: DataFrame, pay: DataFrame, policy: Policy) -> DataFrame:
    """Expenses of one ledger with the hours, rate and cost of their own month; NULL where the month has none.

    This is the part that depends on the line's own month alone, so it is what a load may store.
    """
    months = pay.select((F.col("year") * 100 + F.col("month")).cast("int").alias(MONTH_ID), "hours", "pay_per_hour")
    # One ledger has at most one row per calendar month here.
    lines = fact.filter(F.col("flow") == policy.expense).join(F.broadcast(months), [MONTH_ID], "left")
    return lines.select(*_expense(F.col("hours"), F.col("pay_per_hour")))


def priced_at_latest(lines: DataFrame, pay: DataFrame) -> DataFrame:
    """What ``life_cost_lines`` left without hours or rate, as of the latest month with pay; both fall back apart."""
    rates = pay.select("year", "month", "hours", "pay_per_hour")
    latest = first_rows(rates, (), 1, F.col("year").desc(), F.col("month").desc())
    latest = latest.select(F.lit(True).alias("_priced"), F.col("hours").alias("_hours"), F.col("pay_per_hour").alias("_pay"))
    priced = attach(lines, latest, ()).filter("_priced")
    return priced.select(*_expense(F.coalesce("hours_worked", "_hours"), F.coalesce("pay_per_hour", "_pay")))


def budget_compliance(fact: DataFrame, budget: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Month by category: spend against budget. Spend is summed first, so the join sees a row per cell, not per line.

    Budget rows of one month and category, whatever their case, are added up (``check_unique`` lists them).
    """
    spend = (
        fact.filter(F.col("flow") == policy.expense)
        .groupBy(*keys, MONTH_ID, "category")
        .agg(total(main_amount()).alias("spent"), F.max("load_ts").alias("load_ts"))
        .withColumn("month_start", first_day(F.col(MONTH_ID)))
        .withColumn("load_ts", F.max("load_ts").over(Window.partitionBy(*keys, "month_start")))
        .withColumn("_category", F.upper("category"))
    )
    plan = budget.select(
        *keys,
        month_start(F.col("month_start")).alias("month_start"),
        F.upper("category").alias("_category"),
        F.col("category").alias("_budget_category"),
        "budget",
    )
    plan = plan.groupBy(*keys, "month_start", "_category").agg(
        F.max("_budget_category").alias("_budget_category"),
        F.sum("budget").cast("decimal(18,4)").alias("budget"),
    )
    cells = spend.join(plan, by(keys, "month_start", "_category"), "full").select(
        *keys, "month_start",
        F.coalesce("category", "_budget_category").alias("category"),
        F.coalesce("spent", F.lit(0).cast(TOTAL)).alias("spent"),
        "budget", "load_ts",
    )
    used = ratio(F.col("spent") * 100, F.col("budget"), 3)
    return cells.select(
        *keys,
        F.md5(F.concat(day_label(F.col("month_start")), F.lit(" 00:00:00"), F.col("category"))).alias("month_cat_id"),
        "month_start", "category", "spent", "budget",
        used.alias("used_pct"),
        F.concat(plain_number(used), F.lit("%")).alias("used"),
        F.round(F.col("budget") - F.col("spent"), 2).alias("remaining"),
        F.when(F.col("budget") >= F.col("spent"), WITHIN_BUDGET)
        .when(F.col("budget") < F.col("spent"), OVER_BUDGET)
        .alias("verdict"),
        "load_ts",
    )


def income_summary(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Monthly gross, deductions and net, with the year's median monthly net on each of its months."""
    deducted = F.col("category").isin(*policy.deduction_categories) | F.col("concept").isin(*policy.deduction_concepts)
    months = (
        fact.groupBy(*keys, MONTH_ID)
        .agg(
            total_when(F.col("category").isin(*policy.earned), main_amount()).alias("gross"),
            total_when(deducted, main_amount()).alias("deductions"),
        )
        .withColumn("month_start", first_day(F.col(MONTH_ID)))
        .withColumn("year", F.year("month_start"))
        .withColumn("net", (F.col("gross") - F.col("deductions")).cast(TOTAL))
    )
    year = Window.partitionBy(*keys, "year")
    return months.select(
        *keys, "month_start", "year",
        F.month("month_start").alias("month"),
        "gross", "deductions", "net",
        F.round(F.median("net").over(year), 2).alias("median_net"),
    )


def tagged_share(fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Monthly income without refunds, spend of the tracked subcategory without loans, and their ratio."""
    income = (F.col("category") != policy.refunds) & (F.col("flow") == policy.income)
    tracked = (
        (F.col("flow") == policy.expense)
        & (F.col("category") != policy.loans)
        & (F.col("subcategory") == policy.tracked)
    )
    months = fact.groupBy(*keys, MONTH_ID).agg(
        F.round(total_when(income, main_amount()), 2).alias("income_total"),
        F.round(total_when(tracked, main_amount()), 3).alias("tracked_spend"),
        F.max("load_ts").alias("load_ts"),
    )
    return months.withColumn("month_start", first_day(F.col(MONTH_ID))).select(
        *keys, "month_start",
        F.year("month_start").alias("year"),
        F.month("month_start").alias("month"),
        "income_total", "tracked_spend",
        ratio(F.col("tracked_spend"), F.col("income_total"), 5).alias("tracked_share"),
        "load_ts",
    )


def tag_ledger(fact: DataFrame, tag: str, exclude: tuple[str, ...], keys: Keys = ()) -> DataFrame:
    """Ledger lines of one tag without some categories."""
    return fact.filter((F.col("tag") == tag) & ~F.col("category").isin(*exclude)).select(
        *keys, "txn_id", "month_id", "txn_time", "account", "category", "subcategory", "concept", "amount_main",
        "flow", "comment", "amount_native", "currency", "amount_txn", "fx_rate", "tag", "tag_value", "load_ts",
    )


def investment_plan(
    fact: DataFrame, budget: DataFrame, mortgage: DataFrame, policy: Policy, keys: Keys = ()
) -> DataFrame:
    """Monthly income after taxes, planned living cost and installment, split into three floored shares.

    A month without budget or installment has a NULL plan. Only budget rows dated the first of the month count, and
    the first installment month is the first one starting on or after ``plan_start``.
    """
    due = F.trunc("due_date", "MM")
    installments = mortgage.filter(due.between(policy.plan_start, policy.as_of)).select(
        *keys, due.alias("month_start"), "installment"
    )
    debts = (policy.debt, policy.essential_debt)
    living = budget.groupBy(*keys, "month_start").agg(
        total_when(~F.col("category").isin(*debts), F.col("budget")).alias("_planned")
    )
    living = living.withColumn(
        "living_cost", (F.col("_planned") * F.lit(policy.living_cost_buffer)).cast(TOTAL)
    ).drop("_planned")
    earned = F.col("category").isin(*policy.earned)
    signed = F.when(earned, main_amount()).otherwise(-main_amount())
    income = (
        fact.filter(F.col("category").isin(*policy.earned, *policy.plan_deductions))
        .groupBy(*keys, MONTH_ID)
        .agg(total_when(earned, main_amount()).alias("gross"), total(signed).alias("net"))
        .withColumn("month_start", first_day(F.col(MONTH_ID)))
    )
    after_living = (F.col("net") - F.col("living_cost")).cast(TOTAL)
    available = (F.col("after_living") - F.col("installment")).cast(TOTAL)

    def share(part):
        return F.floor(F.col("available") * F.lit(part)).cast(TOTAL)

    return (
        income.join(installments, by(keys, "month_start"), "left")
        .join(living, by(keys, "month_start"), "left")
        .withColumn("after_living", after_living)
        .withColumn("available", available)
        .select(
            *keys, "month_start", MONTH_ID, "gross", "net", "after_living", "installment", "available",
            share(policy.savings_share).alias("savings_share"),
            share(policy.prepayment_share).alias("prepayment_share"),
            share(policy.reit_share).alias("reit_share"),
        )
    )


def savings_deposit(policy: Policy):
    return F.col("account").isin(*policy.savings_accounts) & (F.col("flow") == policy.transfer_in)


def reit_purchase(policy: Policy):
    return (F.col("category") == policy.investments) & (F.col("subcategory") == policy.reit)


def prepayment(policy: Policy):
    return (
        (F.col("category") == policy.investments)
        & (F.col("subcategory") == policy.property_subcategory)
        & (F.col("concept") == policy.prepayment_concept)
    )


def investment_kind(policy: Policy):
    """Which of the three planned investments a line is, if any."""
    return (
        F.when(savings_deposit(policy), SAVINGS_DEPOSIT)
        .when(reit_purchase(policy), REIT_PURCHASE)
        .when(prepayment(policy), PREPAYMENT)
    )


def investment_tracking(
    fact: DataFrame, plan: DataFrame, policy: Policy, keys: Keys = (), every_day: bool = False
) -> DataFrame:
    """Month-to-date income and investments against the plan: the last day of each month, or every day with lines.

    Lines are summed per day first. What is left to order inside a month is at most its days.
    """
    earned = F.col("category").isin(*policy.earned)
    days = (
        fact.filter(earned | investment_kind(policy).isNotNull())
        .groupBy(*keys, F.to_date("txn_time").alias("date"))
        .agg(
            total_when(earned, main_amount()).alias("gross_to_date"),
            total_when(savings_deposit(policy), main_amount()).alias("savings_invested"),
            total_when(F.col("concept") == policy.reit_plan_concept, main_amount()).alias("reit_invested"),
            total_when(prepayment(policy), main_amount()).alias("prepayment_invested"),
        )
        .withColumn("month_start", F.trunc("date", "MM"))
    )
    sums = ("gross_to_date", "savings_invested", "reit_invested", "prepayment_invested")
    if every_day:
        to_date = Window.partitionBy(*keys, "month_start").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        rows = days.select(
            *keys, "month_start", "date", *(F.sum(name).over(to_date).cast(TOTAL).alias(name) for name in sums)
        )
    else:
        rows = days.groupBy(*keys, "month_start").agg(
            F.max("date").alias("date"), *(total(F.col(name)).alias(name) for name in sums)
        )
    targets = plan.select(
        *keys, "month_start", "after_living", "available",
        F.col("savings_share").alias("savings_allotted"),
        F.col("reit_share").alias("reit_allotted"),
        F.col("prepayment_share").alias("prepayment_allotted"),
    )

    def left_over(name):
        return (F.col(f"{name}_allotted") - F.col(f"{name}_invested")).cast(TOTAL).alias(f"{name}_remaining")

    return rows.join(targets, by(keys, "month_start"), "left").select(
        *keys, "date",
        month_id(F.col("month_start")).alias("month_id"),
        "gross_to_date", "after_living", "available",
        "savings_allotted", "savings_invested",
        "reit_allotted", "reit_invested",
        "prepayment_allotted", "prepayment_invested",
        left_over("savings"), left_over("reit"), left_over("prepayment"),
    )
