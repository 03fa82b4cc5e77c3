from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casebook import inputs
from casebook.queries import fact as fixture_fact
from tallyhouse.operators import cashflow, checks, marts, matrices, mortgage, wealth
from casebook.policy import DEMO
from tests import rows
from tests.rows import budget, fact, line, values


def salary(when, amount, comment="20 dias trabajados", **more):
    return line(when=when, amount=amount, category="Salary", flow="Income", concept="Salary", comment=comment, **more)


def test_hourly_pay(spark):
    lines = fact(
        spark,
        salary("2001-05-01 00:00:00", "1000"),
        line(when="2001-05-02 00:00:00", amount="100", concept="Income tax", category="Tax"),
        line(when="2001-05-03 00:00:00", amount="50", concept="Commission 3", category="Fees"),
        line(when="2001-05-04 00:00:00", amount="7"),
        salary("2001-06-01 00:00:00", "500", comment=None),
    )
    got = marts.hourly_pay(lines, DEMO).orderBy("month").collect()
    assert [(r.gross, r.deductions, r.net_days, r.hours, r.pay_per_hour) for r in got] == [
        (1000, 150, Decimal("14.46"), Decimal("115.68"), Decimal("7.35")),
        (500, 0, None, None, None),
    ]
    assert checks.check_net_le_gross(marts.hourly_pay(lines, DEMO)).isEmpty()
    refund = fact(spark, salary("2001-05-01 00:00:00", "1"), line(amount="-5", concept="Income tax", category="Tax"))
    assert [r.key for r in checks.check_net_le_gross(marts.hourly_pay(refund, DEMO)).collect()] == ["2001-5"]


def test_life_cost_falls_back_to_the_latest_pay(spark):
    lines = fact(
        spark,
        salary("2001-03-01 00:00:00", "1157"),
        salary("2001-04-01 00:00:00", "100", comment="0 dias trabajados"),
        salary("2001-05-01 00:00:00", "2314"),
        *(line(when=f"2001-0{month}-10 00:00:00", amount="100", concept=str(month)) for month in (2, 3, 4, 5)),
    )
    pay = marts.hourly_pay(lines, DEMO)
    got = values(marts.life_cost(lines, pay, DEMO), "month", "hours_worked", "pay_per_hour")
    hours, low, high = Decimal("115.68"), Decimal("10.00"), Decimal("20.00")
    # The month without days has no rate of its own but keeps its own zero hours.
    assert got == [(2, hours, high), (3, hours, low), (4, Decimal(0), high), (5, hours, high)]
    assert marts.life_cost(lines, pay.limit(0), DEMO).isEmpty()
    by_owner = lines.withColumn("owner", F.lit("a"))
    keyed = marts.life_cost(by_owner, marts.hourly_pay(by_owner, DEMO, ["owner"]), DEMO, ["owner"])
    assert values(keyed, "month", "hours_worked", "pay_per_hour") == got
    none = marts.hourly_pay(by_owner, DEMO, ["owner"]).limit(0)
    assert marts.life_cost(by_owner, none, DEMO, ["owner"]).isEmpty()


def test_budget_compliance(spark):
    lines = fact(
        spark,
        line(amount="10", category="Food"),
        line(amount="5", category="Bills"),
        line(amount="1", category="Travel"),
        line(amount="91", category="Health"),
    )
    plans = budget(
        spark,
        ("2001-05-01", "FOOD", "20"),
        ("2001-05-01", "Travel", "0"),
        ("2001-05-01", "Gifts", "30"),
        ("2001-05-15", "Health", "200"),
    )
    got = {r.category: r for r in marts.budget_compliance(lines, plans, DEMO).collect()}
    assert (got["Food"].used, got["Food"].verdict, got["Food"].remaining) == ("50%", "CUMPLE", 10)
    assert (got["Bills"].budget, got["Bills"].verdict, got["Bills"].used) == (None, None, None)
    assert (got["Travel"].used, got["Travel"].verdict) == (None, "EXCESO")
    assert (got["Gifts"].spent, got["Gifts"].verdict, got["Gifts"].load_ts) == (0, "CUMPLE", None)
    assert (got["Health"].used, got["Health"].month_start) == ("45.5%", date(2001, 5, 1))
    report = {r.category: r for r in cashflow.budget_report(marts.budget_compliance(lines, plans, DEMO)).collect()}
    assert (report["Bills"].used, report["Bills"].verdict) == ("0%", "DESCONOCIDO")


def test_plan_takes_only_budgets_of_the_first(spark):
    lines = fact(spark, salary("2000-05-05 00:00:00", "1000"), salary("2000-06-05 00:00:00", "1000"))
    plans = budget(spark, ("2000-05-01", "Food", "100"), ("2000-06-15", "Food", "100"))
    schedule = rows.mortgage(spark, ("2000-05-15", True, "50", "10", "0"), ("2000-06-15", True, "50", "10", "0"))
    got = marts.investment_plan(lines, plans, schedule, DEMO).orderBy("month_id").collect()
    assert [r.available for r in got] == [Decimal("832.0000"), None]
    assert (got[0].savings_share, got[0].prepayment_share, got[0].reit_share) == (224, 232, 374)


def test_plan_starts_with_the_first_whole_month(spark):
    lines = fact(spark, *(salary(f"1998-{month}-05 00:00:00", "1000") for month in (10, 11)))
    plans = budget(spark, ("1998-10-01", "Food", "1"), ("1998-11-01", "Food", "1"))
    schedule = rows.mortgage(spark, ("1998-10-20", True, "50", "10", "0"), ("1998-11-20", True, "50", "10", "0"))
    got = marts.investment_plan(lines, plans, schedule, DEMO).orderBy("month_id").collect()
    assert [r.installment for r in got] == [None, 50]


def test_net_worth(spark):
    invest = dict(category="Investments", subcategory="REIT", flow="Expense")
    lines = fact(
        spark,
        line(when="2000-01-05 00:00:00", amount="30", **invest),
        line(when="2000-02-05 00:00:00", amount="100", category="Salary", flow="Income"),
        line(when="2000-04-05 00:00:00", amount="40", account="Savings A", flow="Transfer in"),
    )
    schedule = rows.mortgage(
        spark, ("2000-03-15", True, "50", "10", "5"), ("2000-04-15", None, "50", "20", "0"), ("2009-01-15", False, "9", "70", "0")
    )
    policy = replace(DEMO, series_start="2000-02")
    got = wealth.net_worth(lines, schedule, policy).collect()
    assert [(r.month, r.mortgage_equity, r.reits, r.savings, r.cash, r.pending_debt, r.net_worth) for r in got] == [
        ("2000-02", 0, 30, 0, 70, 0, 100),
        ("2000-03", 15, 30, 0, 70, 90, 25),
        ("2000-04", 15, 30, 40, 30, 90, 25),
    ]
    assert wealth.net_worth_snapshot(wealth.net_worth(lines, schedule, policy)).collect()[0].month == "2000-04"


def test_latest_coverage(spark):
    def month(when, passive, spent):
        return [
            line(when=f"{when}-05 00:00:00", amount=passive, category="Passive", flow="Income"),
            line(when=f"{when}-06 00:00:00", amount=spent, category="Food"),
        ]

    both = fact(spark, *month("2001-05", "10", "100"), *month("2001-06", "50", "100"))
    one = fact(spark, *month("2001-06", "50", "100"))
    assert cashflow.latest_coverage(both, DEMO).first()[0] == 10
    assert cashflow.latest_coverage(both, replace(DEMO, as_of=date(2001, 7, 1))).first()[0] == 50
    assert cashflow.latest_coverage(one, DEMO).first()[0] == 50
    assert cashflow.latest_coverage(one.limit(0), DEMO).first()[0] == 0


def test_shared_spend(spark):
    def shared(amount, category="Food", who="Ana", month=5, **more):
        return line(when=f"2001-0{month}-05 00:00:00", amount=amount, category=category, comment=f"C/ {who} x", **more)

    lines = fact(
        spark,
        shared("100"),
        shared("30", "Refunds", flow="Income"),
        shared("8", "Refunds", who="Bo", flow="Income"),
        shared("5", who="Bo", month=6),
        line(when="2001-06-01 00:00:00", amount="2", comment="C/"),
    )
    assert values(matrices.shared_spend(lines, DEMO), "month", "companion", "amount") == [
        ("2001-05", "Ana", 70), ("2001-05", "Bo", 0), ("2001-05", "Sin asignar", 0),
        ("2001-06", "Ana", 0), ("2001-06", "Bo", 5), ("2001-06", "Sin asignar", 2),
    ]


def test_habits_outside_the_matrix_leave_their_month(spark):
    lines = fact(
        spark,
        line(when="2001-05-01 00:00:00", concept="Coffee", category="Gifts"),
        line(when="2001-06-01 00:00:00", concept="Instant coffee", category="Gifts", amount="3"),
    )
    got = {(r.month, r.item): r.amount for r in matrices.habit_matrix(lines, DEMO).collect()}
    assert len(got) == 14 and sum(got.values()) == 3 and got["2001-06", "Coffee (Food)"] == 3


def test_missing_texts_and_amounts(spark):
    lines = fact(spark, line(concept="", amount=None), line(concept=None, amount="9"), line(amount="3"))
    top = cashflow.top_expenses(lines, DEMO).collect()
    assert [(r.description, r.amount) for r in top] == [("Lunch", 3), ("Sin concepto", 0)]
    assert cashflow.last_update(lines.limit(0)).first()[0] == "Desconocida"


def test_unpaid_status_counts_as_pending(spark):
    schedule = rows.mortgage(spark, ("2000-03-15", True, "50", "10", "5"), ("2000-04-15", None, "50", "20", "0"))
    assert mortgage.mortgage_equity(schedule).first().asDict() == {"paid": 15, "pending": 20, "total": 35}
    assert mortgage.mortgage_prepayments(schedule).count() == 1


def test_empty_ledger_gives_zero_kpis(spark):
    nothing = fact(spark, line()).limit(0)
    kpis = wealth.growth_kpis(
        nothing, budget(spark, ("2000-01-01", "Food", "1")).limit(0), rows.mortgage(spark, ("2000-03-15", True, "1", "1", "1")).limit(0),
        marts.income_summary(nothing, DEMO), DEMO,
    ).first()
    assert {float(value) for name, value in kpis.asDict().items() if name != "emergency_fund"} == {0.0}


def test_checks(spark):
    lines = fact(spark, line(), line(), line(amount="400"), line(category=None))
    assert [r.detail for r in checks.check_unique(lines, "txn_id").collect()] == ["2"]
    assert checks.check_not_null(lines, "txn_id").count() == 1
    assert checks.check_range(lines, "amount_main", 20, 300).count() == 4
    as_of = datetime(2001, 5, 12)
    assert checks.check_freshness(lines, "txn_time", as_of, timedelta(days=1), timedelta(days=3)).first().detail == "warn"
    assert checks.check_freshness(lines, "txn_time", as_of, error_after=timedelta(days=3)).isEmpty()
    assert checks.check_freshness(lines.limit(0), "txn_time", as_of, timedelta(days=1)).first().detail == "warn"
    for limit in (10, 0):
        unknown = checks.check_relationship(lines.withColumn("tag", F.lit("Zz/")), "tag", inputs.keys(spark), "tag", limit)
        assert values(unknown, "key", "detail") == [("Zz/", "4")]


OWNER = ["owner"]


@pytest.mark.parametrize(
    "build",
    [
        lambda f, b, m, k: marts.hourly_pay(f, DEMO, k),
        lambda f, b, m, k: marts.life_cost(f, marts.hourly_pay(f, DEMO, k), DEMO, k),
        lambda f, b, m, k: marts.budget_compliance(f, b, DEMO, k),
        lambda f, b, m, k: marts.income_summary(f, DEMO, k),
        lambda f, b, m, k: marts.tagged_share(f, DEMO, k),
        lambda f, b, m, k: marts.tag_ledger(f, "Inm/", DEMO.property_hidden_categories, k),
        lambda f, b, m, k: marts.investment_tracking(f, marts.investment_plan(f, b, m, DEMO, k), DEMO, k),
        lambda f, b, m, k: cashflow.cash_flow(f, DEMO, keys=k),
        lambda f, b, m, k: cashflow.top_income(f, DEMO, n=3, keys=k),
        lambda f, b, m, k: cashflow.passive_income(f, DEMO, k),
        lambda f, b, m, k: cashflow.financial_freedom(f, DEMO, keys=k),
        lambda f, b, m, k: cashflow.latest_coverage(f, DEMO, k),
        lambda f, b, m, k: wealth.growth_kpis(f, b, m, marts.income_summary(f, DEMO, k), DEMO, keys=k),
        lambda f, b, m, k: wealth.net_worth(f, m, DEMO, k),
        lambda f, b, m, k: wealth.net_worth_snapshot(wealth.net_worth(f, m, DEMO, k), k),
        lambda f, b, m, k: mortgage.mortgage_kpis(m, f, DEMO, k),
        lambda f, b, m, k: mortgage.mortgage_equity(m, k),
        lambda f, b, m, k: matrices.life_cost_kpis(
            marts.life_cost(f, marts.hourly_pay(f, DEMO, k), DEMO, k), DEMO, keys=k
        ),
        lambda f, b, m, k: matrices.habit_matrix(f, DEMO, keys=k),
        lambda f, b, m, k: matrices.tagged_kpis(f, marts.tagged_share(f, DEMO, k), DEMO, keys=k),
        lambda f, b, m, k: matrices.shared_spend(f, DEMO, keys=k),
    ],
    ids=lambda build: "-".join(build.__code__.co_names[1::2][:2]),
)
def test_many_ledgers_equal_each_ledger_alone(spark, sf, build):
    """One job over several owners gives what a job per owner gives."""
    lines, plans, schedule = fixture_fact(spark, sf), inputs.budget(spark, sf), inputs.mortgage(spark, sf)
    owners = ["Card", "Checking"]
    many = lines.filter(F.col("account").isin(owners)).withColumn("owner", F.col("account"))
    each = F.explode(F.array(*map(F.lit, owners)))
    copies = [df.withColumn("owner", each) for df in (plans, schedule)]
    together = build(many, *copies, OWNER)
    for owner in owners:
        alone = build(many.filter(F.col("owner") == owner).drop("owner"), plans, schedule, ())
        mine = together.filter(F.col("owner") == owner).select(*alone.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, alone.collect()))


def test_dates_prune_months_below_the_marts(spark, sf):
    """A date range on a monthly view reaches the month directories through its aggregation."""
    lines, dates = fixture_fact(spark, sf), (date(2000, 1, 1), date(2000, 12, 31))
    views = (
        cashflow.net_income_series(marts.income_summary(lines, DEMO), dates),
        matrices.tagged_trend(marts.tagged_share(lines, DEMO), dates),
        cashflow.cash_flow(lines, DEMO, dates),
    )
    for view in views:
        scan = next(text for text in view._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in text)
        assert "PartitionFilters: []" not in scan and "month_id" in scan.split("PartitionFilters")[1]


def test_sums_are_partial_and_joins_are_no_products(spark, sf):
    lines, plans, schedule = fixture_fact(spark, sf), inputs.budget(spark, sf), inputs.mortgage(spark, sf)
    income = marts.income_summary(lines, DEMO)
    frames = (
        marts.life_cost(lines, marts.hourly_pay(lines, DEMO), DEMO),
        marts.budget_compliance(lines, plans, DEMO),
        marts.investment_tracking(lines, marts.investment_plan(lines, plans, schedule, DEMO), DEMO),
        wealth.growth_kpis(lines, plans, schedule, income, DEMO),
        wealth.net_worth(lines, schedule, DEMO),
        matrices.shared_spend(lines, DEMO),
        matrices.tagged_kpis(lines, marts.tagged_share(lines, DEMO), DEMO),
    )
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "partial_sum" in plan
