"""Stored states of a ledger against its lines."""

from calendar import monthrange
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook import inputs
from casebook.policy import DEMO
from casebook.queries import staged as fixture_staged
from tallyhouse.functions.calendar import date_range
from tallyhouse.operators import cashflow, matrices, wealth
from tallyhouse.plans import cells
from tallyhouse.plans.warehouse import Warehouse
from tests.rows import fact, line, staged, values
from tests.test_recovery import JULY, JUNE, MAY, NEW, spoil

DAY = st.dates(date(1999, 11, 1), date(2000, 4, 30))


@given(st.none() | DAY, st.none() | DAY)
@settings(deadline=None, max_examples=300)
def test_months_and_days_make_up_the_range(start, end):
    """Every day of the range is in a whole month or in one list of days, and no other day is."""
    whole, edges = cells.by_months((start, end))
    day = date(1999, 9, 1)
    while day < date(2000, 7, 1):
        asked = (start is None or start <= day) and (end is None or day <= end)
        first, last = day.replace(day=1), day.replace(day=monthrange(day.year, day.month)[1])
        inside = whole is not None and (whole[0] is None or whole[0] <= first) and (whole[1] is None or last <= whole[1])
        assert inside + sum(a <= day <= b for a, b in edges) == asked, (start, end, day, whole, edges)
        day += timedelta(days=1)


@pytest.fixture(scope="module")
def house(spark, sf, tmp_path_factory):
    """Two loads: the second issues the last months again."""
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    lines = fixture_staged(spark, sf)
    house.load_lines(inputs.first_batch(lines))
    house.load_lines(inputs.after_second_batch(lines))
    house.load_marts()
    return house


@pytest.mark.parametrize("dates", [None, (date(2000, 11, 1), date(2001, 2, 28)), (date(2000, 11, 7), None), (date(2000, 11, 7), date(2000, 11, 20))])
def test_states_answer_as_lines_do(house, dates):
    lines = house.table("fact_transactions")
    for ask in (
        lambda f: cashflow.cash_flow(f, DEMO, dates),
        lambda f: matrices.habit_matrix(f, DEMO, dates),
        lambda f: matrices.tagged_by_category(f, DEMO, dates),
    ):
        assert ask(house.sums(dates)).collect() == ask(lines).collect()
    for ask in (
        lambda f: cashflow.top_expenses(f, DEMO, dates, n=100),
        lambda f: cashflow.top_income(f, DEMO, dates, "Freelance"),
        lambda f: matrices.tagged_top(f, DEMO, dates),
    ):
        assert ask(house.largest(dates)).collect() == ask(lines).collect()
    assert cashflow.top_expenses(house.largest(dates, 500), DEMO, dates, n=500).count() == cashflow.top_expenses(lines, DEMO, dates, n=500).count()


def test_whole_months_read_no_line(house):
    dates = (date(2000, 1, 1), date(2000, 12, 31))
    for frame in (house.sums(dates), house.largest(dates)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "fact_transactions" not in plan and "PartitionFilters: [isnotnull(month_id" in plan
    files = house.sums((date(2000, 1, 5), date(2000, 12, 31))).inputFiles()
    assert any("/cells/" in file for file in files)


def test_ties_and_nulls_in_the_lists(spark):
    rows = [line(amount=amount, concept=f"c{i}", category=category) for i, (amount, category) in enumerate([("5", "Food"), ("5", "Food"), (None, "Food"), ("7", None), ("5", "Food"), ("1", "Food")])]
    lines = fact(spark, *rows, line(amount="5", concept=None), line(when=JUNE, amount="6"))
    kept = cells.largest_lines(lines, DEMO, n=2)
    for category in (None, "Food"):
        assert cashflow.top_expenses(kept, DEMO, category=category, n=2).collect() == cashflow.top_expenses(lines, DEMO, category=category, n=2).collect()
    assert date_range(cells.as_lines(cells.month_cells(lines)), (date(2001, 5, 1), date(2001, 5, 31))).agg(F.sum("lines")).first()[0] == 7
    assert cells.month_cells(lines.limit(0)).count() == cells.largest_lines(lines.limit(0), DEMO).count() == 0


def test_checks_read_changed_months_only(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    bad = [line(when=MAY), line(when=MAY), line(when=MAY, comment="C/")]
    house.load_lines(staged(spark, *bad, line(when=JUNE, account=None)))
    house.load_marts()
    found = {(row.table, row.check) for row in house.checks().collect()}
    lines = {("stg_transactions", "unique:txn_id"), ("fact_transactions", "unique:txn_id"), ("fact_transactions", "value_for_tag")}
    assert found == lines | {("stg_transactions", "not_null:txn_id")}
    for name in ("stg_transactions", "fact_transactions"):
        spoil(tmp_path / name / "month_id=200105")
    # June comes again whole.
    house.load_lines(staged(spark, line(when=JUNE, loaded=NEW)))
    house.load_marts()
    assert {(row.table, row.check) for row in house.checks().collect()} == lines
    assert values(house.table("cells"), "month_id", "lines") == [(200105, 3), (200106, 1)]


@pytest.mark.parametrize("dates", [None, (None, date(1999, 3, 31)), (date(2000, 11, 7), None), (date(2000, 2, 1), date(2000, 12, 5)), (date(2030, 1, 1), None)])
def test_carried_sums_answer_as_lines_do(house, dates):
    lines, mortgage = house.table("fact_transactions"), house.table("mortgage")
    assert house.net_worth(dates).collect() == wealth.net_worth(lines, mortgage, DEMO, dates=dates).collect()
    assert house.passive_income(dates).collect() == cashflow.passive_income(lines, DEMO, dates=dates).collect()


def test_a_month_issued_again_restates_later_months_only(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    earn = {"flow": DEMO.income, "category": DEMO.passive}
    house.load_lines(staged(spark, *(line(when=when, amount=amount, **earn) for when, amount in ((MAY, "1"), (JUNE, "2"), (JULY, "4")))))
    assert values(house.table("carry"), "month_id", "passive") == [(200105, 1), (200106, 3), (200107, 7)]
    before = {file.name for file in (tmp_path / "carry" / "month_id=200105").glob("*.parquet")}
    assert before
    spoil(tmp_path / "cells" / "month_id=200105")
    house.load_lines(staged(spark, line(when=JUNE, amount="8", loaded=NEW, **earn)))
    assert values(house.table("carry"), "month_id", "passive") == [(200105, 1), (200106, 9), (200107, 13)]
    assert before == {file.name for file in (tmp_path / "carry" / "month_id=200105").glob("*.parquet")}
    # July needs what June carried and no month before.
    for name, month in (("carry", 200105), ("cells", 200106)):
        spoil(tmp_path / name / f"month_id={month}")
    assert values(house.passive_income((date(2001, 7, 3), None)), "month", "amount", "running_amount") == [("2001-07", 4, 13)]
