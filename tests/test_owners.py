"""Loads of many ledgers into one table."""

from datetime import date
from decimal import Decimal
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from casebook import inputs
from casebook.policy import DEMO
from tallyhouse.operators import cashflow
from tallyhouse.plans import owners
from tallyhouse.plans.owners import LedgerHouse, load_owner_months, touched_owner_months
from tallyhouse.sources import ledgers, sinks
from tests.rows import line, staged, values

MAY, JUNE = "2001-05-10 08:00:00", "2001-06-10 08:00:00"


def lines(spark, *rows):
    """Staged lines of (owner, moment, concept, loaded)."""
    return staged(spark, *(line(when=when, concept=concept, loaded=loaded, currency=owner) for owner, when, concept, loaded in rows)).withColumn("owner", F.col("currency"))


def months(spark, *pairs):
    return spark.createDataFrame(list(pairs), "owner string, month_id int")


def held(spark, path):
    return values(sinks.read_table(spark, path), "owner", "month_id", "concept")


FIRST = [("a", MAY, "old", "2002-01-01"), ("a", JUNE, "old", "2002-01-01"), ("b", MAY, "old", "2002-01-01"), (None, MAY, "old", "2002-01-01")]


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("max_rows", [100, 0])
def test_one_owner_issues_a_month_again(spark, tmp_path, buckets, max_rows):
    """The month of the other owners survives, also where all share a directory; a repeated load changes nothing."""
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, *FIRST), "owner", buckets=buckets)
    again = lines(spark, ("a", MAY, "new", "2002-02-01"), ("a", MAY, "newer", "2002-02-01"))
    for _ in range(2):
        changed = load_owner_months(spark, path, again, "owner", months(spark, ("a", 200105)), max_rows=max_rows)
        assert len(changed) == 1
        assert held(spark, path) == sorted(
            [("a", 200105, "new"), ("a", 200105, "newer"), ("a", 200106, "old"), ("b", 200105, "old"), (None, 200105, "old")], key=str
        )


def test_each_owner_has_a_load_time(spark, tmp_path):
    """Rows outside the named months count if they are newer than what the table holds of their owner."""
    path = str(tmp_path / "stg")
    first = [("a", MAY, "old", "2002-03-01"), ("b", MAY, "old", "2002-01-01")]
    load_owner_months(spark, path, lines(spark, *first), "owner", buckets=3)
    later = [("a", JUNE, "late", "2002-02-01"), ("b", JUNE, "late", "2002-02-01"), ("c", JUNE, "first", "2001-01-01")]
    load_owner_months(spark, path, lines(spark, *later), "owner", months(spark))
    assert held(spark, path) == [("a", 200105, "old"), ("b", 200105, "old"), ("b", 200106, "late"), ("c", 200106, "first")]


def test_merge_is_within_an_owner(spark, tmp_path):
    """Equal lines of two owners have equal ids and stay two lines; a newer line replaces that of its owner only."""
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, ("a", MAY, "same", "2002-01-01"), ("b", MAY, "same", "2002-01-01")), "owner", buckets=1)
    load_owner_months(spark, path, lines(spark, ("a", MAY, "same", "2002-02-01")), "owner", months(spark))
    table = sinks.read_table(spark, path).withColumn("day", F.col("load_ts").cast("date").cast("string"))
    assert values(table, "owner", "day") == [("a", "2002-02-01"), ("b", "2002-01-01")]


def test_emptied_months_and_lines_without_time(spark, tmp_path):
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, *FIRST, ("a", None, "timeless", "2002-01-01")), "owner", buckets=2)
    nothing = lines(spark, *FIRST).limit(0)
    load_owner_months(spark, path, nothing, "owner", months(spark, ("a", 200105), ("a", None), (None, 200105), ("z", 200105)))
    assert held(spark, path) == [("a", 200106, "old"), ("a", None, "timeless"), ("b", 200105, "old")]
    # Of an owner whose months are all named, nothing is known any more: the source counts again.
    load_owner_months(spark, path, lines(spark, (None, MAY, "back", "2001-01-01")), "owner", months(spark))
    assert (None, 200105, "back") in held(spark, path)


def test_untouched_directories_are_not_read(spark, tmp_path):
    path = tmp_path / "stg"
    load_owner_months(spark, str(path), lines(spark, *FIRST), "owner", buckets=1)
    for file in path.glob(f"{ledgers.BUCKET}=0/month_id=200106/*.parquet"):
        file.write_bytes(b"spoilt")
    for crc in path.glob(f"{ledgers.BUCKET}=0/month_id=200106/.*.crc"):
        crc.write_bytes(b"")
    load_owner_months(spark, str(path), lines(spark, ("b", MAY, "new", "2002-02-01")), "owner", months(spark, ("b", 200105)))
    assert ("b", 200105, "new") in values(sinks.read_table(spark, str(path)).filter("month_id = 200105"), "owner", "month_id", "concept")


def test_a_stopped_swap_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, *FIRST), "owner", buckets=4)
    move, calls = sinks._move, []

    def stop(spark, source, target):
        calls.append(target)
        if ledgers.BUCKET in target and len([t for t in calls if ledgers.BUCKET in t]) == 2:
            raise OSError("stopped")
        move(spark, source, target)

    monkeypatch.setattr(sinks, "_move", stop)
    again = lines(spark, ("a", MAY, "new", "2002-02-01"), ("b", MAY, "new", "2002-02-01"))
    with pytest.raises(OSError, match="stopped"):
        load_owner_months(spark, path, again, "owner")
    monkeypatch.undo()
    assert held(spark, path) == sorted([("a", 200105, "new"), ("a", 200106, "old"), ("b", 200105, "new"), (None, 200105, "old")], key=str)


def test_new_columns_and_latest_months(spark, tmp_path):
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, *FIRST), "owner", buckets=2)
    again = lines(spark, ("a", JUNE, "new", "2002-02-01"), ("b", MAY, "old", "2002-01-01")).withColumn("channel", F.lit("app"))
    assert values(touched_owner_months(again, "owner"), "owner", "month_id") == [("a", 200106), ("b", 200105)]
    load_owner_months(spark, path, again, "owner")
    table = sinks.read_table(spark, path)
    assert values(table, "owner", "month_id", "channel") == sorted([("a", 200105, None), ("a", 200106, "app"), ("b", 200105, "app"), (None, 200105, None)], key=str)


def budget(spark, *rows):
    data = [(owner, date(2001, 5, 1), 2001, 5, "Food", Decimal(amount)) for owner, amount in rows]
    return spark.createDataFrame(data, "owner string, month_start date, year bigint, month bigint, category string, budget decimal(18,4)")


def test_tables_of_many_ledgers(spark, tmp_path, monkeypatch):
    """A load of one owner, a stopped refresh, and a change of budget and dictionary reach all tables of that owner and
    leave those of the others as they are."""
    house = LedgerHouse(spark, str(tmp_path / "house"), DEMO, buckets=3)
    tagged = lines(spark, *FIRST).withColumn("comment", F.when(F.col("owner") == "b", F.lit("Med/")))
    house.load_reference(inputs.keys(spark).filter("tag <> 'Med/'"), budget(spark, ("a", "15"), ("b", "5")))
    house.load_lines(tagged)
    compliance = ("owner", "budget", "spent", "verdict")
    assert values(house.table("budget_compliance").filter("budget IS NOT NULL"), *compliance) == [
        ("a", 15, 10, "CUMPLE"), ("b", 5, 10, "EXCESO"),
    ]
    again = lines(spark, ("a", MAY, "new", "2002-02-01"), ("a", MAY, "newer", "2002-02-01"))
    real = LedgerHouse._store

    def stop(self, name, rows, changed):
        if name == "cells":
            raise OSError("stopped")
        real(self, name, rows, changed)

    monkeypatch.setattr(owners.LedgerHouse, "_store", stop)
    with pytest.raises(OSError, match="stopped"):
        house.load_lines(again)
    monkeypatch.undo()
    assert len(house.refresh()) == 1 and house.refresh() == set()
    flow = cashflow.cash_flow(house.sums(), DEMO, keys=("owner",))
    assert [row.owner for row in flow.sort("owner", "period").collect()] == [None, "a", "a", "b"]
    assert values(house.table("cells"), "owner", "month_id", "amount_main") == sorted(
        [(None, 200105, 10), ("a", 200105, 10), ("a", 200105, 10), ("a", 200106, 10), ("b", 200105, 10)], key=str
    )
    house.load_reference(inputs.keys(spark), budget(spark, ("a", "25"), ("b", "5")))
    house.refresh()
    assert values(house.table("budget_compliance").filter("budget IS NOT NULL"), *compliance) == [
        ("a", 25, 20, "CUMPLE"), ("b", 5, 10, "EXCESO"),
    ]
    assert values(house.table("fact_transactions").filter("tag IS NOT NULL"), "owner", "tag") == [("b", "Med/")]


def test_no_merge_where_no_owner_keeps_lines(spark, tmp_path, monkeypatch):
    """Lines of other owners in the directory are not looked up among the updates; kept lines of an updated owner are."""
    path = str(tmp_path / "stg")
    load_owner_months(spark, path, lines(spark, *FIRST), "owner", buckets=1)
    asked = []
    real = owners.merge_by_key
    monkeypatch.setattr(owners, "merge_by_key", lambda *args: asked.append(1) or real(*args))
    load_owner_months(spark, path, lines(spark, ("a", MAY, "new", "2002-02-01")), "owner", months(spark, ("a", 200105)))
    assert not asked
    assert held(spark, path) == sorted([("a", 200105, "new"), ("a", 200106, "old"), ("b", 200105, "old"), (None, 200105, "old")], key=str)
    load_owner_months(spark, path, lines(spark, ("b", MAY, "old", "2002-02-01")), "owner", months(spark))
    assert asked
    assert held(spark, path) == sorted([("a", 200105, "new"), ("a", 200106, "old"), ("b", 200105, "old"), (None, 200105, "old")], key=str)


def test_tables_are_refreshed_side_by_side(spark, tmp_path, monkeypatch):
    """Tables that do not follow from each other meet here; an error is raised when the others have ended."""
    house = LedgerHouse(spark, str(tmp_path / "house"), DEMO, buckets=3)
    house.load_reference(inputs.keys(spark), budget(spark, ("a", "15")))
    groups = (("fact_transactions", "words"), ("cells", "largest", "hourly_pay", "tagged_share", "budget_compliance"))
    met = {name: barrier for group in groups for barrier in [Barrier(len(group))] for name in group}
    real, failing = LedgerHouse._store, ["hourly_pay"]

    def store(self, name, rows, changed):
        met[name].wait(20)
        if name in failing:
            raise OSError("stopped")
        real(self, name, rows, changed)

    monkeypatch.setattr(owners.LedgerHouse, "_store", store)
    with pytest.raises(OSError, match="stopped"):
        house.load_lines(lines(spark, *FIRST))
    assert values(house.table("cells"), "owner", "month_id") == sorted([("a", 200105), ("a", 200106), ("b", 200105), (None, 200105)], key=str)
    failing.clear()
    assert house.refresh() and house.refresh() == set()
    assert house.table("hourly_pay").count() == 0


def test_small_tables_are_written_by_many_tasks(spark, tmp_path):
    """A row for each of many directories: no task writes all of them, and a directory is one file."""
    rows = spark.range(400).selectExpr("concat('o', id % 10) AS owner", "cast(200001 + id % 12 AS int) AS month_id")
    path = str(tmp_path / "few")
    ledgers.store_cells(rows, path, "owner", 4, set(), ledgers.FEW)
    files = [file for file in (tmp_path / "few").rglob("part-*.parquet")]
    assert len(files) == len(ledgers.stored_cells(spark, path))
    assert len({file.name.split("-")[1] for file in files}) > 1
    assert values(sinks.read_table(spark, path), "owner", "month_id") == values(rows, "owner", "month_id")
