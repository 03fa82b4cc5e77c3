from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casebook.policy import DEMO
from casebook import inputs
from tallyhouse.functions.calendar import date_range
from tallyhouse.functions.money import plain_number
from tallyhouse.operators import checks, ledger
from tallyhouse.operators.lookups import hot_keys, lookup_join
from tallyhouse.plans import load
from tallyhouse.policy import spanish_policy
from tests.rows import fact, feed, line, staged, values


def test_worked_days(spark):
    comments = ["12 Días trabajados", "1 dia trabajado ", "x dias trabajados", "12 dias trabajados hoy", None]
    lines = fact(spark, *(line(comment=text) for text in comments))
    assert [row.worked_days for row in lines.collect()] == [Decimal(12), Decimal(1), None, None, None]
    assert [row.detail for row in checks.check_worked_days(lines).collect()] == ["x dias trabajados"]


def test_tags(spark):
    comments = ["C/ Ana cena", "Inm/ Unit 0 / luz", "Inm/ Unit 0\t", "Zz/ a", "Med/", "C/", "", None]
    lines = fact(spark, *(line(comment=text) for text in comments))
    assert [(row.tag, row.tag_value) for row in lines.collect()] == [
        ("C/", "Ana"), ("Inm/", "Unit 0"), (None, None), (None, None), ("Med/", ""), ("C/", None), (None, None),
        (None, None),
    ]
    assert [row.detail for row in checks.check_value_for_tag(lines).collect()] == ["C/"]


def test_accounts_part_the_lines(spark):
    lines = staged(spark, *(line(account=name) for name in (None, "Mileage", "Personal", "Card")))
    keys = inputs.keys(spark)
    assert values(ledger.fact_transactions(lines, keys, DEMO), "account") == [("Card",)]
    assert values(ledger.fact_personal(lines, keys, DEMO), "account") == [("Personal",)]


def test_polarity(spark):
    flows = ["Income", "Transfer in", "Expense", "Transfer out", None, "other"]
    lines = staged(spark, *(line(account="Personal", flow=flow, concept=str(flow)) for flow in flows))
    got = ledger.fact_personal(lines, inputs.keys(spark), DEMO)
    assert [row.sentiment for row in got.collect()] == ["Positivo", "Positivo", "Negativo", "Negativo", None, None]


def test_exchange_rate(spark):
    lines = fact(spark, line(amount_main="7.5", amount_txn="2"), line(amount_txn="0"), line(amount_txn=None))
    assert [row.fx_rate for row in lines.collect()] == [Decimal("3.750"), None, None]


def test_line_id(spark):
    known = staged(spark, line(amount="12.5", concept=None, when="2001-05-10 08:00:00")).collect()[0]
    text = "2001-05-10 08:00:00Card12.5transfernullFoodnull"
    assert known.txn_id == spark.range(1).select(F.md5(F.lit(text))).first()[0]
    assert known.day_of_week == "Thursday" and known.month_id == 200105
    missing = staged(spark, line(account=None), line(amount=None), line(category=None), line(when=None))
    assert [row.txn_id for row in missing.collect()] == [None] * 4


@pytest.mark.parametrize(("number", "text"), [("45.5", "45.5"), ("100", "100"), ("0.125", "0.125"), ("0", "0")])
def test_plain_number(spark, number, text):
    assert spark.range(1).select(plain_number(F.lit(number).cast("decimal(18,4)"))).first()[0] == text


def test_lines_of_unknown_files_keep_no_metadata(spark):
    lines = feed(spark, line(src_file="a.csv"), line(src_file="b.csv"))
    catalog = spark.sql("SELECT 'a.csv' AS uri, 5L AS file_size, timestamp'2001-01-01' AS file_created_at, "
                        "timestamp'2001-01-02' AS load_ts")  # fmt: skip
    for limit in (10, 0):
        got = ledger.stage_transactions(lines, catalog, max_rows=limit)
        assert values(got, "src_file", "file_size") == [("a.csv", 5), (None, None)]


def test_salted_lookup_equals_broadcast(spark, sf):
    raw, catalog, keys = inputs.feed(spark, sf), inputs.catalog(spark, sf), inputs.keys(spark)
    small = ledger.stage_transactions(raw, catalog)
    salted = ledger.stage_transactions(raw, catalog, max_rows=0)
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()
    small, salted = (ledger.fact_transactions(small, keys, DEMO, max_rows=limit) for limit in (100, 0))
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()
    assert "_salt" not in salted.columns


def test_hot_key_is_split(spark):
    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") + 10).alias("k"), "id"
    )
    lookup = spark.range(2500).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert [row.k for row in hot_keys(lines.dropna(), ["k"]).collect()] == [7]
    spread = lookup_join(lines, lookup, ["k"], F.col("id"), max_rows=0)
    plain = lines.join(lookup, ["k"], "left")
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_date_range_is_inclusive_and_reaches_the_scan(spark, sf, tmp_path):
    from tallyhouse.sources import sinks

    lines = fact(spark, *(line(when=f"2001-0{m}-{d} 23:59:59") for m in (1, 2, 3) for d in (10, 28)))
    sinks.write_months(lines, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    ranged = date_range(stored, (date(2001, 1, 28), date(2001, 2, 28)))
    assert [row[0].strftime("%m-%d") for row in ranged.select("txn_time").orderBy("txn_time").collect()] == [
        "01-28", "02-10", "02-28",
    ]
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    scan = next(text for text in plan.splitlines() if "FileScan" in text)
    assert "PartitionFilters: [isnotnull(month_id" in scan and "GreaterThanOrEqual(txn_time" in scan
    assert date_range(stored, None).count() == 6 and date_range(stored, (None, date(2001, 1, 10))).count() == 1


def test_file_month(spark):
    names = ["gs://b/x_2403.csv", "feed_9912.csv", "feed_6901.csv", "feed_6801.csv"]
    rows = spark.createDataFrame([(name,) for name in names], "uri string")
    got = [row[0] for row in rows.select(load.file_month(F.col("uri"))).collect()]
    assert got == [202403, 199912, 196901, 206801]


def test_spanish_vocabulary(spark):
    policy = spanish_policy("Depa 1", date(2026, 1, 31))
    lines = fact(
        spark,
        line(account="Kilometraje"),
        line(flow="Gastos", category="Comida", comment="Inm/ Depa 1"),
        policy=replace(policy, non_money_accounts=policy.non_money_accounts),
    )
    assert values(lines, "category", "tag_value") == [("Comida", "Depa 1")]
    assert policy.habit_labels == (
        "Pan", "Pancito", "Cerveza", "Whisky", "Popcorn", "Café (Comida)", "Café (Entretenimiento)",
    )
