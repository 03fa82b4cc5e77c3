"""Hand-made ledger rows."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from casebook import inputs
from tallyhouse.operators import ledger
from casebook.policy import DEMO

FEED = (
    "occurred_at timestamp_ntz, account string, category string, subcategory string, concept string, comment string, "
    "flow string, amount_main decimal(18,4), amount_native decimal(18,4), amount_txn decimal(18,4), currency string, "
    "src_file string, file_size bigint, file_created_at timestamp, load_ts timestamp"
)


def line(when="2001-05-10 08:00:00", amount="10", loaded="2002-01-01", **values):
    money = None if amount is None else Decimal(amount)
    row = {
        "occurred_at": when and datetime.fromisoformat(when),
        "account": "Card",
        "category": "Food",
        "subcategory": None,
        "concept": "Lunch",
        "comment": None,
        "flow": "Expense",
        "amount_main": money,
        "amount_native": money,
        "amount_txn": money,
        "currency": "PEN",
        "src_file": "feed.csv",
        "file_size": 1,
        "file_created_at": datetime.fromisoformat(loaded),
        "load_ts": datetime.fromisoformat(loaded),
    }
    for name, value in values.items():
        row[name] = Decimal(value) if name.startswith("amount") and value is not None else value
    return row


def feed(spark, *lines):
    names = [part.split()[0] for part in FEED.split(", ")]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in lines], FEED)


def staged(spark, *lines):
    return ledger.stage_transactions(feed(spark, *lines))


def fact(spark, *lines, policy=DEMO):
    return ledger.fact_transactions(staged(spark, *lines), inputs.keys(spark), policy)


def budget(spark, *rows):
    data = [
        (date.fromisoformat(day), int(day[:4]), int(day[5:7]), category, Decimal(amount)) for day, category, amount in rows
    ]
    return spark.createDataFrame(
        data, "month_start date, year bigint, month bigint, category string, budget decimal(18,4)"
    )


def mortgage(spark, *rows):
    """Rows of (due date, paid, installment, principal, extra principal)."""
    data = [
        (
            "Unit 0", paid, date.fromisoformat(due), n, Decimal(installment), Decimal(principal), Decimal(extra),
            Decimal(principal) + Decimal(extra),
        )
        for n, (due, paid, installment, principal, extra) in enumerate(rows, 1)
    ]
    kinds = "decimal(18,4)"
    frame = spark.createDataFrame(
        data,
        f"property_id string, paid boolean, due_date date, installment_no bigint, installment {kinds}, "
        f"principal {kinds}, extra_principal {kinds}, principal_total {kinds}",
    )
    others = ("property_insurance", "life_insurance", "interest", "rental_income")
    return frame.select("*", *(F.lit(None).cast(kinds).alias(name) for name in others))


def values(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=str)
