"""Dashboard queries on the mortgage schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import month_label
from tallyhouse.functions.money import TOTAL, or_zero, total, total_when
from tallyhouse.operators.lookups import Keys, side_by_side
from tallyhouse.policy import UNKNOWN_MONTH, Policy


def _due_month():
    return F.coalesce(month_label(F.col("due_date")), F.lit(UNKNOWN_MONTH)).alias("month")


def mortgage_kpis(mortgage: DataFrame, fact: DataFrame, policy: Policy, keys: Keys = ()) -> DataFrame:
    """Installments paid, extra principal, side costs of the property, and their sum."""
    paid = mortgage.filter("paid").groupBy(*keys).agg(
        or_zero(total(F.col("installment"))).alias("installments_paid"),
        or_zero(total(F.col("extra_principal"))).alias("extra_principal"),
    )
    side = (
        fact.filter(
            (F.col("tag_value") == policy.property_value)
            & (F.col("flow") == policy.expense)
            & ~F.col("concept").isin(*policy.property_hidden_concepts)
        )
        .groupBy(*keys)
        .agg(or_zero(total(F.col("amount_main"))).alias("side_costs"))
    )
    names = ("installments_paid", "extra_principal", "side_costs")
    row = side_by_side([paid, side], keys).select(*keys, *(or_zero(F.col(name)).alias(name) for name in names))
    return row.withColumn(
        "total_cost", (F.col("installments_paid") + F.col("extra_principal") + F.col("side_costs")).cast(TOTAL)
    )


def mortgage_breakdown(mortgage: DataFrame, keys: Keys = ()) -> DataFrame:
    """What each installment consists of, and the rent that came in."""
    insurance = or_zero(F.col("property_insurance")) + or_zero(F.col("life_insurance"))
    return mortgage.orderBy(*keys, "due_date", "installment_no").select(
        *keys,
        _due_month(),
        or_zero(F.col("principal")).alias("principal"),
        or_zero(F.col("interest")).alias("interest"),
        insurance.alias("insurance"),
        or_zero(F.col("rental_income")).alias("rental_income"),
    )


def mortgage_equity(mortgage: DataFrame, keys: Keys = ()) -> DataFrame:
    """Principal paid and pending; an installment without status counts as pending."""
    principal = F.col("principal_total")
    paid = F.coalesce("paid", F.lit(False))
    return (
        mortgage.groupBy(*keys)
        .agg(
            or_zero(total_when(paid, principal)).alias("paid"),
            or_zero(total_when(~paid, principal)).alias("pending"),
        )
        .withColumn("total", (F.col("paid") + F.col("pending")).cast(TOTAL))
    )


def mortgage_prepayments(mortgage: DataFrame, keys: Keys = ()) -> DataFrame:
    """Paid installments that carried extra principal."""
    extra = mortgage.filter(F.col("paid") & (F.col("extra_principal") > 0))
    return extra.orderBy(*keys, "due_date", "installment_no").select(
        *keys, _due_month(), F.col("extra_principal").alias("amount")
    )
