"""The English vocabulary of the fixture ledger."""

from __future__ import annotations

from datetime import date

from tallyhouse.policy import Policy

DEMO = Policy(
    income="Income",
    expense="Expense",
    transfer_in="Transfer in",
    transfer_out="Transfer out",
    positive_patterns=("%in%",),
    negative_patterns=("%expens%", "%out%"),
    personal_accounts=("Personal",),
    non_money_accounts=("Mileage", "Personal"),
    savings_accounts=("Savings A", "Savings B", "Savings C"),
    salary="Salary",
    passive="Passive",
    earned=("Salary", "Freelance", "Passive"),
    refunds="Refunds",
    loans="Loans",
    pay_concepts=("Pension contribution", "Pension insurance", "Income tax"),
    pay_concept_pattern="Commission %",
    deduction_categories=("Pension", "Fees"),
    deduction_concepts=("Income tax", "Transaction tax"),
    plan_deductions=("Tax", "Pension", "Fees"),
    debt="Debt",
    essential_debt="Essential debt",
    essential=("Food", "Transport", "Bills", "Essential debt", "Health", "Variable", "Insurance"),
    indispensable=("Food", "Transport", "Bills", "Debt", "Health", "Variable"),
    report_categories=(
        "Food", "Transport", "Bills", "Debt", "Essential debt", "Health", "Variable", "Insurance",
        "Entertainment", "Gifts", "Investments", "Travel", "Work gear", "Self-care",
    ),
    report_hidden_concepts=("Item 1", "Item 2", "Item 3"),
    top_expense_hidden_concepts=("income tax", "pension contribution"),
    top_income_hidden_categories=("refunds",),
    investments="Investments",
    reit="REIT",
    property_subcategory="Property",
    reit_plan_concept="REIT-A",
    prepayment_concept="Prepayment",
    companion_tag="C/",
    property_tag="Inm/",
    property_hidden_categories=("Food", "Gifts", "Transport"),
    property_value="Unit 0",
    property_hidden_concepts=("Prepayment", "Down payment"),
    tracked="Social",
    tracked_bucket="social",
    life_buckets=(
        ("food", "food"),
        ("bills", "bills"),
        ("gifts", "gifts"),
        ("entertainment", "entertainment"),
        ("transport", "transport"),
        ("health", "health"),
        ("investments", "investments"),
        ("work_gear", "work gear"),
    ),
    life_categories=(
        "Food", "Travel", "Gifts", "Entertainment", "Bills", "Health", "Transport", "Self-care",
        "Investments", "Work gear",
    ),
    habit_items=("Bread", "Item 4", "Item 5", "Item 6", "Popcorn"),
    habit_categories=("Food", "Entertainment", "Gifts"),
    habit_split_item="Coffee",
    habit_split_synonym="Instant coffee",
    habit_split_home="Food",
    habit_split_out="Entertainment",
    plan_start=date(1998, 10, 15),
    series_start="1997-05",
    as_of=date(2001, 6, 30),
)
