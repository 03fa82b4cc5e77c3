"""Vocabulary and parameters of one kind of ledger.

Operators take their category groups, rates and dates from a frozen :class:`Policy`, so one implementation serves
ledgers kept in any language. ``spanish_policy`` is the Spanish vocabulary of the household ledgers this engine was
modelled on.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

# Texts that appear in results whatever the ledger's language.
WITHIN_BUDGET = "CUMPLE"
OVER_BUDGET = "EXCESO"
NO_VERDICT = "DESCONOCIDO"
NO_PERCENT = "0%"
UNKNOWN_UPDATE = "Desconocida"
UNKNOWN_MONTH = "Desconocido"
NO_CONCEPT = "Sin concepto"
NO_CATEGORY = "Sin categoría"
NO_COMPANION = "Sin asignar"
POSITIVE = "Positivo"
NEGATIVE = "Negativo"
SAVINGS_DEPOSIT = "Cuentas Alto Rendimiento"
REIT_PURCHASE = "FIBRAS"
PREPAYMENT = "Prepagos"

# Comment endings that announce worked days, after lower-casing and folding the accented i.
WORKED_DAYS_ENDINGS = ("dias trabajados", "dia trabajado")


@dataclass(frozen=True)
class Policy:
    """Everything a ledger's owner decides. Word lists compare exactly unless a field says otherwise."""

    # Flow of a line.
    income: str
    expense: str
    transfer_in: str
    transfer_out: str
    positive_patterns: tuple[str, ...]  # LIKE patterns on the lower-cased flow
    negative_patterns: tuple[str, ...]

    # Accounts.
    personal_accounts: tuple[str, ...]
    non_money_accounts: tuple[str, ...]  # kept out of the money ledger
    savings_accounts: tuple[str, ...]

    # Income and what is taken off it.
    salary: str
    passive: str
    earned: tuple[str, ...]
    refunds: str
    loans: str
    pay_concepts: tuple[str, ...]
    pay_concept_pattern: str
    deduction_categories: tuple[str, ...]
    deduction_concepts: tuple[str, ...]
    plan_deductions: tuple[str, ...]

    # Spending groups.
    debt: str
    essential_debt: str
    essential: tuple[str, ...]
    indispensable: tuple[str, ...]
    report_categories: tuple[str, ...]
    report_hidden_concepts: tuple[str, ...]
    top_expense_hidden_concepts: tuple[str, ...]  # compared in lower case
    top_income_hidden_categories: tuple[str, ...]  # compared in lower case

    # Investing.
    investments: str
    reit: str
    property_subcategory: str
    reit_plan_concept: str
    prepayment_concept: str

    # Tags.
    companion_tag: str
    property_tag: str
    property_hidden_categories: tuple[str, ...]
    property_value: str
    property_hidden_concepts: tuple[str, ...]

    # The one subcategory tracked on its own.
    tracked: str
    tracked_bucket: str

    # Life cost: bucket name -> category (compared in lower case), and the matrix columns.
    life_buckets: tuple[tuple[str, str], ...]
    life_categories: tuple[str, ...]

    # Habits: plain items, and the one item that is split by category.
    habit_items: tuple[str, ...]
    habit_categories: tuple[str, ...]
    habit_split_item: str
    habit_split_synonym: str
    habit_split_home: str
    habit_split_out: str

    # Parameters.
    plan_start: date
    series_start: str  # first month shown, yyyy-MM
    as_of: date
    effective_day_factor: Decimal = Decimal("0.723")
    hours_per_day: int = 8
    living_cost_buffer: Decimal = Decimal("1.18")
    savings_share: Decimal = Decimal("0.27")
    prepayment_share: Decimal = Decimal("0.28")
    reit_share: Decimal = Decimal("0.45")
    emergency_fund: Decimal = Decimal("30000")
    currency: str = "PEN"

    @property
    def habit_home_label(self) -> str:
        return f"{self.habit_split_item} ({self.habit_split_home})"

    @property
    def habit_out_label(self) -> str:
        return f"{self.habit_split_item} ({self.habit_split_out})"

    @property
    def habit_labels(self) -> tuple[str, ...]:
        """The fixed rows of the habit matrix."""
        return (*self.habit_items, self.habit_home_label, self.habit_out_label)


def spanish_policy(property_value: str, as_of: date) -> Policy:
    """Spanish household vocabulary. ``property_value`` names the owned property as its tag value spells it."""
    # These words must equal the ledger's own spelling.
    return Policy(
        income="Ingreso",
        expense="Gastos",
        transfer_in="Dinero ingresado",
        transfer_out="Dinero gastado",
        positive_patterns=("%ingr%",),
        negative_patterns=("%gast%",),
        personal_accounts=("Personal",),
        non_money_accounts=("Kilometraje", "Personal"),
        savings_accounts=("Wow Compartamos", "Pichincha", "GNB"),
        salary="Salario",
        passive="Pasivo",
        earned=("Salario", "Freelance", "Pasivo"),
        refunds="Reembolsos",
        loans="Préstamos",
        pay_concepts=("Aporte AFP", "Seguro AFP", "Quinta categoría"),
        pay_concept_pattern="Comisión %",
        deduction_categories=("Jubilación", "Comisiones"),
        deduction_concepts=("Quinta categoría", "ITF"),
        plan_deductions=("Impuestos", "Jubilación", "Comisiones"),
        debt="Deudas",
        essential_debt="Deudas indispensables",
        essential=(
            "Comida", "Transporte", "Facturas", "Deudas indispensables", "Salud", "Gastos Variables", "Seguros",
        ),
        indispensable=("Comida", "Transporte", "Facturas", "Deudas", "Salud", "Gastos Variables"),
        report_categories=(
            "Entretenimiento", "Auto", "Comida", "Mujeres", "Viajes", "Seguros", "Salud", "Anuncios", "Deudas",
            "Casa", "Gastos Variables", "Inversiones", "Regalos", "Transporte", "Lavandería", "Facturas",
            "Equipo de trabajo", "Autocuidado", "No comestibles",
        ),
        report_hidden_concepts=("Cambio dólares", "liquidación", "Sin concepto"),
        top_expense_hidden_concepts=("quinta categoría", "aporte afp"),
        top_income_hidden_categories=("reembolsos", "descuentos", "dinero extra"),
        investments="Inversiones",
        reit="FIBRAS",
        property_subcategory="Inmuebles",
        reit_plan_concept="FIBPRIME",
        prepayment_concept="Amortización",
        companion_tag="C/",
        property_tag="Inm/",
        property_hidden_categories=("Comida", "Regalos", "Transporte"),
        property_value=property_value,
        property_hidden_concepts=("Amortización", "Cuota inicial", "Cuota hipoteca"),
        tracked="Mujeres",
        tracked_bucket="mujeres",
        life_buckets=(
            ("comida", "comida"),
            ("facturas", "facturas"),
            ("regalos", "regalos"),
            ("entretenimiento", "entretenimiento"),
            ("transporte", "transporte"),
            ("salud", "salud"),
            ("inversiones", "inversiones"),
            ("equipo_trabajo", "equipo de trabajo"),
        ),
        life_categories=(
            "Comida", "Viajes", "Regalos", "Entretenimiento", "Facturas", "Salud", "Transporte", "Autocuidado",
            "Inversiones", "Equipo de trabajo",
        ),
        habit_items=("Pan", "Pancito", "Cerveza", "Whisky", "Popcorn"),
        habit_categories=("Comida", "Entretenimiento", "Regalos"),
        habit_split_item="Café",
        habit_split_synonym="Café Instantáneo",
        habit_split_home="Comida",
        habit_split_out="Entretenimiento",
        plan_start=date(2025, 10, 15),
        series_start="2024-05",
        as_of=as_of,
    )
