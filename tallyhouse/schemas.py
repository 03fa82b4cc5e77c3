"""Schemas of the inputs. Stored tables take their types from these plus the casts of the operators."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One ledger line as exported, in file order.
FEED = _struct(
    ("occurred_at", T.TimestampNTZType()),
    ("account", T.StringType()),
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("concept", T.StringType()),
    ("comment", T.StringType()),
    ("flow", T.StringType()),
    ("amount_main", MONEY),
    ("amount_native", MONEY),
    ("amount_txn", MONEY),
    ("currency", T.StringType()),
)

# Column names of the Spanish exports -> engine names.
SPANISH_FEED_COLUMNS = {
    "segun_un_periodo": "occurred_at",
    "cuentas": "account",
    "categoria": "category",
    "subcategorias": "subcategory",
    "nota": "concept",
    "descripcion": "comment",
    "ingreso_gasto": "flow",
    "pen": "amount_main",
    "importe": "amount_native",
    "cuentas_1": "amount_txn",
    "moneda": "currency",
}

# One row per exported file.
FILE_CATALOG = _struct(
    ("uri", T.StringType()),
    ("generation", T.LongType()),  # creation time in microseconds
    ("size", T.LongType()),
    ("updated", T.TimestampType()),
)

KEY_DICTIONARY = _struct(
    ("number", T.LongType()),
    ("name", T.StringType()),
    ("tag", T.StringType()),
    ("position", T.StringType()),
    ("description", T.StringType()),
    ("pandas_function", T.StringType()),
    ("introduced_on", T.DateType()),
)

SPANISH_KEY_COLUMNS = {
    "numero": "number",
    "nombre": "name",
    "clave": "tag",
    "posicion": "position",
    "descripcion": "description",
    "funcion_pandas": "pandas_function",
    "fecha_implementacion": "introduced_on",
}

BUDGET = _struct(
    ("month_start", T.DateType()),
    ("year", T.LongType()),
    ("month", T.LongType()),
    ("category", T.StringType()),
    ("budget", MONEY),
)

SPANISH_BUDGET_COLUMNS = {
    "fecha": "month_start",
    "year": "year",
    "month": "month",
    "categoria": "category",
    "presupuesto": "budget",
}

MORTGAGE = _struct(
    ("property_id", T.StringType()),
    ("paid", T.BooleanType()),
    ("due_date", T.DateType()),
    ("days", T.LongType()),
    ("installment_no", T.LongType()),
    ("opening_balance", MONEY),
    ("installment", MONEY),
    ("property_insurance", MONEY),
    ("life_insurance", MONEY),
    ("insurance_pct", MONEY),
    ("own_budget", MONEY),
    ("rental_income", MONEY),
    ("extra_principal", MONEY),
    ("extra_principal_taken", MONEY),
    ("principal", MONEY),
    ("principal_pct", MONEY),
    ("principal_total", MONEY),
    ("interest", MONEY),
    ("interest_pct", MONEY),
    ("total_paid", MONEY),
    ("closing_balance", MONEY),
    ("new_installment", MONEY),
    ("comment", T.StringType()),
)

SPANISH_MORTGAGE_COLUMNS = {
    "inmueble_id": "property_id",
    "pagado": "paid",
    "fecha_vencimiento": "due_date",
    "dias": "days",
    "num_pago": "installment_no",
    "saldo_inicial": "opening_balance",
    "cuota_mensual": "installment",
    "seguro_propiedad": "property_insurance",
    "seguro_desgravamen": "life_insurance",
    "porc_seguros": "insurance_pct",
    "presupuesto_personal": "own_budget",
    "ingreso_alquiler": "rental_income",
    "amortizacion_capital": "extra_principal",
    "robo_amortizacion": "extra_principal_taken",
    "capital_cuota": "principal",
    "porc_capital": "principal_pct",
    "capital_total": "principal_total",
    "interes_cuota": "interest",
    "porc_interes": "interest_pct",
    "total_pagado": "total_paid",
    "saldo_final": "closing_balance",
    "nueva_cuota": "new_installment",
    "comentario": "comment",
}
