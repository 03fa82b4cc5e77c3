"""SQL counterparts of the registered queries, for DuckDB on the same tables.

They are written apart from the DataFrame code: filtered aggregates, correlated subqueries and unions where that has
conditional sums, joins and windows. Agreement is evidence for both.
"""

from __future__ import annotations

import re

from casebook import inputs
from casebook.queries import RANGE
from casebook.policy import DEMO


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def num(expression: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {name}"


def day(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name}"


def moment(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


def exact_ratio(numerator: str, denominator: str, digits: int, scale: int = 4) -> str:
    """Quotient rounded half away from zero in whole numbers; DuckDB itself would divide doubles."""
    top = f"CAST({numerator} * {10**scale} AS HUGEINT)"
    bottom = f"CAST({denominator} * {10**scale} AS HUGEINT)"
    rounded = f"((2 * abs({top}) * {10**digits} + abs({bottom})) // (2 * abs({bottom})))"
    sign = f"(sign({top}) * sign({bottom}))"
    return (
        f"CASE WHEN {denominator} <> 0 THEN CAST({sign} * {rounded} / {10**digits}.0 AS DECIMAL(24,{max(digits, 4)})) END"
    )


P = DEMO
SAVINGS_IN = f"account IN {words(P.savings_accounts)} AND flow = '{P.transfer_in}'"
REIT = f"category = '{P.investments}' AND subcategory = '{P.reit}'"
PREPAID = (
    f"category = '{P.investments}' AND subcategory = '{P.property_subcategory}' AND concept = '{P.prepayment_concept}'"
)
DEDUCTED = f"category IN {words(P.deduction_categories)} OR concept IN {words(P.deduction_concepts)}"
EARNED = f"category IN {words(P.earned)}"

LEDGER_COLUMNS = (
    "txn_id, month_id, txn_time, day_of_week, account, category, subcategory, concept, amount_main, flow, comment, "
    "amount_native, currency, amount_txn"
)

# Named sub-queries; each may use the ones before it.
CTES = {
    "ledger_t": inputs.LEDGER,
    "budget_t": inputs.BUDGET,
    "mortgage_t": inputs.MORTGAGE,
    "keys_t": "SELECT * FROM (VALUES ('C/'), ('Inm/'), ('Med/')) AS t(tag)",
    "catalog_t": f"""SELECT src_file AS uri, count(*) AS file_size, TIMESTAMP '{inputs.CREATED_AT}' AS file_created_at,
        TIMESTAMP '{inputs.LOADED_AT}' AS load_ts FROM ledger_t GROUP BY src_file""",
    "stg_t": f"""SELECT md5(strftime(occurred_at, '%Y-%m-%d %H:%M:%S') || account
          || rtrim(rtrim(CAST(amount_main AS VARCHAR), '0'), '.') || coalesce(concept, 'transfer')
          || coalesce(comment, 'null') || category || coalesce(subcategory, 'null')) AS txn_id,
        CAST(strftime(occurred_at, '%Y%m') AS BIGINT) AS month_id, occurred_at AS txn_time,
        strftime(occurred_at, '%A') AS day_of_week, account, category, subcategory, concept, amount_main, flow,
        comment, CAST(amount_txn AS DECIMAL(18,4)) AS amount_native, currency,
        CAST(amount_txn AS DECIMAL(18,4)) AS amount_txn, l.src_file, TIMESTAMP '{inputs.LOADED_AT}' AS load_ts
      FROM ledger_t l""",
    "words_t": """SELECT *, string_split(comment, ' ') AS words,
        regexp_matches(trim(lower(comment)), '(d[ií]as trabajados|d[ií]a trabajado)$') AS says_days FROM stg_t""",
    "tagged_t": """SELECT l.*, k.tag, CASE WHEN says_days THEN TRY_CAST(words[1] AS DECIMAL(18,4)) END AS worked_days,
        CASE k.tag WHEN 'C/' THEN words[2] ELSE trim(regexp_extract(CASE WHEN k.tag IS NOT NULL THEN comment END, '/([^/]*)', 1)) END
          AS tag_value
      FROM words_t l LEFT JOIN keys_t k ON k.tag = l.words[1]""",
    "fact_t": f"""SELECT {LEDGER_COLUMNS}, {exact_ratio("amount_main", "amount_txn", 3)} AS fx_rate, worked_days, tag,
        tag_value, src_file, load_ts
      FROM tagged_t WHERE account NOT IN {words(P.non_money_accounts)}""",
    "owned_t": "SELECT *, account AS owner FROM fact_t",
    "cells_t": f"""SELECT date_trunc('month', txn_time) AS month_start, category, sum(amount_main) AS spent
      FROM fact_t WHERE flow = '{P.expense}' GROUP BY 1, 2""",
    "comply_t": f"""SELECT md5(strftime(month_start, '%Y-%m-%d %H:%M:%S') || category) AS month_cat_id, month_start,
        category, spent, budget, {exact_ratio("spent * 100", "budget", 3)} AS used_pct,
        round(budget - spent, 2) AS remaining,
        CASE sign(budget - spent) WHEN -1 THEN 'EXCESO' WHEN 0 THEN 'CUMPLE' WHEN 1 THEN 'CUMPLE' END AS verdict, load_ts
      FROM (
        SELECT c.month_start, c.category, c.spent, (SELECT max(budget) FROM budget_t b
            WHERE b.month_start = c.month_start AND upper(b.category) = upper(c.category)) AS budget,
          (SELECT max(load_ts) FROM fact_t x WHERE date_trunc('month', x.txn_time) = c.month_start
            AND x.flow = '{P.expense}') AS load_ts
        FROM cells_t c
        UNION ALL
        SELECT b.month_start, b.category, 0, b.budget, NULL FROM budget_t b WHERE NOT EXISTS (SELECT 1 FROM cells_t c
          WHERE b.month_start = c.month_start AND upper(b.category) = upper(c.category)))""",
    "income_t": f"""SELECT *, gross - deductions AS net,
        round(median(CAST(gross - deductions AS DOUBLE)) OVER (PARTITION BY year), 2) AS median_net
      FROM (SELECT date_trunc('month', txn_time) AS month_start, year(txn_time) AS year, month(txn_time) AS month,
          coalesce(sum(amount_main) FILTER (WHERE {EARNED}), 0) AS gross,
          coalesce(sum(amount_main) FILTER (WHERE {DEDUCTED}), 0) AS deductions
        FROM fact_t GROUP BY ALL)""",
    "share_t": f"""SELECT date_trunc('month', txn_time) AS month_start, year(txn_time) AS year,
        month(txn_time) AS month,
        round(coalesce(sum(amount_main) FILTER (WHERE flow = '{P.income}' AND category <> '{P.refunds}'), 0), 2)
          AS income_total,
        round(coalesce(sum(amount_main) FILTER (WHERE subcategory = '{P.tracked}' AND category <> '{P.loans}'
          AND flow = '{P.expense}'), 0), 3) AS tracked_spend,
        max(load_ts) AS load_ts
      FROM fact_t GROUP BY 1, 2, 3""",
    "plan_t": f"""SELECT i.*, net - living AS after_living, net - living - installment AS available
      FROM (SELECT date_trunc('month', txn_time) AS month_start, month_id,
          coalesce(sum(amount_main) FILTER (WHERE {EARNED}), 0) AS gross,
          coalesce(sum(amount_main) FILTER (WHERE {EARNED}), 0)
            - coalesce(sum(amount_main) FILTER (WHERE category IN {words(P.plan_deductions)}), 0) AS net,
          (SELECT sum(installment) FROM mortgage_t WHERE date_trunc('month', due_date) = date_trunc('month', txn_time)
            AND date_trunc('month', due_date) >= DATE '{P.plan_start}'
            AND date_trunc('month', due_date) <= DATE '{P.as_of}') AS installment,
          (SELECT sum(CASE WHEN category IN ('{P.debt}', '{P.essential_debt}') THEN 0 ELSE budget END)
              * CAST({P.living_cost_buffer} AS DECIMAL(3,2))
            FROM budget_t b WHERE b.month_start = date_trunc('month', txn_time)) AS living
        FROM fact_t WHERE category IN {words(P.earned + P.plan_deductions)} GROUP BY ALL) i""",
    "days_t": f"""SELECT CAST(txn_time AS DATE) AS date, month_id,
        coalesce(sum(amount_main) FILTER (WHERE {EARNED}), 0) AS gross,
        coalesce(sum(amount_main) FILTER (WHERE {SAVINGS_IN}), 0) AS savings,
        coalesce(sum(amount_main) FILTER (WHERE concept = '{P.reit_plan_concept}'), 0) AS reit,
        coalesce(sum(amount_main) FILTER (WHERE {PREPAID}), 0) AS prepayment
      FROM fact_t WHERE {EARNED} OR ({SAVINGS_IN}) OR ({REIT}) OR ({PREPAID}) GROUP BY 1, 2""",
    "tracked_t": f"""SELECT d.date, d.month_id, plan_t.after_living, plan_t.available,
        CAST(floor(available * CAST({P.savings_share} AS DECIMAL(3,2))) AS DECIMAL(24,4)) AS savings_allotted,
        CAST(floor(available * CAST({P.reit_share} AS DECIMAL(3,2))) AS DECIMAL(24,4)) AS reit_allotted,
        CAST(floor(available * CAST({P.prepayment_share} AS DECIMAL(3,2))) AS DECIMAL(24,4)) AS prepayment_allotted,
        (SELECT sum(x.gross) FROM days_t x WHERE x.month_id = d.month_id AND x.date <= d.date) AS gross_to_date,
        (SELECT sum(x.savings) FROM days_t x WHERE x.month_id = d.month_id AND x.date <= d.date) AS savings_invested,
        (SELECT sum(x.reit) FROM days_t x WHERE x.month_id = d.month_id AND x.date <= d.date) AS reit_invested,
        (SELECT sum(x.prepayment) FROM days_t x WHERE x.month_id = d.month_id AND x.date <= d.date)
          AS prepayment_invested
      FROM days_t d LEFT JOIN plan_t USING (month_id)""",
    "coverage_t": f"""SELECT *, CASE WHEN indispensable > 0
          THEN {exact_ratio("passive * 100", "indispensable", 1)} ELSE 0 END AS coverage_pct
      FROM (SELECT month, sum(passive) AS passive, sum(indispensable) AS indispensable FROM (
        SELECT strftime(txn_time, '%Y-%m') AS month, amount_main AS passive, 0 AS indispensable FROM fact_t
          WHERE category = '{P.passive}'
        UNION ALL SELECT strftime(txn_time, '%Y-%m'), 0, amount_main FROM fact_t
          WHERE category IN {words(P.indispensable)} AND flow = '{P.expense}') GROUP BY month)""",
    # Load scenario: the stored table after the first batch, and the exports after the second.
    "batch1_t": """SELECT * FROM stg_t WHERE month_id <= 200012
      AND NOT (month_id IN (200011, 200012) AND flow = 'Income')""",
    "batch2_t": f"""SELECT * REPLACE (TIMESTAMP '{inputs.RELOADED_AT}' AS load_ts) FROM stg_t WHERE month_id >= 200011
      AND NOT (month_id IN (200011, 200012) AND flow = 'Transfer out')""",
    "exports_t": """SELECT * FROM stg_t WHERE month_id < 200011 UNION ALL SELECT * FROM batch2_t""",
}


def _pay(source: str, keys: str = "") -> str:
    counted = f"category = '{P.salary}' OR concept IN {words(P.pay_concepts)} OR concept LIKE '{P.pay_concept_pattern}'"
    return f"""SELECT *, {exact_ratio("net", "nullif(hours, 0)", 2)} AS pay_per_hour FROM (
      SELECT *, net_days * {P.hours_per_day} AS hours, gross - deductions AS net FROM (
        SELECT *, CAST(round(worked_days * CAST({P.effective_day_factor} AS DECIMAL(4,3)), 2) AS DECIMAL(20,2)) AS net_days
        FROM (SELECT {keys} year(txn_time) AS year, month(txn_time) AS month, max(txn_time) AS txn_time,
          max(load_ts) AS load_ts,
          coalesce(sum(amount_main) FILTER (WHERE category = '{P.salary}'), 0) AS gross,
          coalesce(sum(amount_main) FILTER (WHERE category <> '{P.salary}'), 0) AS deductions,
          sum(coalesce(worked_days, CASE WHEN category = '{P.salary}' THEN NULL ELSE 0 END)) AS worked_days
        FROM {source} WHERE {counted} GROUP BY ALL)))"""


def _life(fact: str, pay: str, key: str = "") -> str:
    """Each expense with the rate of its month: the month's own, else the newest."""
    lead = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    newest = f"""SELECT {lead}hours AS new_hours, pay_per_hour AS new_pay FROM {pay}
      QUALIFY row_number() OVER ({part} ORDER BY year DESC, month DESC) = 1"""
    months = f"SELECT DISTINCT {lead}year(txn_time) AS year, month(txn_time) AS month FROM {fact}"
    rates = f"""SELECT {lead}year, month, coalesce(hours, new_hours) AS hours_worked,
        coalesce(pay_per_hour, new_pay) AS pay_per_hour
      FROM ({months}) JOIN ({newest}) {f"USING ({key})" if key else "ON true"}
      LEFT JOIN (SELECT {lead}year, month, hours, pay_per_hour FROM {pay}) USING ({lead}year, month)"""
    spent = f"SELECT *, year(txn_time) AS year, month(txn_time) AS month FROM {fact} WHERE flow = '{P.expense}'"
    return f"""SELECT *, {exact_ratio("amount_main", "pay_per_hour", 3)} AS cost_hours
      FROM ({spent}) JOIN ({rates}) USING ({lead}year, month)"""


CTES["life_t"] = _life("fact_t", "pay_t")
CTES["life_owned_t"] = _life("owned_t", "pay_owned_t", "owner")
CTES["pay_t"] = _pay("fact_t")
CTES["pay_owned_t"] = _pay("owned_t", "owner, ")

_ORDER = [
    "ledger_t", "budget_t", "mortgage_t", "keys_t", "catalog_t", "stg_t", "words_t", "tagged_t", "fact_t", "owned_t",
    "pay_t", "pay_owned_t", "life_t", "life_owned_t", "cells_t", "comply_t", "income_t", "share_t", "plan_t", "days_t", "tracked_t",
    "coverage_t", "batch1_t", "batch2_t", "exports_t",
]


def full(query: str) -> str:
    """``query`` with the sub-queries it needs in front."""
    needed: set[str] = set()
    texts = [query]
    while texts:
        for name in re.findall(r"\b[a-z0-9_]+_t\b", texts.pop()):
            if name in CTES and name not in needed:
                needed.add(name)
                texts.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in _ORDER if name in needed]
    if query.lstrip().startswith("WITH"):
        query = f"SELECT * FROM ({query})"
    return f"WITH {', '.join(parts)} {query}" if parts else query


STG = f"""txn_id, month_id, {moment("txn_time", "txn_time")}, day_of_week, account, category, subcategory, concept,
  {num("amount_main", "amount_main")}, flow, comment, {num("amount_native", "amount_native")}, currency,
  {num("amount_txn", "amount_txn")}, src_file, CAST(NULL AS BIGINT) AS file_size,
  '{inputs.CREATED_AT}' AS file_created_at, {moment("load_ts", "load_ts")}"""

PAY = f"""{moment("txn_time", "txn_time")}, year, month, {num("worked_days", "worked_days")},
  {num("net_days", "net_days")}, {num("hours", "hours")}, {num("gross", "gross")}, {num("deductions", "deductions")},
  {num("net", "net")}, {num("pay_per_hour", "pay_per_hour")}, 'PEN' AS currency, {moment("load_ts", "load_ts")}"""

LIFE = f"""{moment("txn_time", "txn_time")}, txn_id, year, month, account, category, subcategory, concept, comment,
  {num("amount_main", "amount_main")}, {num("hours_worked", "hours_worked")}, {num("pay_per_hour", "pay_per_hour")},
  {num("cost_hours", "cost_hours")}, {moment("load_ts", "load_ts")}"""

PERCENT_TEXT = "rtrim(rtrim(CAST(used_pct AS VARCHAR), '0'), '.') || '%'"

TRACKING = ", ".join(
    [
        day("date", "date"), "month_id", num("gross_to_date", "gross_to_date"), num("after_living", "after_living"),
        num("available", "available"),
        *(num(f"{name}_{part}", f"{name}_{part}") for name in ("savings", "reit", "prepayment")
          for part in ("allotted", "invested")),
        *(num(f"{name}_allotted - {name}_invested", f"{name}_remaining") for name in ("savings", "reit", "prepayment")),
    ]
)


def _cash_flow(period: str, keys: str = "", source: str = "fact_t") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}period, {num("income", "income")}, {num("-spent", "expenses")},
        {num("income - spent", "balance")},
        {num("sum(income - spent) OVER (" + part + " ORDER BY period)", "running_balance")}
      FROM (SELECT {lead}{period} AS period,
          coalesce(sum(amount_main) FILTER (WHERE flow = '{P.income}'), 0) AS income,
          coalesce(sum(amount_main) FILTER (WHERE flow = '{P.expense}'), 0) AS spent
        FROM {source} GROUP BY ALL)"""


def _top(where: str, n: int, description: str = "description") -> str:
    return f"""SELECT txn_id, {day("txn_time", "date")}, coalesce(category, 'Sin categoría') AS category,
        coalesce(concept, 'Sin concepto') AS {description}, {num("coalesce(amount_main, 0)", "amount")}
      FROM fact_t WHERE {where} ORDER BY amount_main DESC NULLS LAST, txn_id LIMIT {n}"""


TOP_EXPENSES = f"flow = '{P.expense}' AND lower(concept) NOT IN {words(P.top_expense_hidden_concepts)}"


def _dense(lines: str, labels: list[str], label: str, value: str) -> str:
    """Months by labels with zero for what is missing."""
    names = ", ".join(f"('{name}')" for name in labels)
    return f"""WITH lines AS ({lines}), months AS (SELECT DISTINCT month FROM lines),
        labels AS (SELECT * FROM (VALUES {names}) AS t({label})),
        cells AS (SELECT month, {label}, sum(value) AS value FROM lines GROUP BY 1, 2)
      SELECT m.month, l.{label}, {num("coalesce(c.value, 0)", value)} FROM months m CROSS JOIN labels l
      LEFT JOIN cells c ON c.month = m.month AND c.{label} = l.{label}"""


def _rates(dates_fact: str = "", dates_due: str = "") -> str:
    return f"""SELECT income, spent - reits - voluntary - principal AS consumption,
        reits + voluntary + savings + principal AS wealth_building
      FROM (SELECT coalesce(sum(CASE WHEN flow = '{P.income}' THEN amount_main ELSE 0 END), 0) AS income,
          coalesce(sum(CASE WHEN flow = '{P.expense}' THEN amount_main ELSE 0 END), 0) AS spent,
          coalesce(sum(CASE WHEN {REIT} THEN amount_main ELSE 0 END), 0) AS reits,
          coalesce(sum(CASE WHEN category = '{P.debt}' OR ({PREPAID}) THEN amount_main ELSE 0 END), 0) AS voluntary,
          coalesce(sum(CASE WHEN account IN {words(P.savings_accounts)} AND flow = '{P.transfer_in}' THEN amount_main
            WHEN account IN {words(P.savings_accounts)} AND flow = '{P.transfer_out}' THEN -amount_main ELSE 0 END), 0)
            AS savings
        FROM fact_t WHERE true {dates_fact}) a
      CROSS JOIN (SELECT coalesce(sum(principal), 0) AS principal FROM mortgage_t WHERE paid {dates_due}) b"""


LATEST_BUDGET = "FROM budget_t WHERE month_start = (SELECT max(month_start) FROM budget_t)"


def _median(dates: str = "") -> str:
    return f"""(SELECT coalesce((SELECT quantile_cont(CAST(net AS DOUBLE), 0.5) FROM income_t
      WHERE true {dates}), 0))"""


def _kpis(dates_fact: str = "", dates_due: str = "", dates_month: str = "") -> str:
    debt = f"(SELECT coalesce(sum(budget), 0) {LATEST_BUDGET} AND category = '{P.essential_debt}')"
    median = _median(dates_month)
    consumed = f"CASE WHEN income > 0 THEN {exact_ratio('consumption * 100', 'income', 1)} ELSE 0 END"
    built = f"CASE WHEN income > 0 THEN {exact_ratio('wealth_building * 100', 'income', 1)} ELSE 0 END"
    kept = f"""CASE WHEN income > 0 THEN
      {exact_ratio('(income - consumption - wealth_building) * 100', 'income', 1)} ELSE 0 END"""
    return f"""SELECT 30000.0::DOUBLE AS emergency_fund,
        {num(f"(SELECT coalesce(sum(budget), 0) {LATEST_BUDGET} AND category IN {words(P.essential)})", "strict_cost")},
        {num(f"(SELECT coalesce(sum(budget), 0) {LATEST_BUDGET})", "life_cost")},
        {num(median, "median_net_income")}, {num(consumed, "consumption_rate", 1)}, {num(built, "wealth_rate", 1)},
        {num(kept, "cash_rate", 1)}, {num(debt, "essential_debt")},
        round(CASE WHEN {median} > 0 THEN CAST({debt} AS DOUBLE) / {median} * 100 ELSE 0 END, 1) AS debt_to_income_pct
      FROM ({_rates(dates_fact, dates_due)})"""


RANGED = [
    f"AND CAST({column} AS DATE) >= DATE '{RANGE[0]}' AND CAST({column} AS DATE) <= DATE '{RANGE[1]}'"
    for column in ("txn_time", "due_date", "month_start")
]

NET_WORTH = f"""
  WITH equity AS (SELECT strftime(due_date, '%Y-%m') AS month, sum(CASE WHEN paid THEN principal_total ELSE 0 END) AS v
      FROM mortgage_t WHERE due_date <= DATE '{P.as_of}' GROUP BY 1),
    reits AS (SELECT strftime(txn_time, '%Y-%m') AS month, sum(amount_main) AS v FROM fact_t WHERE {REIT} GROUP BY 1),
    savings AS (SELECT strftime(txn_time, '%Y-%m') AS month,
        sum(CASE WHEN flow IN ('{P.income}', '{P.transfer_in}') THEN amount_main
          WHEN flow IN ('{P.expense}', '{P.transfer_out}') THEN -amount_main ELSE 0 END) AS v
      FROM fact_t WHERE account IN {words(P.savings_accounts)} GROUP BY 1),
    balance AS (SELECT strftime(txn_time, '%Y-%m') AS month,
        sum(CASE WHEN flow = '{P.income}' THEN amount_main ELSE 0 END)
        - sum(CASE WHEN flow = '{P.expense}' THEN amount_main ELSE 0 END) AS v FROM fact_t GROUP BY 1),
    months AS (SELECT month FROM equity UNION SELECT month FROM reits UNION SELECT month FROM savings
      UNION SELECT month FROM balance),
    series AS (SELECT m.month,
        coalesce((SELECT sum(v) FROM equity x WHERE x.month <= m.month), 0) AS equity,
        coalesce((SELECT sum(v) FROM reits x WHERE x.month <= m.month), 0) AS reits,
        coalesce((SELECT sum(v) FROM savings x WHERE x.month <= m.month), 0) AS savings,
        coalesce((SELECT sum(v) FROM balance x WHERE x.month <= m.month), 0) AS balance,
        CASE WHEN m.month >= (SELECT min(month) FROM equity) THEN (SELECT sum(principal_total) FROM mortgage_t) END AS loan
      FROM months m)
  SELECT month, {num("round(equity, 2)", "mortgage_equity")}, {num("round(reits, 2)", "reits")},
    {num("round(savings, 2)", "savings")}, {num("round(balance - savings, 2)", "cash")},
    {num("round(coalesce(loan - equity, 0), 2)", "pending_debt")},
    {num("round(equity + reits + savings + (balance - savings) - coalesce(loan - equity, 0), 2)", "net_worth")}
  FROM series WHERE month >= '{P.series_start}'"""

LIFE_TRACKED = f"coalesce(subcategory, 'no_subcat') = '{P.tracked}'"


def _details(where: str) -> str:
    return f"""SELECT {day("txn_time", "date")}, coalesce(category, '') AS category,
        coalesce(subcategory, '') AS subcategory, coalesce(concept, '') AS concept,
        {num("coalesce(amount_main, 0)", "amount_main")}, {num("coalesce(cost_hours, 0)", "cost_hours")},
        {num("coalesce(hours_worked, 0)", "hours_worked")}, {num("coalesce(pay_per_hour, 0)", "pay_per_hour")}
      FROM life_t WHERE {where}"""


def _report(where: str = "true") -> str:
    return f"""SELECT {day("month_start", "date")}, category, {num("coalesce(spent, 0)", "spent")},
        {num("coalesce(budget, 0)", "budget")}, coalesce({PERCENT_TEXT}, '0%') AS used,
        {num("coalesce(remaining, 0)", "remaining")}, coalesce(verdict, 'DESCONOCIDO') AS verdict
      FROM comply_t WHERE {where}"""


def _loaded(query: str) -> str:
    return f"SELECT {STG} FROM ({query})"


def _arrived() -> str:
    """Staged lines without what their file says."""
    columns = STG.split(", src_file")[0]
    return f"SELECT {columns} FROM stg_t"


AFTER_LOAD = "SELECT * FROM stg_t WHERE month_id < 200011 UNION ALL SELECT * FROM batch2_t"

STRAY = f"month_id = {inputs.STRAY_MONTH} AND category = 'Food' AND txn_id IS NOT NULL"
AFTER_REPEAT = f"""SELECT * REPLACE (CASE WHEN {STRAY} THEN '{inputs.STRAY_FILE}' ELSE src_file END AS src_file,
    CASE WHEN {STRAY} THEN TIMESTAMP '{inputs.RELOADED_AT}' ELSE load_ts END AS load_ts) FROM ({AFTER_LOAD})"""

_AGAIN = ", ".join(f"'{name}'" for name in inputs.REISSUING)
AFTER_OWNERS = f"""SELECT * FROM batch1_t WHERE account IS NULL OR account NOT IN ({_AGAIN})
  UNION ALL SELECT * FROM ({AFTER_LOAD}) WHERE account IN ({_AGAIN})"""

MORTGAGE_COLUMNS = f"""property_id, paid, {day("due_date", "due_date")}, CAST(installment_no AS BIGINT) AS installment_no,
  {num("installment", "installment")}, {num("property_insurance", "property_insurance")},
  {num("life_insurance", "life_insurance")}, {num("rental_income", "rental_income")},
  {num("extra_principal", "extra_principal")}, {num("principal", "principal")},
  {num("principal_total", "principal_total")}, {num("interest", "interest")},
  CAST(NULL AS BIGINT) AS days, CAST(NULL AS VARCHAR) AS comment,
  """ + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in inputs.UNFILLED if name not in ("days", "comment"))

BUDGET_COLUMNS = f"""{day("month_start", "month_start")}, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month,
  category, {num("budget", "budget")}"""


def _table() -> dict[str, str]:
    latest = "load_ts = (SELECT max(load_ts) FROM exports_t)"
    touched = f"(SELECT DISTINCT month_id FROM exports_t WHERE {latest})"
    kpi_cells = ", ".join(
        f"sum(CASE WHEN lower(coalesce(subcategory, 'no_subcat')) <> '{P.tracked.lower()}' AND lower(category) = "
        f"'{category}' THEN cost_hours ELSE 0 END) AS {bucket}"
        for bucket, category in P.life_buckets
    )
    buckets = [bucket for bucket, _ in P.life_buckets] + [P.tracked_bucket]
    kpi_rows = " UNION ALL ".join(
        f"SELECT '{bucket}' AS bucket, {num(f'coalesce({bucket}, 0)', 'hours')} FROM sums" for bucket in buckets
    )
    share_pct = exact_ratio("coalesce(sum(tracked_spend), 0) * 100", "nullif(sum(income_total), 0)", 6)
    return {
        "s1_read_feed": f"""SELECT {moment("occurred_at", "occurred_at")}, account, category, subcategory, concept,
            comment, flow, {num("amount_main", "amount_main")}, {num("amount_txn", "amount_native")},
            {num("amount_txn", "amount_txn")}, currency, true AS from_csv FROM ledger_t""",
        "s1_read_feed_reordered": f"""SELECT {moment("occurred_at", "occurred_at")}, account, category, subcategory, concept,
            comment, flow, {num("amount_main", "amount_main")}, {num("amount_txn", "amount_native")},
            {num("amount_txn", "amount_txn")}, currency, true AS from_csv FROM ledger_t""",
        "s1_read_feed_mixed": f"""SELECT {moment("occurred_at", "occurred_at")}, account, category, subcategory, concept,
            comment, flow, {num("amount_main", "amount_main")}, {num("amount_txn", "amount_native")},
            {num("amount_txn", "amount_txn")}, CASE WHEN month(occurred_at) % 3 <> 2 THEN currency END AS currency,
            true AS from_csv FROM ledger_t""",
        "d8_check_readable": f"""SELECT 'readable' AS "check", count(*) AS lines FROM ledger_t
            WHERE category = '{P.refunds}' HAVING count(*) > 0""",
        "w_stream": _arrived(),
        "w_stream_by_file": _arrived(),
        "s2_read_file_catalog": f"""SELECT uri, CAST(file_size AS BIGINT) AS file_size,
            {moment("file_created_at", "file_created_at")}, {moment("load_ts", "load_ts")} FROM catalog_t""",
        "s3_key_dictionary": """SELECT CAST(number AS BIGINT) AS number, name, tag, 'first' AS position, description,
            'split' AS pandas_function, introduced_on, count(*) AS uses
          FROM (VALUES (1, 'Companion', 'C/', 'who shared it', '2024-05-01'),
            (2, 'Property', 'Inm/', 'which unit', '2024-05-01'),
            (NULL, 'Medical', 'Med/', 'medical spend', NULL)) AS k(number, name, tag, description, introduced_on)
          JOIN stg_t ON string_split(comment, ' ')[1] = k.tag GROUP BY ALL""",
        "s4_budget_table": f"SELECT {BUDGET_COLUMNS} FROM budget_t",
        "s5_mortgage_table": f"SELECT {MORTGAGE_COLUMNS} FROM mortgage_t",
        "s6_overwrite_table": f"SELECT {BUDGET_COLUMNS} FROM budget_t",
        "s7_month_partitions": f"""SELECT month_id, count(*) AS lines, {num("sum(amount_main)", "amount")}
          FROM stg_t GROUP BY 1""",
        "l1_touched_months": f"SELECT DISTINCT month_id FROM exports_t WHERE {latest}",
        "l2_touched_months_from_files": f"""SELECT DISTINCT CAST(strftime(strptime(
              replace(right(src_file, 8), '.csv', '') || '01', '%y%m%d'), '%Y%m') AS BIGINT) AS month_id
          FROM exports_t WHERE {latest}""",
        "l3_drop_months": _loaded(f"SELECT * FROM batch1_t WHERE month_id NOT IN {touched}"),
        "l4_newer_than": _loaded(f"""SELECT * FROM exports_t WHERE load_ts >
            (SELECT max(load_ts) FROM batch1_t WHERE month_id NOT IN {touched})"""),
        "l5_newer_than_month": _loaded("""SELECT * FROM exports_t WHERE load_ts >
            (SELECT date_trunc('month', max(load_ts)) FROM batch1_t)"""),
        "l6_merge_by_key": _loaded("""SELECT * FROM batch1_t WHERE txn_id IS NULL OR txn_id NOT IN
            (SELECT txn_id FROM batch2_t WHERE txn_id IS NOT NULL) UNION ALL SELECT * FROM batch2_t"""),
        "l7_overwrite_months": _loaded(AFTER_LOAD),
        "l8_append_columns": f"""SELECT {STG}, channel FROM (SELECT *, CAST(NULL AS VARCHAR) AS channel FROM batch1_t
            UNION ALL SELECT *, 'app' AS channel FROM batch2_t)""",
        "l9_month_batch": _loaded(AFTER_LOAD),
        "l9_load_month_batch": _loaded(AFTER_LOAD),
        "l9_repeated_load": _loaded(AFTER_REPEAT),
        "l9_load_owner_months": _loaded(AFTER_OWNERS),
        "t1_stage_transactions": f"""SELECT {STG.replace("CAST(NULL AS BIGINT) AS file_size", "CAST(file_size AS BIGINT) AS file_size")
            .replace(moment("load_ts", "load_ts"), moment("stg_t.load_ts", "load_ts"))}
          FROM stg_t LEFT JOIN catalog_t ON uri = src_file""",
        "t2_fact_transactions": f"""SELECT txn_id, month_id, {moment("txn_time", "txn_time")}, day_of_week, account,
            category, subcategory, concept, {num("amount_main", "amount_main")}, flow, comment,
            {num("amount_native", "amount_native")}, currency, {num("amount_txn", "amount_txn")},
            {num("fx_rate", "fx_rate")}, {num("worked_days", "worked_days")}, tag, tag_value, src_file,
            '{inputs.CREATED_AT}' AS file_created_at, {moment("load_ts", "load_ts")} FROM fact_t""",
        "t3_fact_personal": f"""SELECT txn_id, month_id, {moment("txn_time", "txn_time")}, account, category, subcategory,
            concept, CASE WHEN lower(flow) LIKE '%in%' THEN 'Positivo' WHEN lower(flow) LIKE '%expens%'
              OR lower(flow) LIKE '%out%' THEN 'Negativo' END AS sentiment, comment,
            {num("amount_native", "amount_native")}, currency, {num("amount_txn", "amount_txn")}, tag, tag_value,
            {moment("load_ts", "load_ts")} FROM tagged_t WHERE account IN {words(P.personal_accounts)}""",
        "t4_parse_tag": "SELECT comment, tag, tag_value, count(*) AS lines FROM tagged_t GROUP BY 1, 2, 3",
        "t5_worked_days": f"""SELECT comment, count(*) AS lines, {num("worked_days", "worked_days")} FROM tagged_t
          GROUP BY comment, worked_days""",
        "g1_hourly_pay": f"SELECT {PAY} FROM pay_t",
        "g1_hourly_pay_by_owner": f"SELECT owner, {PAY} FROM pay_owned_t",
        "g2_life_cost": f"SELECT {LIFE} FROM life_t",
        "g2_life_cost_by_owner": f"SELECT owner, month_id, {LIFE} FROM life_owned_t",
        "g3_budget_compliance": f"""SELECT month_cat_id, {day("month_start", "month_start")}, category,
            {num("spent", "spent")}, {num("budget", "budget")}, {num("used_pct", "used_pct")}, {PERCENT_TEXT} AS used,
            {num("remaining", "remaining")}, verdict, {moment("load_ts", "load_ts")} FROM comply_t""",
        "g4_income_summary": f"""SELECT {day("month_start", "month_start")}, year, month, {num("gross", "gross")},
            {num("deductions", "deductions")}, {num("net", "net")}, {num("median_net", "median_net")} FROM income_t""",
        "g5_tagged_share": f"""SELECT {day("month_start", "month_start")}, year, month,
            {num("income_total", "income_total")}, {num("tracked_spend", "tracked_spend")},
            {num(exact_ratio("tracked_spend", "income_total", 5), "tracked_share", 6)}, {moment("load_ts", "load_ts")}
          FROM share_t""",
        "g6_tag_ledger": f"""SELECT txn_id, month_id, {moment("txn_time", "txn_time")}, account, category, subcategory,
            concept, {num("amount_main", "amount_main")}, flow, comment, {num("amount_native", "amount_native")},
            currency, {num("amount_txn", "amount_txn")}, {num("fx_rate", "fx_rate")}, tag, tag_value,
            {moment("load_ts", "load_ts")}
          FROM fact_t WHERE tag = 'Inm/' AND category NOT IN {words(P.property_hidden_categories)}""",
        "g7_investment_plan": f"""SELECT {day("month_start", "month_start")}, month_id, {num("gross", "gross")},
            {num("net", "net")}, {num("after_living", "after_living")}, {num("installment", "installment")},
            {num("available", "available")},
            {num(f"floor(available * CAST({P.savings_share} AS DECIMAL(3,2)))", "savings_share")},
            {num(f"floor(available * CAST({P.prepayment_share} AS DECIMAL(3,2)))", "prepayment_share")},
            {num(f"floor(available * CAST({P.reit_share} AS DECIMAL(3,2)))", "reit_share")} FROM plan_t""",
        "g8_investment_tracking": f"""SELECT {TRACKING} FROM tracked_t t
          WHERE date = (SELECT max(date) FROM days_t d WHERE d.month_id = t.month_id)""",
        "g8_investment_tracking_daily": f"SELECT {TRACKING} FROM tracked_t",
        "q1_last_update": """SELECT coalesce(strftime(max(load_ts), '%Y-%m-%d %H:%M:%S+00:00'), 'Desconocida')
            AS last_update FROM fact_t""",
        "q2_cash_flow": _cash_flow("strftime(date_trunc('month', txn_time), '%Y-%m-%d')"),
        "q2_cash_flow_daily": _cash_flow("strftime(txn_time, '%Y-%m-%d')"),
        "q2_cash_flow_by_owner": _cash_flow("strftime(date_trunc('month', txn_time), '%Y-%m-%d')", "owner", "owned_t"),
        "q3_spend_by_category": f"""SELECT category, {num("sum(amount_main)", "amount")} FROM fact_t
          WHERE flow = '{P.expense}' AND concept NOT IN {words(P.report_hidden_concepts)}
            AND category IN {words(P.report_categories)} GROUP BY 1""",
        "q4_quarter_balance": f"""SELECT strftime(date_trunc('quarter', txn_time), '%Y-%m-%d') AS quarter,
            {num("sum(CASE WHEN lower(flow) LIKE '%in%' THEN amount_main ELSE -amount_main END)", "balance")}
          FROM fact_t GROUP BY 1""",
        "q5_top_expenses": _top(TOP_EXPENSES, 10),
        "q5_top_expenses_by_owner": f"""SELECT owner, txn_id, {day("txn_time", "date")}, category,
            concept AS description, {num("amount_main", "amount")} FROM owned_t WHERE {TOP_EXPENSES}
          QUALIFY row_number() OVER (PARTITION BY owner ORDER BY amount_main DESC, txn_id) <= 10""",
        "q6_budget_report": _report(),
        "q6_budget_report_filtered": _report("""year(month_start) IN (1999, 2000) AND month(month_start) IN (1, 2, 3)
            AND category IN ('Food', 'FOOD', 'Bills', 'Salary')"""),
        "q7_survival_cost": f"""SELECT
            {num(f"coalesce(sum(CASE WHEN category IN {words(P.essential)} THEN budget ELSE 0 END), 0)", "strict_cost")},
            {num("coalesce(sum(budget), 0)", "life_cost")} {LATEST_BUDGET}""",
        "q8_median_net_income": f"SELECT {num(_median(), 'median_net_income')}",
        "q9_wealth_rates": f"""SELECT {num("income", "income")}, {num("consumption", "consumption")},
            {num("wealth_building", "wealth_building")},
            {num(exact_ratio("consumption * 100", "income", 6), "consumption_rate", 6)},
            {num(exact_ratio("wealth_building * 100", "income", 6), "wealth_rate", 6)},
            {num(exact_ratio("(income - consumption - wealth_building) * 100", "income", 6), "cash_rate", 6)}
          FROM ({_rates()})""",
        "q10_debt_to_income": f"""SELECT {num("debt", "essential_debt")}, {num("median", "median_net_income")},
            {num("CASE WHEN median > 0 THEN CAST(debt AS DOUBLE) / median * 100 ELSE 0 END", "debt_to_income_pct")}
          FROM (SELECT (SELECT coalesce(sum(budget), 0) {LATEST_BUDGET} AND category = '{P.essential_debt}') AS debt,
            {_median()} AS median)""",
        "q11_growth_kpis": _kpis(),
        "q11_growth_kpis_ranged": _kpis(*RANGED),
        "q12_net_worth": NET_WORTH,
        "q13_net_worth_snapshot": f"SELECT * FROM ({NET_WORTH}) ORDER BY month DESC LIMIT 1",
        "q14_essential_split": f"""SELECT month, {num("round(e, 2)", "essential")}, {num("round(d, 2)", "discretionary")},
            {num(f"CASE WHEN e + d > 0 THEN {exact_ratio('e * 100', '(e + d)', 1)} ELSE 0 END", "essential_pct", 1)}
          FROM (SELECT strftime(txn_time, '%Y-%m') AS month,
              sum(CASE WHEN category IN {words(P.essential)} THEN amount_main ELSE 0 END) AS e,
              sum(CASE WHEN category NOT IN {words(P.essential)} THEN amount_main ELSE 0 END) AS d
            FROM fact_t WHERE flow = '{P.expense}' AND category NOT IN ('{P.investments}', '{P.debt}') GROUP BY 1)""",
        "q15_net_income_series": f"""SELECT strftime(month_start, '%Y-%m') AS month, {num("coalesce(net, 0)", "net")}
          FROM income_t""",
        "q16_passive_income": f"""SELECT month, {num("amount", "amount")},
            {num("sum(amount) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)", "running_amount")}
          FROM (SELECT strftime(txn_time, '%Y-%m') AS month, sum(amount_main) AS amount FROM fact_t
            WHERE category = '{P.passive}' GROUP BY 1)""",
        "q17_financial_freedom": f"""SELECT month, {num("passive", "passive")},
            {num("indispensable", "indispensable")}, {num("coverage_pct", "coverage_pct", 1)}
          FROM coverage_t ORDER BY month DESC LIMIT 12""",
        "q18_latest_coverage": f"""SELECT {num('''CASE
            WHEN last_month = '%s' AND months > 1 THEN before ELSE last END''' % f"{P.as_of:%Y-%m}", "latest_coverage_pct", 1)}
          FROM (SELECT max(month) AS last_month, count(*) AS months, max_by(coverage_pct, month) AS last,
            (SELECT coverage_pct FROM coverage_t ORDER BY month DESC LIMIT 1 OFFSET 1) AS before FROM coverage_t)""",
        "q19_top_income": _top(
            f"flow = '{P.income}' AND lower(category) NOT IN {words(P.top_income_hidden_categories)}", 10
        ),
        "q20_income_by_category": f"""SELECT category, {num("sum(amount_main)", "amount")} FROM fact_t
          WHERE flow = '{P.income}' AND category NOT IN ('{P.refunds}') GROUP BY 1""",
        "q21_mortgage_kpis": f"""SELECT {num("paid", "installments_paid")}, {num("extra", "extra_principal")},
            {num("side", "side_costs")}, {num("paid + extra + side", "total_cost")}
          FROM (SELECT (SELECT coalesce(sum(installment), 0) FROM mortgage_t WHERE paid) AS paid,
            (SELECT coalesce(sum(extra_principal), 0) FROM mortgage_t WHERE paid) AS extra,
            (SELECT coalesce(sum(amount_main), 0) FROM fact_t WHERE tag_value = '{P.property_value}'
              AND flow = '{P.expense}' AND concept NOT IN {words(P.property_hidden_concepts)}) AS side)""",
        "q22_mortgage_breakdown": f"""SELECT strftime(due_date, '%Y-%m') AS month,
            {num("coalesce(principal, 0)", "principal")}, {num("coalesce(interest, 0)", "interest")},
            {num("coalesce(property_insurance, 0) + coalesce(life_insurance, 0)", "insurance")},
            {num("coalesce(rental_income, 0)", "rental_income")} FROM mortgage_t""",
        "q23_mortgage_equity": f"""SELECT {num("paid", "paid")}, {num("pending", "pending")},
            {num("paid + pending", "total")} FROM (
            SELECT sum(CASE WHEN paid THEN principal_total ELSE 0 END) AS paid,
              sum(CASE WHEN paid THEN 0 ELSE principal_total END) AS pending FROM mortgage_t)""",
        "q24_mortgage_prepayments": f"""SELECT strftime(due_date, '%Y-%m') AS month, {num("extra_principal", "amount")}
          FROM mortgage_t WHERE paid AND extra_principal > 0""",
        "q25_life_cost_kpis": f"""WITH sums AS (SELECT {kpi_cells},
              sum(CASE WHEN lower(subcategory) = '{P.tracked.lower()}' THEN cost_hours ELSE 0 END) AS {P.tracked_bucket}
            FROM life_t) {kpi_rows}""",
        "q26_life_cost_details": _details(f"category = 'Food' AND NOT {LIFE_TRACKED}"),
        "q26_life_cost_details_tracked": _details(LIFE_TRACKED),
        "q27_life_cost_matrix": _dense(
            f"""SELECT strftime(txn_time, '%Y-%m') AS month, category, cost_hours AS value FROM life_t
              WHERE category IN {words(P.life_categories)} AND NOT {LIFE_TRACKED}""",
            list(P.life_categories),
            "category",
            "hours",
        ),
        "q28_habit_matrix": _dense(
            f"""SELECT strftime(txn_time, '%Y-%m') AS month,
                CASE WHEN concept NOT IN ('Coffee', 'Instant coffee') THEN concept
                  WHEN concept = 'Instant coffee' OR category = 'Food' THEN 'Coffee (Food)'
                  ELSE concat('Coffee (', category, ')') END AS item, amount_main AS value
              FROM fact_t WHERE concept IN {words((*P.habit_items, "Coffee", "Instant coffee"))}
                AND category IN {words(P.habit_categories)}""",
            list(P.habit_labels),
            "item",
            "amount",
        ),
        "q29_tagged_kpis": f"""SELECT {num("gross", "gross_spend")}, {num("refunds", "refunds")},
            {num("gross - refunds", "net_spend")}, {num("coalesce(pct, 0)", "share_pct", 6)}
          FROM (SELECT coalesce(sum(CASE WHEN flow = '{P.expense}' THEN amount_main ELSE 0 END), 0) AS gross,
              coalesce(sum(CASE WHEN category = '{P.refunds}' THEN amount_main ELSE 0 END), 0) AS refunds
            FROM fact_t WHERE subcategory = '{P.tracked}')
          CROSS JOIN (SELECT CASE WHEN sum(income_total) > 0 THEN {share_pct} END AS pct FROM share_t)""",
        "q30_tagged_trend": f"""SELECT strftime(month_start, '%Y-%m') AS month,
            {num("coalesce(tracked_spend, 0)", "tracked_spend")} FROM share_t""",
        "q31_tagged_top": f"""SELECT txn_id, {day("txn_time", "date")}, coalesce(concept, 'Sin concepto') AS concept,
            coalesce(tag_value, '') AS tag_value, {num("coalesce(amount_main, 0)", "amount")} FROM fact_t
          WHERE category NOT IN ('{P.loans}', '{P.refunds}') AND flow = '{P.expense}' AND subcategory = '{P.tracked}'
          ORDER BY amount_main DESC NULLS LAST, txn_id LIMIT 100""",
        "q32_tagged_by_category": f"""SELECT category,
            {num(f"sum(CASE WHEN flow = '{P.expense}' THEN amount_main ELSE -amount_main END)", "amount")} FROM fact_t
          WHERE subcategory = '{P.tracked}' AND category <> '{P.refunds}' GROUP BY 1""",
        "q33_shared_spend": f"""WITH cells AS (SELECT strftime(txn_time, '%Y-%m') AS month,
              coalesce(tag_value, 'Sin asignar') AS companion,
              coalesce(sum(amount_main) FILTER (WHERE flow = '{P.expense}'), 0)
                - coalesce(sum(amount_main) FILTER (WHERE flow <> '{P.expense}'), 0) AS amount
            FROM fact_t WHERE tag = 'C/' GROUP BY 1, 2
            HAVING count(*) FILTER (WHERE category <> '{P.refunds}') > 0)
          SELECT m.month, p.companion, {num("coalesce(c.amount, 0)", "amount")}
          FROM (SELECT DISTINCT month FROM cells) m CROSS JOIN (SELECT DISTINCT companion FROM cells) p
          LEFT JOIN cells c ON c.month = m.month AND c.companion = p.companion""",
        "q34_date_range": f"""SELECT txn_id, {moment("txn_time", "txn_time")}, account, category,
            {num("amount_main", "amount_main")} FROM fact_t WHERE true {RANGED[0]}""",
        "d1_check_unique": """SELECT 'unique:txn_id' AS "check", txn_id AS key, CAST(count(*) AS VARCHAR) AS detail
            FROM stg_t WHERE txn_id IS NOT NULL GROUP BY txn_id HAVING count(*) > 1
          UNION ALL SELECT 'unique:month_id,category', month_id || '|' || category, CAST(count(*) AS VARCHAR)
            FROM stg_t GROUP BY month_id, category HAVING count(*) > 1""",
        "d2_check_not_null": """SELECT 'not_null:txn_id' AS "check", txn_id AS key, src_file AS detail
          FROM stg_t WHERE txn_id IS NULL""",
        "d3_check_relationship": """SELECT 'relationship:word' AS "check", words[1] AS key,
            CAST(count(*) AS VARCHAR) AS detail FROM words_t WHERE words[1] IS NOT NULL
            AND words[1] NOT IN (SELECT tag FROM keys_t) GROUP BY words[1]""",
        "d4_check_net_le_gross": """SELECT 'net_le_gross' AS "check", year || '-' || month AS key,
            CAST(net AS VARCHAR) AS detail FROM pay_t WHERE net > gross""",
        "d5_check_value_for_tag": """SELECT 'value_for_tag' AS "check", txn_id AS key, tag AS detail FROM fact_t
          WHERE tag IS NOT NULL AND tag_value IS NULL""",
        "d5_check_worked_days": """SELECT 'worked_days' AS "check", txn_id AS key, comment AS detail FROM fact_t
          WHERE regexp_matches(trim(lower(comment)), '(d[ií]as trabajados|d[ií]a trabajado)$')
            AND worked_days IS NULL""",
        "d6_check_freshness": f"""SELECT 'freshness:txn_time' AS "check", {moment("max(txn_time)", "key")},
            'warn' AS detail FROM stg_t
            HAVING max(txn_time) < TIMESTAMP '2002-01-01 12:00:00' - INTERVAL 30 DAY
          UNION ALL SELECT 'freshness:file_created_at', {moment("max(file_created_at)", "key")}, 'error' FROM catalog_t
            HAVING max(file_created_at) < TIMESTAMP '2002-01-01 12:00:00' - INTERVAL 24 HOUR""",
        "d7_check_range": f"""SELECT 'range:fx_rate' AS "check", txn_id AS key, {num("fx_rate", "detail")}
            FROM fact_t WHERE fx_rate < 2.5 OR fx_rate > 5.0
          UNION ALL SELECT 'range:worked_days', CAST(year AS VARCHAR), {num("worked_days", "detail")} FROM pay_t
            WHERE worked_days > 31
          UNION ALL SELECT 'range:tracked_share', strftime(month_start, '%Y-%m-%d'), {num("share", "detail")}
            FROM (SELECT *, {exact_ratio("tracked_spend", "income_total", 5)} AS share FROM share_t) WHERE share > 1
          UNION ALL SELECT 'range:cost_hours', txn_id, {num("cost_hours", "detail")} FROM life_t
            WHERE cost_hours > 300""",
    }


LOADED_THRICE = f"""SELECT *, CAST(NULL AS VARCHAR) AS channel FROM before_t WHERE month_id < 200011
  UNION ALL SELECT * REPLACE (TIMESTAMP '{inputs.RELOADED_AT}' AS load_ts), NULL FROM before_t WHERE month_id >= 200011
    AND month_id NOT IN ({inputs.WITHDRAWN_MONTH}, {inputs.CUT_MONTH})
    AND NOT (month_id IN (200011, 200012) AND flow = 'Transfer out')
  UNION ALL SELECT * REPLACE (TIMESTAMP '{inputs.WITHDRAWN_AT}' AS load_ts), 'app' FROM before_t
    WHERE month_id = {inputs.CUT_MONTH} AND flow <> 'Income'"""


def after_three_loads(query: str) -> str:
    """The query over the lines that three loads leave behind."""
    stage = f"stg_t AS ({CTES['stg_t']})"
    text = full(query)
    assert stage in text
    return text.replace(stage, f"before_t AS ({CTES['stg_t']}), stg_t AS ({LOADED_THRICE})", 1)


def _some_days(query: str) -> str:
    """The query over the lines of a range whose bounds lie inside months."""
    assert "FROM fact_t" in query
    return query.replace("FROM fact_t", """FROM (SELECT * FROM fact_t
      WHERE txn_time >= DATE '1998-01-15' AND txn_time < DATE '2000-06-11')""")


def _warehouse(table: dict[str, str]) -> dict[str, str]:
    stored = {
        "w_stg_transactions": f"SELECT {STG}, channel FROM stg_t",
        "w_fact_transactions": table["t2_fact_transactions"],
        "w_fact_personal": table["t3_fact_personal"],
        "w_hourly_pay": table["g1_hourly_pay"],
        "w_life_cost": table["g2_life_cost"],
        "w_budget_compliance": table["g3_budget_compliance"],
        "w_tagged_share": table["g5_tagged_share"],
        "w_property_ledger": table["g6_tag_ledger"],
        "w_income_summary": table["g4_income_summary"],
        "w_checks": f"""SELECT 'stg_transactions' AS "table", 'unique:txn_id' AS "check", txn_id AS key,
            CAST(count(*) AS VARCHAR) AS detail FROM stg_t GROUP BY txn_id HAVING txn_id IS NOT NULL AND count(*) > 1
          UNION ALL SELECT 'fact_transactions', 'unique:txn_id', txn_id, CAST(count(*) AS VARCHAR) FROM fact_t
            GROUP BY txn_id HAVING txn_id IS NOT NULL AND count(*) > 1
          UNION ALL SELECT 'stg_transactions', 'not_null:txn_id', NULL, src_file FROM stg_t WHERE txn_id IS NULL
          UNION ALL SELECT 'fact_transactions', 'value_for_tag', txn_id, tag FROM fact_t
            WHERE tag IS NOT NULL AND tag_value IS NULL
          UNION ALL SELECT 'stg_transactions', 'freshness:txn_time', {moment("max(txn_time)", "key")}, 'warn' FROM stg_t
            HAVING max(txn_time) < TIMESTAMP '2002-03-01' - INTERVAL 30 DAY""",
    }
    whole = ("q2_cash_flow", "q16_passive_income", "q17_financial_freedom", "q18_latest_coverage", "q9_wealth_rates", "q12_net_worth")
    days = ("q2_cash_flow", "q3_spend_by_category", "q20_income_by_category", "q4_quarter_balance", "q14_essential_split", "q5_top_expenses", "q19_top_income", "q31_tagged_top")
    stored |= {f"w_{name.split('_', 1)[1]}": table[name] for name in whole}
    stored |= {f"w_{name.split('_', 1)[1]}_days": _some_days(table[name]) for name in days}
    for name in ("q12_net_worth", "q16_passive_income"):
        stored[f"w_{name.split('_', 1)[1]}_months"] = f"SELECT * FROM ({table[name]}) WHERE month BETWEEN '{RANGE[0]:%Y-%m}' AND '{RANGE[1]:%Y-%m}'"
    stored["w_top_expenses_food"] = table["q5_top_expenses"].replace("FROM fact_t", "FROM (SELECT * FROM fact_t WHERE category = 'Food')")
    return {name: after_three_loads(query) for name, query in stored.items()}


def oracle_sql() -> dict[str, str]:
    table = _table()
    table["g2_life_cost_by_owner_salted"] = table["g2_life_cost_by_owner"]
    table["w_owners_transactions"] = table["t2_fact_transactions"]
    table["w_owners_hourly_pay"] = table["g1_hourly_pay_by_owner"]
    table["w_owners_life_cost"] = table["g2_life_cost_by_owner"]
    table["w_owners_cash_flow"] = table["q2_cash_flow_by_owner"]
    table["w_owners_top_expenses"] = table["q5_top_expenses_by_owner"]
    table["w_retagged"] = table["t2_fact_transactions"]
    return {name: full(query) for name, query in table.items()} | _warehouse(table)
