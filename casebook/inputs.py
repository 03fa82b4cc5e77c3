"""Fixture ledger, budget and mortgage, derived from the lineitem table by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.sinks import parquet_writer, scratch_path
from tallyhouse.sources.reference import budget_table, key_dictionary, mortgage_table

_CATEGORY = """CASE cat_i WHEN 0 THEN 'Salary' WHEN 1 THEN 'Freelance' WHEN 2 THEN 'Passive' WHEN 3 THEN 'Tax'
  WHEN 4 THEN 'Pension' WHEN 5 THEN 'Fees' WHEN 6 THEN 'Food' WHEN 7 THEN 'Transport' WHEN 8 THEN 'Bills'
  WHEN 9 THEN 'Debt' WHEN 10 THEN 'Essential debt' WHEN 11 THEN 'Health' WHEN 12 THEN 'Variable'
  WHEN 13 THEN 'Insurance' WHEN 14 THEN 'Entertainment' WHEN 15 THEN 'Gifts' WHEN 16 THEN 'Investments'
  WHEN 17 THEN 'Travel' WHEN 18 THEN 'Work gear' WHEN 19 THEN 'Self-care' WHEN 20 THEN 'Refunds'
  WHEN 21 THEN 'Loans' END"""

LEDGER = f"""
WITH a AS (SELECT *, (l_partkey*3 + l_suppkey) % 22 AS cat_i, (l_suppkey + l_orderkey) % 50 AS acc_i,
  (l_orderkey*7 + l_linenumber*131 + l_partkey) % 1440 AS mins,
  year(l_shipdate)*100 + month(l_shipdate) AS ym FROM lineitem),
b AS (SELECT *, {_CATEGORY} AS category,
  CASE WHEN acc_i = 0 THEN NULL WHEN acc_i <= 3 THEN 'Mileage' WHEN acc_i <= 6 THEN 'Personal'
       WHEN acc_i <= 11 THEN 'Savings A' WHEN acc_i <= 16 THEN 'Savings B' WHEN acc_i <= 21 THEN 'Savings C'
       WHEN acc_i <= 35 THEN 'Checking' ELSE 'Card' END AS account FROM a),
d AS (SELECT *,
  CASE WHEN acc_i BETWEEN 7 AND 21 AND l_linenumber % 2 = 0 THEN 'Transfer in'
       WHEN acc_i BETWEEN 7 AND 21 AND l_linenumber % 5 = 0 THEN 'Transfer out'
       WHEN category IN ('Salary','Freelance','Passive','Refunds') THEN 'Income' ELSE 'Expense' END AS flow,
  CASE WHEN category = 'Investments' AND l_linenumber % 2 = 0 THEN 'REIT' WHEN category = 'Investments' THEN 'Property'
       WHEN l_partkey % 7 = 0 THEN 'Social' WHEN l_partkey % 5 = 0 THEN NULL
       ELSE 'Sub ' || CAST(l_partkey % 4 AS STRING) END AS subcategory
  FROM b)
SELECT l_shipdate + INTERVAL '1' MINUTE * mins AS occurred_at, account, category, subcategory, flow,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN category = 'Salary' THEN 'Salary'
       WHEN category = 'Pension' AND l_linenumber % 2 = 0 THEN 'Pension contribution'
       WHEN category = 'Pension' THEN 'Pension insurance'
       WHEN category = 'Tax' THEN 'Income tax' WHEN category = 'Fees' AND l_linenumber % 3 = 0 THEN 'Transaction tax'
       WHEN category = 'Fees' THEN 'Commission ' || CAST(l_suppkey % 5 AS STRING)
       WHEN subcategory = 'REIT' AND l_suppkey % 2 = 0 THEN 'REIT-A' WHEN subcategory = 'REIT' THEN 'REIT-B'
       WHEN subcategory = 'Property' AND l_suppkey % 2 = 0 THEN 'Prepayment'
       WHEN subcategory = 'Property' THEN 'Down payment'
       WHEN l_partkey % 9 = 0 THEN 'Coffee' WHEN l_partkey % 9 = 1 THEN 'Instant coffee'
       WHEN l_partkey % 9 = 2 THEN 'Bread' WHEN l_partkey % 9 = 3 THEN 'Popcorn'
       ELSE 'Item ' || CAST(l_partkey % 40 AS STRING) END AS concept,
  CASE WHEN category = 'Salary' AND l_quantity = 1 THEN '1 dia trabajado'
       WHEN category = 'Salary' THEN CAST(CAST(l_quantity AS INT) % 30 + 1 AS STRING) || ' Días trabajados'
       WHEN l_orderkey % 121 = 0 THEN 'C/'
       WHEN l_orderkey % 11 = 0 THEN 'C/ Person' || CAST(l_suppkey % 6 AS STRING) || ' shared'
       WHEN l_orderkey % 13 = 0 THEN 'Inm/ Unit ' || CAST(l_suppkey % 3 AS STRING)
       WHEN l_orderkey % 17 = 0 THEN 'Zz/ unregistered' WHEN l_orderkey % 19 = 0 THEN 'Med/'
       WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'note ' || CAST(l_linenumber AS STRING) END AS comment,
  CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE 'PEN' END AS currency,
  CAST(CASE WHEN l_orderkey % 41 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount_txn,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_suppkey % 3 = 0 THEN CAST(3.75 AS DECIMAL(4,2))
       ELSE CAST(1 AS DECIMAL(4,2)) END AS DECIMAL(18,4)) AS amount_main,
  'feed_' || right(CAST(ym AS STRING), 4) || '.csv' AS src_file
FROM d"""

BUDGET = f"""
WITH k AS (SELECT DISTINCT year(l_shipdate) AS y, month(l_shipdate) AS mo, (l_partkey*3 + l_suppkey) % 22 AS cat_i
  FROM lineitem),
x AS (SELECT *, (y-1995)*12 + mo AS mi, {_CATEGORY} AS cat FROM k)
SELECT make_date(CAST(y AS INT), CAST(mo AS INT), 1) AS month_start, CAST(y AS INT) AS year, CAST(mo AS INT) AS month,
 CASE WHEN cat_i % 3 = 0 THEN upper(cat) ELSE cat END AS category,
 CAST(CASE WHEN (mi + cat_i) % 31 = 0 THEN 0 ELSE 400000 + ((mi*7 + cat_i*13) % 50) * 40000 END
   AS DECIMAL(18,2)) AS budget
FROM x WHERE (mi + cat_i) % 5 <> 0"""

MORTGAGE = """
WITH n AS (SELECT CAST(l_orderkey % 120 AS INT) AS i, CAST(sum(l_partkey % 1000) % 5000 AS INT) AS q
  FROM lineitem GROUP BY CAST(l_orderkey % 120 AS INT)),
x AS (SELECT i, q, make_date(1996 + CAST(floor(i/12.0) AS INT), i % 12 + 1, 15) AS due_date FROM n)
SELECT 'Unit 0' AS property_id, i < 66 AS paid, due_date, i + 1 AS installment_no,
 CAST(120000 + q AS DECIMAL(18,2)) AS installment, CAST(300 + q AS DECIMAL(18,2)) AS property_insurance,
 CAST(150 AS DECIMAL(18,2)) AS life_insurance,
 CAST(CASE WHEN i % 4 = 0 THEN NULL ELSE 20000 + q END AS DECIMAL(18,2)) AS rental_income,
 CAST(CASE WHEN i % 6 = 0 THEN 50000 + q ELSE 0 END AS DECIMAL(18,2)) AS extra_principal,
 CAST(40000 + i*500 + q AS DECIMAL(18,2)) AS principal,
 CAST(40000 + i*500 + q + CASE WHEN i % 6 = 0 THEN 50000 + q ELSE 0 END AS DECIMAL(18,2)) AS principal_total,
 CAST(80000 - i*500 AS DECIMAL(18,2)) AS interest FROM x"""

# Schedule columns the fixture does not fill.
UNFILLED = (
    "days", "opening_balance", "insurance_pct", "own_budget", "extra_principal_taken", "principal_pct",
    "interest_pct", "total_paid", "closing_balance", "new_installment", "comment",
)

# The dictionary in use; 'Zz/' stays out of it.
KEYS = """
SELECT * FROM (VALUES ('1', 'Companion', 'C/', 'first', 'who shared it', 'split', '2024-05-01'),
  ('2', 'Property', 'Inm/', 'first', 'which unit', 'split', '2024-05-01'),
  ('three', 'Medical', 'Med/', 'first', 'medical spend', 'split', 'soon'))
AS t(number, name, tag, position, description, pandas_function, introduced_on)"""

LOADED_AT = "2002-01-01 00:00:00"
CREATED_AT = "2001-12-31 00:00:00"
RELOADED_AT = "2002-02-01 00:00:00"
WITHDRAWN_AT = "2002-03-01 00:00:00"
WITHDRAWN_MONTH, CUT_MONTH = 200110, 200112


def run_sql(spark: SparkSession, sf_dir: str, text: str, spread: Callable[[DataFrame], DataFrame] = lambda lines: lines) -> DataFrame:
    lineitem = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


def _utc(text: str):
    return F.lit(text).cast("timestamp")


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None],
) -> DataFrame:
    """A table written once per application into the shared folder, then read like any stored table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        write(build(), path)
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def _spread(lineitem: DataFrame) -> DataFrame:
    """Spread by size: the source table may be one file that only one task can read. The numbers that the ledger is
    derived from travel, not its texts, which are several times as long; by a hash, so that no task sorts what it read."""
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return lineitem.select(*names).hint("rebalance", *names[:2])


def _write_feed(lines: DataFrame, path: str) -> None:
    spark = lines.sparkSession
    limit = "spark.sql.codegen.hugeMethodLimit"
    default = spark.conf.get(limit)
    # The derivation compiles to one method too long for the JIT; below this limit Spark splits it.
    spark.conf.set(limit, "8000")
    try:
        parquet_writer(lines).parquet(path)
    finally:
        spark.conf.set(limit, default)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ledger lines with the file columns a CSV scan provides."""
    lines = stored(spark, sf_dir, "feed", lambda: run_sql(spark, sf_dir, LEDGER, _spread), _write_feed)
    return lines.select(
        "*",
        F.col("amount_txn").alias("amount_native"),
        F.lit(None).cast("bigint").alias("file_size"),
        _utc(CREATED_AT).alias("file_created_at"),
        _utc(LOADED_AT).alias("load_ts"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file of the feed; the size is its number of lines."""
    files = feed(spark, sf_dir).groupBy(F.col("src_file").alias("uri"))
    return files.agg(F.count(F.lit(1)).alias("file_size")).select(
        "uri", "file_size", _utc(CREATED_AT).alias("file_created_at"), _utc(LOADED_AT).alias("load_ts")
    )


def keys(spark: SparkSession) -> DataFrame:
    return key_dictionary(spark.sql(KEYS))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_table(run_sql(spark, sf_dir, BUDGET))


def mortgage(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = run_sql(spark, sf_dir, MORTGAGE)
    return mortgage_table(filled.select("*", *(F.lit(None).alias(name) for name in UNFILLED)))


def first_batch(staged: DataFrame) -> DataFrame:
    """Everything up to 2000-12; income of the last two months had not been booked yet."""
    lines = staged.filter(F.col("month_id") <= 200012)
    return lines.filter(~(F.col("month_id").isin(200011, 200012) & (F.col("flow") == "Income")))


def second_batch(staged: DataFrame) -> DataFrame:
    """From 2000-11 on, loaded a month later; outgoing transfers of the re-issued months were withdrawn."""
    lines = staged.filter(F.col("month_id") >= 200011)
    lines = lines.filter(~(F.col("month_id").isin(200011, 200012) & (F.col("flow") == "Transfer out")))
    return lines.withColumn("load_ts", _utc(RELOADED_AT))


def after_second_batch(staged: DataFrame) -> DataFrame:
    """What the exports hold when the second batch has arrived: older files as they were, newer ones re-issued."""
    older = staged.filter(F.col("month_id") < 200011)
    return older.unionByName(second_batch(staged))


STRAY_MONTH, STRAY_FILE = 199805, "feed_0011.csv"


def with_strays(exports: DataFrame) -> DataFrame:
    """Some lines of an old month come again in a new file that is named for another month."""
    stray = (F.col("month_id") == STRAY_MONTH) & (F.col("category") == "Food") & F.col("txn_id").isNotNull()
    again = {"src_file": F.lit(STRAY_FILE), "load_ts": _utc(RELOADED_AT)}
    return exports.withColumns({name: F.when(stray, value).otherwise(F.col(name)) for name, value in again.items()})


def after_third_batch(staged: DataFrame) -> DataFrame:
    """The exports a month later: one month was withdrawn whole, another came again without its income and with a
    column that older exports lack."""
    older = after_second_batch(staged).filter(~F.col("month_id").isin(WITHDRAWN_MONTH, CUT_MONTH))
    again = staged.filter((F.col("month_id") == CUT_MONTH) & (F.col("flow") != "Income"))
    again = again.withColumn("load_ts", _utc(WITHDRAWN_AT)).withColumn("channel", F.lit("app"))
    return older.withColumn("channel", F.lit(None).cast("string")).unionByName(again)


REISSUING = ("Card", "Checking")


def reissued_by_owners(staged: DataFrame) -> DataFrame:
    """What arrives if two accounts, each a ledger of its own, load the second batch and the others do not."""
    return after_second_batch(staged).filter(F.col("account").isin(*REISSUING))
