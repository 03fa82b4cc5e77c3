"""One registered query per operator, each over the whole fixture ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook import inputs
from casebook.policy import DEMO
from casebook.session import use_own_shared_folder_if_unset
from tallyhouse.functions.calendar import MONTH_ID, date_range, month_id
from tallyhouse.functions.text import worked_days
from tallyhouse.operators import cashflow, checks, ledger, marts, matrices, mortgage, wealth
from tallyhouse.operators.lookups import lookup_join
from tallyhouse.plans import load, owners
from tallyhouse.plans.warehouse import Warehouse
from tallyhouse.sources import feed as feeds
from tallyhouse.sources import sinks
from tallyhouse.streaming.arrivals import load_arrivals

Query = Callable[[SparkSession, str], DataFrame]

RANGE = (date(1998, 1, 1), date(2000, 12, 31))
# Both bounds inside a month.
DAYS = (date(1998, 1, 15), date(2000, 6, 10))
OWNER = ("owner",)


def present(df: DataFrame) -> DataFrame:
    """Results in the types both engines print alike: doubles, 64-bit integers, texts."""

    def plain(field: T.StructField):
        column = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            column = F.round(column.cast("double"), 4 if kind.scale <= 4 else 6)
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, 4)
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*(plain(field) for field in df.schema))


# Tables the queries start from. The money lines are loaded once, everything else is only planned.


def staged(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.stage_transactions(inputs.feed(spark, sf))


def staged_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines for loads that store them: a month's lines together."""
    return ledger.stage_transactions(inputs.feed(spark, sf), by_month=True)


def built_fact(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fact_transactions(staged(spark, sf), inputs.keys(spark), DEMO)


def fact(spark: SparkSession, sf: str) -> DataFrame:
    """Money lines as the load leaves them: a stored table in month directories."""
    return inputs.stored(spark, sf, "fact", lambda: built_fact(spark, sf), sinks.write_months)


def personal(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fact_personal(staged(spark, sf), inputs.keys(spark), DEMO)


def owned(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines as many ledgers, one per account."""
    return fact(spark, sf).withColumn("owner", F.col("account"))


def life(spark: SparkSession, sf: str) -> DataFrame:
    lines = fact(spark, sf)
    return marts.life_cost(lines, marts.hourly_pay(lines, DEMO), DEMO)


def compliance(spark: SparkSession, sf: str) -> DataFrame:
    return marts.budget_compliance(fact(spark, sf), inputs.budget(spark, sf), DEMO)


def income(spark: SparkSession, sf: str) -> DataFrame:
    return marts.income_summary(fact(spark, sf), DEMO)


def share(spark: SparkSession, sf: str) -> DataFrame:
    return marts.tagged_share(fact(spark, sf), DEMO)


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return marts.investment_plan(fact(spark, sf), inputs.budget(spark, sf), inputs.mortgage(spark, sf), DEMO)


# Sources and sinks. Sinks write below the shared folder and read back.


def s1_read_feed(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "feed")
    names = feeds.schemas.FEED.names
    inputs.feed(spark, sf).select(*names).write.option("header", True).csv(path)
    lines = feeds.read_feed(spark, path)
    return lines.select(*names, F.col("src_file").endswith(".csv").alias("from_csv"))


def s1_read_feed_reordered(spark: SparkSession, sf: str) -> DataFrame:
    """Exports whose columns stand in another order, in a folder with a blank in its name, joined with its listing."""
    path = f"{sinks.scratch_path(spark, 'feed')}/my exports"
    names = feeds.schemas.FEED.names
    inputs.feed(spark, sf).select(*reversed(names)).write.option("header", True).csv(path)
    files = feeds.read_file_catalog(spark, path, listing=True).select(F.col("uri").alias("src_file"), F.lit(True).alias("listed"))
    # A listing is short; lines joined with it by shuffle would meet by file, a whole file in one task.
    lines = lookup_join(feeds.read_feed(spark, path), files, ["src_file"], F.struct("occurred_at", "amount_main", "comment"))
    return lines.select(*names, F.col("listed").alias("from_csv"))


def s1_read_feed_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Exports of three kinds in one folder: in order, in reverse, and without a currency."""
    path = sinks.scratch_path(spark, "feed")
    names = feeds.schemas.FEED.names
    lines = inputs.feed(spark, sf)
    for kind, header in enumerate((names, names[::-1], [name for name in names if name != "currency"])):
        own = lines.filter(F.coalesce(F.month("occurred_at"), F.lit(0)) % 3 == kind).select(*header)
        own.write.mode("append").option("header", True).csv(path)
    lines = feeds.read_feed(spark, path, mixed=True, optional=("currency",))
    return lines.select(*names, F.col("src_file").endswith(".csv").alias("from_csv"))


def d8_check_readable(spark: SparkSession, sf: str) -> DataFrame:
    """Exports in which the amount of every refund was spoilt."""
    path = sinks.scratch_path(spark, "feed")
    lines = inputs.feed(spark, sf).select(*(F.col(name).cast("string") for name in feeds.schemas.FEED.names))
    amount = F.when(F.col("category") == DEMO.refunds, F.concat("amount_main", F.lit("?"))).otherwise(F.col("amount_main"))
    lines.withColumn("amount_main", amount).write.option("header", True).csv(path)
    bad = checks.check_readable(feeds.read_feed(spark, path))
    return bad.groupBy("check").agg(F.count("detail").alias("lines"))


def s2_read_file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "catalog")
    inputs.catalog(spark, sf).select(
        "uri",
        F.unix_micros("file_created_at").alias("generation"),
        F.col("file_size").alias("size"),
        F.col("load_ts").alias("updated"),
    ).write.parquet(path)
    return feeds.read_file_catalog(spark, path)


def s3_key_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary with the number of ledger comments that use each tag."""
    lines = staged(spark, sf).withColumn("tag", F.get(F.split("comment", " "), F.lit(0)))
    uses = lines.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
    known = inputs.keys(spark).drop("load_ts")
    return uses.join(F.broadcast(known), "tag").select(*known.columns, "uses")


def s6_overwrite_table(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "table")
    sinks.overwrite_table(inputs.budget(spark, sf).filter(F.col("budget") > 0), path)
    return sinks.overwrite_table(inputs.budget(spark, sf), path)


def s7_month_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "months")
    sinks.write_months(staged(spark, sf), path)
    months = spark.read.parquet(path).groupBy(MONTH_ID)
    return months.agg(F.count(F.lit(1)).alias("lines"), F.sum("amount_main").cast("decimal(24,4)").alias("amount"))


# Loads.


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The stored table after the first batch, and the exports after the second."""
    lines = staged(spark, sf)
    return inputs.first_batch(lines), inputs.after_second_batch(lines)


def _batch_catalog(source: DataFrame) -> DataFrame:
    return source.groupBy(F.col("src_file").alias("uri")).agg(F.max("load_ts").alias("load_ts"))


def l1_touched_months(spark: SparkSession, sf: str) -> DataFrame:
    return load.touched_months(_batches(spark, sf)[1])


def l2_touched_months_from_files(spark: SparkSession, sf: str) -> DataFrame:
    return load.touched_months_from_files(_batch_catalog(_batches(spark, sf)[1]))


def l3_drop_months(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    return load.drop_months(target, load.touched_months(source))


def l4_newer_than(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    return load.newer_than(source, load.drop_months(target, load.touched_months(source)))


def l5_newer_than_month(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    return load.newer_than_month(source, target)


def l6_merge_by_key(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    return load.merge_by_key(target, load.newer_than(source, target), "txn_id")


def l7_overwrite_months(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "overwrite")
    target, source = _batches(spark, sf)
    sinks.write_months(target, path)
    sinks.overwrite_months(load.newer_than(source, target), path)
    return spark.read.parquet(path).select(*target.columns)


def l8_append_columns(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    updates = load.newer_than(source, target).withColumn("channel", F.lit("app"))
    return load.append_columns(target, updates)


def l9_load_month_batch(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "load")
    target, source = _batches(spark, sf)
    load.load_month_batch(spark, path, target)
    load.load_month_batch(spark, path, source, load.touched_months_from_files(_batch_catalog(source)))
    return spark.read.parquet(path).select(*target.columns)


def l9_repeated_load(spark: SparkSession, sf: str) -> DataFrame:
    """A load and its repetition, by months. One of the new files holds lines of a month that it is not named for."""
    path = sinks.scratch_path(spark, "load")
    target, source = _batches(spark, sf)
    load.load_month_batch(spark, path, target)
    source = inputs.with_strays(source)
    months = load.touched_months_from_files(_batch_catalog(source))
    for _ in range(2):
        load.load_month_batch(spark, path, source, months)
    return sinks.read_table(spark, path).select(*target.columns)


def l9_load_owner_months(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger for each account in one table: two of them load the second batch, twice; the others keep the first."""
    path = sinks.scratch_path(spark, "owners")
    target, _ = _batches(spark, sf)
    owners.load_owner_months(spark, path, target, "account", buckets=2)
    source = inputs.reissued_by_owners(staged(spark, sf))
    for _ in range(2):
        owners.load_owner_months(spark, path, source, "account")
    return sinks.read_table(spark, path).select(*target.columns)


def l9_month_batch(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _batches(spark, sf)
    return load.month_batch(target, source, load.touched_months(source), "txn_id")


# Three loads through the warehouse. The marts are refreshed after the first and the third; the second is skipped.

_houses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _houses:
        house = Warehouse(spark, sinks.scratch_path(spark, "warehouse"), DEMO)
        house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
        lines = staged_by_month(spark, sf)
        house.load_lines(inputs.first_batch(lines), placed=True)
        house.load_marts()
        house.load_lines(inputs.after_second_batch(lines), placed=True)
        months = spark.createDataFrame([(inputs.WITHDRAWN_MONTH,), (inputs.CUT_MONTH,)], f"{MONTH_ID} int")
        house.load_lines(inputs.after_third_batch(lines), months, placed=True)
        house.load_marts()
        _houses[key] = house
    return _houses[key]


_ledger_houses: dict[tuple[str, str], owners.LedgerHouse] = {}


def ledger_house(spark: SparkSession, sf: str) -> owners.LedgerHouse:
    """A ledger for each account: a first batch of all, then the newer months of two accounts, then those of the others.
    What is loaded last holds all lines."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ledger_houses:
        house = owners.LedgerHouse(spark, sinks.scratch_path(spark, "ledgers"), DEMO, buckets=2)
        lines = staged(spark, sf).withColumn("owner", F.col("account"))
        budget = inputs.budget(spark, sf).withColumn("owner", F.lit(inputs.REISSUING[0]))
        house.load_reference(inputs.keys(spark), budget)
        house.load_lines(inputs.first_batch(lines))
        first = F.coalesce(F.col("owner").isin(*inputs.REISSUING), F.lit(False))
        for part in (lines.filter(first), lines.filter(~first)):
            house.load_lines(part, part.filter(F.col(MONTH_ID) >= 200011).select("owner", MONTH_ID).distinct())
        _ledger_houses[key] = house
    return _ledger_houses[key]


def w_retagged(spark: SparkSession, sf: str) -> DataFrame:
    """Money lines after the dictionary lost one word and gained another between the loads of lines and of marts."""
    house = Warehouse(spark, sinks.scratch_path(spark, "warehouse"), DEMO)
    keys, budget, mortgage = inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf)
    before = keys.filter("tag <> 'Med/'").union(keys.limit(1).withColumn("tag", F.lit("Zz/")))
    house.load_reference(before, budget, mortgage)
    house.load_lines(staged_by_month(spark, sf), placed=True)
    house.load_reference(keys, budget, mortgage)
    house.load_marts()
    return house.table("fact_transactions")


def w_stream(spark: SparkSession, sf: str, max_files: int | None = None) -> DataFrame:
    """The whole feed as arriving CSV files that share months."""
    exports, path, checkpoint = (sinks.scratch_path(spark, name) for name in ("exports", "arrived", "progress"))
    lines = inputs.feed(spark, sf).select(*feeds.schemas.FEED.names)
    # Files taken one by one each touch every month, so they stay few; else they follow the size of the feed.
    parts = lines.rdd.getNumPartitions()
    files = 3 if max_files else max(3, parts)
    # Tasks write what they read. Lines travel only where tasks are fewer than files.
    dealt = lines.repartition(files) if parts < files else lines.coalesce(files)
    dealt.write.option("header", True).csv(exports)
    stream = feeds.stream_feed(spark, exports, max_files=max_files)
    load_arrivals(stream, path, checkpoint).awaitTermination()
    return sinks.read_table(spark, path).drop("src_file", "load_ts", "file_created_at", "file_size")


# Silver.


def t1_stage_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.stage_transactions(inputs.feed(spark, sf), inputs.catalog(spark, sf))


def t4_parse_tag(spark: SparkSession, sf: str) -> DataFrame:
    tagged = ledger.parse_tag(staged(spark, sf), inputs.keys(spark), DEMO)
    counts = tagged.groupBy("comment", "tag", "tag_value")
    return counts.agg(F.count(F.lit(1)).alias("lines"))


def t5_worked_days(spark: SparkSession, sf: str) -> DataFrame:
    comments = staged(spark, sf).groupBy("comment").agg(F.count(F.lit(1)).alias("lines"))
    return comments.withColumn("worked_days", worked_days(F.col("comment")))


# Many ledgers in one table.


def g1_hourly_pay_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    return marts.hourly_pay(owned(spark, sf), DEMO, OWNER)


def g2_life_cost_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    lines = owned(spark, sf)
    return marts.life_cost(lines, marts.hourly_pay(lines, DEMO, OWNER), DEMO, OWNER)


def g2_life_cost_by_owner_salted(spark: SparkSession, sf: str) -> DataFrame:
    """The same with no lookup counted as small, so that lines are joined by shuffle and hot cells are spread."""
    lines = owned(spark, sf)
    return marts.life_cost(lines, marts.hourly_pay(lines, DEMO, OWNER), DEMO, OWNER, max_rows=0)


# Checks.


def d1_check_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Months are no unique key of lines, so the check reports every month that repeats, next to repeated ids."""
    lines = staged(spark, sf)
    return checks.check_unique(lines, "txn_id").unionByName(checks.check_unique(lines, "month_id", "category"))


def d7_check_range(spark: SparkSession, sf: str) -> DataFrame:
    lines = fact(spark, sf)
    rates = checks.check_range(lines, "fx_rate", 2.5, 5.0, "txn_id")
    days = checks.check_range(marts.hourly_pay(lines, DEMO), "worked_days", None, 31, "year")
    shares = checks.check_range(marts.tagged_share(lines, DEMO), "tracked_share", None, 1, "month_start")
    costs = checks.check_range(life(spark, sf), "cost_hours", None, 300, "txn_id")
    rows = rates.unionByName(days).unionByName(shares).unionByName(costs)
    return rows.withColumn("detail", F.round(F.col("detail").cast("double"), 4))


def d6_check_freshness(spark: SparkSession, sf: str) -> DataFrame:
    as_of = datetime(2002, 1, 1, 12)
    lines = checks.check_freshness(staged(spark, sf), "txn_time", as_of, warn_after=timedelta(days=30))
    files = checks.check_freshness(inputs.catalog(spark, sf), "file_created_at", as_of, error_after=timedelta(hours=24))
    return lines.unionByName(files)


def _table() -> dict[str, Query]:
    from_fact = {
        "g1_hourly_pay": lambda f: marts.hourly_pay(f, DEMO),
        "g4_income_summary": lambda f: marts.income_summary(f, DEMO),
        "g5_tagged_share": lambda f: marts.tagged_share(f, DEMO),
        "g6_tag_ledger": lambda f: marts.tag_ledger(f, DEMO.property_tag, DEMO.property_hidden_categories),
        "q1_last_update": cashflow.last_update,
        "q2_cash_flow": lambda f: cashflow.cash_flow(f, DEMO),
        "q2_cash_flow_daily": lambda f: cashflow.cash_flow(f, DEMO, grain="day"),
        "q2_cash_flow_by_owner": lambda f: cashflow.cash_flow(f.withColumn("owner", F.col("account")), DEMO, keys=OWNER),
        "q3_spend_by_category": lambda f: cashflow.spend_by_category(f, DEMO),
        "q4_quarter_balance": lambda f: cashflow.quarter_balance(f, DEMO),
        "q5_top_expenses": lambda f: cashflow.top_expenses(f, DEMO),
        "q5_top_expenses_by_owner": lambda f: cashflow.top_expenses(
            f.withColumn("owner", F.col("account")), DEMO, keys=OWNER
        ),
        "q14_essential_split": lambda f: cashflow.essential_split(f, DEMO),
        "q16_passive_income": lambda f: cashflow.passive_income(f, DEMO),
        "q17_financial_freedom": lambda f: cashflow.financial_freedom(f, DEMO),
        "q18_latest_coverage": lambda f: cashflow.latest_coverage(f, DEMO),
        "q19_top_income": lambda f: cashflow.top_income(f, DEMO),
        "q20_income_by_category": lambda f: cashflow.income_by_category(f, DEMO),
        "q28_habit_matrix": lambda f: matrices.habit_matrix(f, DEMO),
        "q29_tagged_kpis": lambda f: matrices.tagged_kpis(f, marts.tagged_share(f, DEMO), DEMO),
        "q31_tagged_top": lambda f: matrices.tagged_top(f, DEMO),
        "q32_tagged_by_category": lambda f: matrices.tagged_by_category(f, DEMO),
        "q33_shared_spend": lambda f: matrices.shared_spend(f, DEMO),
        "q34_date_range": lambda f: date_range(f, RANGE).select(
            "txn_id", "txn_time", "account", "category", "amount_main"
        ),
        "d4_check_net_le_gross": lambda f: checks.check_net_le_gross(marts.hourly_pay(f, DEMO)),
        "d5_check_value_for_tag": checks.check_value_for_tag,
        "d5_check_worked_days": checks.check_worked_days,
    }
    from_life = {
        "g2_life_cost": lambda v: v.drop(MONTH_ID),
        "q25_life_cost_kpis": lambda v: matrices.life_cost_kpis(v, DEMO),
        "q26_life_cost_details": lambda v: matrices.life_cost_details(v, "Food", DEMO),
        "q26_life_cost_details_tracked": lambda v: matrices.life_cost_details(v, DEMO.tracked, DEMO),
        "q27_life_cost_matrix": lambda v: matrices.life_cost_matrix(v, DEMO),
    }
    from_mortgage = {
        "s5_mortgage_table": lambda m: m,
        "q22_mortgage_breakdown": mortgage.mortgage_breakdown,
        "q23_mortgage_equity": mortgage.mortgage_equity,
        "q24_mortgage_prepayments": mortgage.mortgage_prepayments,
    }
    table: dict[str, Query] = {
        "s1_read_feed": s1_read_feed,
        "s2_read_file_catalog": s2_read_file_catalog,
        "s3_key_dictionary": s3_key_dictionary,
        "s4_budget_table": inputs.budget,
        "s6_overwrite_table": s6_overwrite_table,
        "s7_month_partitions": s7_month_partitions,
        "l1_touched_months": l1_touched_months,
        "l2_touched_months_from_files": l2_touched_months_from_files,
        "l3_drop_months": l3_drop_months,
        "l4_newer_than": l4_newer_than,
        "l5_newer_than_month": l5_newer_than_month,
        "l6_merge_by_key": l6_merge_by_key,
        "l7_overwrite_months": l7_overwrite_months,
        "l8_append_columns": l8_append_columns,
        "l9_month_batch": l9_month_batch,
        "l9_load_month_batch": l9_load_month_batch,
        "s1_read_feed_reordered": s1_read_feed_reordered,
        "s1_read_feed_mixed": s1_read_feed_mixed,
        "l9_repeated_load": l9_repeated_load,
        "l9_load_owner_months": l9_load_owner_months,
        "w_retagged": w_retagged,
        "d8_check_readable": d8_check_readable,
        "w_stg_transactions": lambda s, d: warehouse(s, d).table("stg_transactions"),
        "w_fact_transactions": lambda s, d: warehouse(s, d).table("fact_transactions"),
        "w_fact_personal": lambda s, d: warehouse(s, d).table("fact_personal"),
        "w_hourly_pay": lambda s, d: warehouse(s, d).table("hourly_pay").drop(MONTH_ID),
        "w_life_cost": lambda s, d: warehouse(s, d).table("life_cost").drop(MONTH_ID),
        "w_budget_compliance": lambda s, d: warehouse(s, d).table("budget_compliance").drop(MONTH_ID),
        "w_tagged_share": lambda s, d: warehouse(s, d).table("tagged_share").drop(MONTH_ID),
        "w_property_ledger": lambda s, d: warehouse(s, d).table("property_ledger"),
        "w_income_summary": lambda s, d: warehouse(s, d).income_summary(),
        "w_checks": lambda s, d: warehouse(s, d).checks(as_of=datetime(2002, 3, 1)),
        "w_owners_hourly_pay": lambda s, d: ledger_house(s, d).table("hourly_pay").drop(MONTH_ID),
        "w_owners_life_cost": lambda s, d: ledger_house(s, d).life_cost(),
        "w_owners_cash_flow": lambda s, d: cashflow.cash_flow(ledger_house(s, d).sums(), DEMO, keys=OWNER),
        "w_owners_top_expenses": lambda s, d: cashflow.top_expenses(ledger_house(s, d).largest(), DEMO, keys=OWNER),
        "w_owners_transactions": lambda s, d: ledger_house(s, d).table("fact_transactions").drop("owner"),
        "w_stream": w_stream,
        "w_stream_by_file": lambda s, d: w_stream(s, d, max_files=1),
        "t1_stage_transactions": t1_stage_transactions,
        "t2_fact_transactions": built_fact,
        "t3_fact_personal": personal,
        "t4_parse_tag": t4_parse_tag,
        "t5_worked_days": t5_worked_days,
        "g1_hourly_pay_by_owner": g1_hourly_pay_by_owner,
        "g2_life_cost_by_owner": g2_life_cost_by_owner,
        "g2_life_cost_by_owner_salted": g2_life_cost_by_owner_salted,
        "g3_budget_compliance": compliance,
        "g7_investment_plan": plan,
        "g8_investment_tracking": lambda s, d: marts.investment_tracking(fact(s, d), plan(s, d), DEMO),
        "g8_investment_tracking_daily": lambda s, d: marts.investment_tracking(
            fact(s, d), plan(s, d), DEMO, every_day=True
        ),
        "q6_budget_report": lambda s, d: cashflow.budget_report(compliance(s, d)),
        "q6_budget_report_filtered": lambda s, d: cashflow.budget_report(
            compliance(s, d), years=[1999, 2000], months=[1, 2, 3], categories=["Food", "FOOD", "Bills", "Salary"]
        ),
        "q7_survival_cost": lambda s, d: wealth.survival_cost(inputs.budget(s, d), DEMO),
        "q8_median_net_income": lambda s, d: wealth.median_net_income(income(s, d)),
        "q9_wealth_rates": lambda s, d: wealth.wealth_rates(fact(s, d), inputs.mortgage(s, d), DEMO),
        "q10_debt_to_income": lambda s, d: wealth.debt_to_income(inputs.budget(s, d), income(s, d), DEMO),
        "q11_growth_kpis": lambda s, d: wealth.growth_kpis(
            fact(s, d), inputs.budget(s, d), inputs.mortgage(s, d), income(s, d), DEMO
        ),
        "q11_growth_kpis_ranged": lambda s, d: wealth.growth_kpis(
            fact(s, d), inputs.budget(s, d), inputs.mortgage(s, d), income(s, d), DEMO, RANGE
        ),
        "q12_net_worth": lambda s, d: wealth.net_worth(fact(s, d), inputs.mortgage(s, d), DEMO),
        "q13_net_worth_snapshot": lambda s, d: wealth.net_worth_snapshot(
            wealth.net_worth(fact(s, d), inputs.mortgage(s, d), DEMO)
        ),
        "q15_net_income_series": lambda s, d: cashflow.net_income_series(income(s, d)),
        "q21_mortgage_kpis": lambda s, d: mortgage.mortgage_kpis(inputs.mortgage(s, d), fact(s, d), DEMO),
        "q30_tagged_trend": lambda s, d: matrices.tagged_trend(share(s, d)),
        "d1_check_unique": d1_check_unique,
        "d2_check_not_null": lambda s, d: checks.check_not_null(staged(s, d), "txn_id", "src_file"),
        "d3_check_relationship": lambda s, d: checks.check_relationship(
            staged(s, d).withColumn("word", F.get(F.split("comment", " "), F.lit(0))), "word", inputs.keys(s), "tag"
        ),
        "d6_check_freshness": d6_check_freshness,
        "d7_check_range": d7_check_range,
    }
    from_sums = {
        "w_cash_flow": lambda h: cashflow.cash_flow(h.sums(), DEMO),
        "w_cash_flow_days": lambda h: cashflow.cash_flow(h.sums(DAYS), DEMO, DAYS),
        "w_spend_by_category_days": lambda h: cashflow.spend_by_category(h.sums(DAYS), DEMO, DAYS),
        "w_income_by_category_days": lambda h: cashflow.income_by_category(h.sums(DAYS), DEMO, DAYS),
        "w_quarter_balance_days": lambda h: cashflow.quarter_balance(h.sums(DAYS), DEMO, DAYS),
        "w_essential_split_days": lambda h: cashflow.essential_split(h.sums(DAYS), DEMO, DAYS),
        "w_passive_income": lambda h: cashflow.passive_income(h.sums(), DEMO),
        "w_financial_freedom": lambda h: cashflow.financial_freedom(h.sums(), DEMO),
        "w_latest_coverage": lambda h: cashflow.latest_coverage(h.sums(), DEMO),
        "w_wealth_rates": lambda h: wealth.wealth_rates(h.sums(), h.table("mortgage"), DEMO),
        "w_net_worth": lambda h: wealth.net_worth(h.sums(), h.table("mortgage"), DEMO),
        "w_net_worth_months": lambda h: h.net_worth(RANGE),
        "w_passive_income_months": lambda h: h.passive_income(RANGE),
        "w_top_expenses_days": lambda h: cashflow.top_expenses(h.largest(DAYS), DEMO, DAYS),
        "w_top_expenses_food": lambda h: cashflow.top_expenses(h.largest(), DEMO, category="Food"),
        "w_top_income_days": lambda h: cashflow.top_income(h.largest(DAYS), DEMO, DAYS),
        "w_tagged_top_days": lambda h: matrices.tagged_top(h.largest(DAYS), DEMO, DAYS),
    }
    for name, build in from_sums.items():
        table[name] = lambda s, d, build=build: build(warehouse(s, d))
    for name, build in from_fact.items():
        table[name] = lambda s, d, build=build: build(fact(s, d))
    for name, build in from_life.items():
        table[name] = lambda s, d, build=build: build(life(s, d))
    for name, build in from_mortgage.items():
        table[name] = lambda s, d, build=build: build(inputs.mortgage(s, d))
    return table


def _registered(build: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_own_shared_folder_if_unset(spark)
        return present(build(spark, sf_dir))

    return query


def queries() -> dict[str, Query]:
    return {name: _registered(build) for name, build in sorted(_table().items())}
