import os
from datetime import datetime

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from casebook import inputs
from casebook.queries import queries, staged as fixture_staged
from tallyhouse import schemas
from tallyhouse.operators import checks, ledger
from tallyhouse.plans import load
from tallyhouse.plans.warehouse import Warehouse
from casebook.policy import DEMO
from tallyhouse.sources import feed as feeds
from tallyhouse.sources import reference, sinks
from tallyhouse.streaming import arrivals
from tallyhouse.streaming.arrivals import load_arrivals
from tests.rows import line, staged, values

MAY, JUNE, JULY = ("2001-05-10 08:00:00", "2001-06-10 08:00:00", "2001-07-10 08:00:00")


def same(left, right):
    columns = sorted(right.columns)
    left, right = left.select(*columns), right.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_two_batches_and_a_rerun(spark, sf, tmp_path):
    path = str(tmp_path / "stg")
    lines = fixture_staged(spark, sf)
    load.load_month_batch(spark, path, inputs.first_batch(lines))
    assert same(spark.read.parquet(path), inputs.first_batch(lines))
    exports = inputs.after_second_batch(lines)
    for _ in range(2):
        load.load_month_batch(spark, path, exports)
        assert same(spark.read.parquet(path), exports)
    # Untouched months keep their files.
    wider = exports.withColumn("channel", F.lit("app")).filter(F.col("month_id") >= 200110)
    wider = wider.withColumn("load_ts", F.lit("2002-03-01").cast("timestamp"))
    load.load_month_batch(spark, path, wider)
    table = sinks.read_table(spark, path)
    assert table.count() == exports.count()
    assert table.filter("channel = 'app'").count() == wider.count()
    assert table.filter("month_id < 200110 AND channel IS NULL").count() == exports.filter("month_id < 200110").count()


def test_only_changed_months_are_written(spark, tmp_path):
    path = tmp_path / "stg"
    load.load_month_batch(spark, str(path), staged(spark, line(when=MAY), line(when=JUNE)))
    before = {file.name for file in (path / "month_id=200105").iterdir()}
    load.load_month_batch(spark, str(path), staged(spark, line(when=JUNE, loaded="2002-02-01", amount="7")))
    assert {file.name for file in (path / "month_id=200105").iterdir()} == before
    assert values(spark.read.parquet(str(path)), "month_id", "amount_main") == [(200105, 10), (200106, 7)]


def test_a_month_without_lines_is_emptied(spark, tmp_path):
    path = str(tmp_path / "stg")
    load.load_month_batch(spark, path, staged(spark, line(when=MAY), line(when=JUNE)))
    months = spark.createDataFrame([(200106,)], "month_id int")
    load.load_month_batch(spark, path, staged(spark, line(when=JULY, loaded="2002-02-01")), months)
    assert values(spark.read.parquet(path), "month_id") == [(200105,), (200107,)]


def test_emptied_target_takes_everything(spark, tmp_path):
    path = str(tmp_path / "stg")
    lines = staged(spark, line(when=MAY))
    for _ in range(2):
        load.load_month_batch(spark, path, lines)
        assert spark.read.parquet(path).count() == 1
    assert load.newer_than(lines, lines.limit(0)).count() == 1


def test_skipped_load_is_merged_unless_all_pending(spark, tmp_path):
    old = staged(spark, line(when=MAY, amount="1"), line(when=JUNE))
    exports = staged(
        spark,
        line(when=MAY, amount="2", loaded="2002-02-01"),
        line(when=JUNE, loaded="2002-03-01"),
    )
    for mode, may in ((load.LATEST, [1, 2]), (load.ALL_PENDING, [2])):
        path = str(tmp_path / mode)
        load.load_month_batch(spark, path, old)
        load.load_month_batch(spark, path, exports, mode=mode)
        table = spark.read.parquet(path)
        assert [row[0] for row in table.filter("month_id = 200105").select("amount_main").sort("amount_main").collect()] == may


def test_stray_lines_of_a_file(spark, tmp_path):
    """A file named for June that also holds a line of May: by file, a rerun restores both."""
    first = staged(spark, line(when=MAY, src_file="x_0105.csv"))
    stray = [line(when=when, src_file="x_0106.csv", loaded="2002-02-01", concept="June file") for when in (MAY, JUNE)]
    exports = first.unionByName(staged(spark, *stray))
    files = spark.createDataFrame([("x_0106.csv",)], "uri string")
    by_file = str(tmp_path / "by_file")
    load.load_month_batch(spark, by_file, first)
    for _ in range(2):
        load.load_month_batch(spark, by_file, exports, files=files)
        assert same(spark.read.parquet(by_file), exports)


def test_merge_updates_and_inserts(spark):
    target = staged(spark, line(concept="a"), line(concept="b"), line(account=None))
    ids = {row.concept: row.txn_id for row in target.collect()}
    updates = target.filter("concept = 'a'").withColumn("currency", F.lit("USD"))
    updates = updates.unionByName(staged(spark, line(concept="c"), line(account=None)))
    merged = load.merge_by_key(target, updates, "txn_id")
    assert merged.count() == 5
    assert values(merged.filter(F.col("txn_id") == ids["a"]), "currency") == [("USD",)]
    assert merged.filter("txn_id IS NULL").count() == 2
    new_twice = staged(spark, line(concept="d"), line(concept="d"))
    assert load.merge_by_key(target, new_twice, "txn_id").count() == 5
    with pytest.raises(SparkRuntimeException, match="several updates"):
        load.merge_by_key(target, updates.unionByName(target.filter("concept = 'a'")), "txn_id").collect()


def test_lines_without_time_survive_loads(spark, tmp_path):
    path = str(tmp_path / "stg")
    load.load_month_batch(spark, path, staged(spark, line(when=None), line(when=MAY)))
    load.load_month_batch(spark, path, staged(spark, line(when=None, loaded="2002-02-01"), line(when=MAY, loaded="2002-02-01")))
    assert values(spark.read.parquet(path), "month_id") == [(200105,), (None,), (None,)]


def _export(folder, name, *lines):
    """One CSV export with its header."""
    header = ",".join(schemas.SPANISH_FEED_COLUMNS)
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


LUNCH = "2001-05-10 08:00:00,Card,Food,,Lunch,C/ Ana,Expense,12.50,12.50,12.50,PEN"
BAD = "2001-05-11 08:00:00,Card,Food,,Bad,,Expense,abc,1,1,PEN"
JUNE_LINE = '2001-06-10 08:00:00,Card,Food,,"Lunch, late","said ""yes""",Expense,7,7,7,PEN'


def test_csv_exports(spark, tmp_path):
    _export(tmp_path, "x_0105.csv", LUNCH, BAD)
    _export(tmp_path, "x_0106.csv", JUNE_LINE)
    lines = feeds.read_feed(spark, str(tmp_path))
    assert lines.columns[:11] == schemas.FEED.names
    got = {row.concept: row for row in lines.collect()}
    assert got["Bad"].amount_main is None and got["Bad"].src_file.endswith("x_0105.csv")
    assert got["Lunch, late"].comment == 'said "yes"'
    catalog = feeds.read_file_catalog(spark, str(tmp_path), listing=True)
    sizes = {row.uri.rsplit("/", 1)[1]: row.file_size for row in catalog.collect()}
    assert sizes == {name: (tmp_path / name).stat().st_size for name in ("x_0105.csv", "x_0106.csv")}
    assert "content" not in catalog._jdf.queryExecution().executedPlan().toString()
    staged_lines = ledger.stage_transactions(lines)
    assert staged_lines.filter("load_ts IS NULL").isEmpty()
    # A load-time literal keeps old files from being read at all.
    newer = staged_lines.filter(F.col("load_ts") > F.lit(datetime(2100, 1, 1)))
    assert newer.rdd.getNumPartitions() == 0


def test_stream_of_exports_equals_the_batch(spark, tmp_path):
    exports, table, checkpoint = (str(tmp_path / name) for name in ("in", "stg", "checkpoint"))
    folder = tmp_path / "in"
    (folder / "first").mkdir(parents=True)
    _export(folder / "first", "x_0105.csv", LUNCH, BAD)
    _export(folder / "first", "x_0106.csv", JUNE_LINE)

    def run():
        stream = feeds.stream_feed(spark, exports, max_files=1, recursiveFileLookup="true")
        load_arrivals(stream, table, checkpoint).awaitTermination()

    run()
    assert values(spark.read.parquet(table), "month_id", "concept") == [
        (200105, "Bad"), (200105, "Lunch"), (200106, "Lunch, late"),
    ]
    (folder / "second").mkdir()
    _export(folder / "second", "x_0105.csv", LUNCH.replace("Lunch", "Dinner"))
    run()
    assert values(spark.read.parquet(table), "month_id", "concept") == [(200105, "Dinner"), (200106, "Lunch, late")]


def test_reference_tables(spark):
    raw = spark.sql(inputs.KEYS)
    got = {row.tag: row for row in reference.key_dictionary(raw).collect()}
    assert got["C/"].number == 1 and got["Med/"].number is None and got["Med/"].introduced_on is None
    spanish = raw.withColumnsRenamed({new: old for old, new in schemas.SPANISH_KEY_COLUMNS.items()})
    assert reference.key_dictionary(spanish, schemas.SPANISH_KEY_COLUMNS).count() == 3
    bad = spark.sql("SELECT '2001-05-01' AS month_start, '2001' AS year, '5' AS month, 'Food' AS category, 'x' AS budget")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        reference.budget_table(bad).collect()
    assert len(schemas.MORTGAGE) == 23


def test_overwriting_a_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_table(spark.range(5).toDF("n"), path)
    assert sinks.overwrite_table(spark.read.parquet(path).filter("n > 2"), path).count() == 2


def test_warehouse(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    lines = fixture_staged(spark, sf)
    for source in (inputs.first_batch(lines), inputs.after_second_batch(lines)):
        house.load_lines(source)
        house.load_marts()
    final = inputs.after_second_batch(lines)
    fact = ledger.fact_transactions(final, inputs.keys(spark), DEMO)
    assert same(house.table("stg_transactions"), final)
    assert same(house.table("fact_transactions"), fact)
    assert same(house.table("fact_personal"), ledger.fact_personal(final, inputs.keys(spark), DEMO))
    from tallyhouse.operators import marts

    assert same(house.table("hourly_pay").drop("month_id"), marts.hourly_pay(fact, DEMO))
    assert same(house.table("tagged_share").drop("month_id"), marts.tagged_share(fact, DEMO))
    assert same(house.table("property_ledger"), marts.tag_ledger(fact, "Inm/", DEMO.property_hidden_categories))
    assert same(house.table("budget_compliance"), marts.budget_compliance(fact, inputs.budget(spark, sf), DEMO))
    assert house.table("life_cost").count() == fact.filter("flow = 'Expense'").count()
    assert house.investment_tracking().count() == house.investment_plan().count()
    assert house.income_summary().count() == fact.select("month_id").distinct().count()


def test_a_hot_month_is_written_by_many_tasks(spark, sf, tmp_path):
    """One month holds most lines; with a small advisory size it becomes several files, and no line is lost."""
    lines = fixture_staged(spark, sf).repartition(4)
    hot = lines.withColumn("month_id", F.when(F.col("month_id") > 199803, 200112).otherwise(F.col("month_id")))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64KB")
    try:
        sinks.write_months(hot, str(tmp_path / "t"))
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "t" / "month_id=200112").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == lines.count()


def test_skipped_marts_withdrawn_months_and_late_columns(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    salary = {"category": "Salary", "flow": "Income", "comment": "20 dias trabajados", "amount": "100"}
    flat = {"category": "Investments", "comment": "Inm/ Unit 0/"}
    house.load_lines(staged(spark, line(when=MAY, **salary)))
    house.load_marts()
    first = staged(spark, line(when=MAY, **salary), line(when=JUNE, loaded="2002-02-01", **salary), line(when=JUNE, loaded="2002-02-01", **flat))
    assert house.load_lines(first.withColumn("channel", F.lit("app"))) == {200106}
    july = first.unionByName(staged(spark, line(when=JULY, loaded="2002-03-01", **salary)))
    house.load_lines(july)
    # Both loads since the last refresh count, and the column that the last export lacks is still there.
    assert house.load_marts() == {200106, 200107}
    assert values(house.table("hourly_pay"), "month") == [(5,), (6,), (7,)]
    assert values(house.table("stg_transactions"), "month_id", "channel") == [
        (200105, None), (200106, "app"), (200106, "app"), (200107, None),
    ]
    assert house.table("property_ledger").count() == 1
    # June is withdrawn: named by its file, without any line.
    june = spark.createDataFrame([(200106,)], "month_id int")
    house.load_lines(july.filter("month_id <> 200106"), june)
    house.load_marts()
    for name in ("stg_transactions", "fact_transactions", "tagged_share", "hourly_pay"):
        assert (200106,) not in values(house.table(name), "month_id"), name
    assert house.table("property_ledger").count() == 0


def test_a_ledger_without_salary_has_empty_marts(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
    house.load_lines(staged(spark, line(when=MAY)))
    house.load_marts()
    assert house.table("hourly_pay").count() == house.table("life_cost").count() == 0
    assert house.checks().count() == 0
    house.load_lines(staged(spark, line(when=JUNE, loaded="2002-02-01"), line(when=JUNE, loaded="2002-02-01")))
    assert {row.check for row in house.checks().collect()} == {"unique:txn_id"}


@pytest.mark.parametrize("max_files", [None, 1, 3])
def test_arrivals_do_not_depend_on_batches(spark, tmp_path, max_files):
    """Two files share May; one of them is issued again in another folder."""
    folder = tmp_path / "in"
    for name in ("first", "second"):
        (folder / name).mkdir(parents=True)
    _export(folder / "first", "a_0105.csv", LUNCH)
    _export(folder / "first", "b_0105.csv", LUNCH.replace("Lunch", "Tea"), JUNE_LINE)
    _export(folder / "second", "a_0105.csv", LUNCH.replace("Lunch", "Dinner"))
    os.utime(folder / "first" / "a_0105.csv", (1, 1))
    table = str(tmp_path / "stg")
    stream = feeds.stream_feed(spark, str(folder), max_files=max_files, recursiveFileLookup="true")
    load_arrivals(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert values(sinks.read_table(spark, table), "concept") == [("Dinner",), ("Lunch, late",), ("Tea",)]


def test_columns_are_found_by_name(spark, tmp_path):
    names = list(schemas.FEED.names)
    (tmp_path / "my book.csv").write_text(",".join(reversed(names)) + "\n" + ",".join(reversed(LUNCH.split(","))) + "\nx,y\n")
    lines = feeds.read_feed(spark, str(tmp_path)).cache()
    assert values(lines.filter("account IS NOT NULL"), "account", "category") == [("Card", "Food")]
    assert [row.detail for row in checks.check_readable(lines).collect()] == ["x,y"]
    files = feeds.read_file_catalog(spark, str(tmp_path), listing=True)
    known = ledger.stage_transactions(lines, files).filter("load_ts IS NOT NULL")
    assert known.count() == lines.count()
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name, header in (("a.csv", names), ("b.csv", reversed(names))):
        (mixed / name).write_text(",".join(header) + "\n" + LUNCH + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        feeds.read_feed(spark, str(mixed)).collect()
    with pytest.raises(ValueError, match="does not name"):
        feeds.read_feed(spark, str(mixed), sep=";")


def test_a_failing_refresh_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_table(spark.range(5).toDF("n"), path)
    broken = spark.read.parquet(path).select(F.raise_error(F.lit("stop")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="stop"):
        sinks.overwrite_table(broken, path)
    assert sinks.read_table(spark, path).count() == 5
    assert [file.name for file in tmp_path.iterdir()] == ["t"]


def test_lines_stay_where_they_are_read_when_they_meet_a_listing(spark, sf):
    """A listing is as long as its files are many, but counts as large as they are: a join by shuffle would put all
    lines of a file into one task."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    default = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = queries()["s1_read_feed_reordered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, default)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_that_arrive_travel_once(spark, sf, tmp_path, monkeypatch):
    """The exports are written by the tasks that read their lines; lines meet by month before their ids are derived."""
    lines = inputs.feed(spark, sf)
    lines.repartition(4).write.parquet(str(tmp_path / "feed"))
    monkeypatch.setattr(inputs, "feed", lambda *_: spark.read.parquet(str(tmp_path / "feed")))
    plans = []

    def arrives(_, path, staged, **how):
        plans.append(staged._jdf.queryExecution().optimizedPlan().toString())
        arrived(_, path, staged, **how)

    writer, csv, arrived = type(lines.write), type(lines.write).csv, arrivals.arrived
    monkeypatch.setattr(writer, "csv", lambda self, path: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), csv(self, path)))
    monkeypatch.setattr(arrivals, "arrived", arrives)
    for name, batches in (("w_stream", 1), ("w_stream_by_file", 3)):
        plans.clear()
        assert queries()[name](spark, sf).count() == lines.count()
        exports, *staged = plans
        assert "Exchange" not in exports and len(staged) == batches
        assert all(-1 < plan.index("md5(") < plan.index("RebalancePartitions") for plan in staged)
