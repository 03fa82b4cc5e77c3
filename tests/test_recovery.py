"""Loads that are repeated, fail, or stop half-way; what they read; and what follows a change of dictionary or pay."""

from functools import partial
from itertools import count

import pytest
from pyspark.sql import functions as F

from casebook import inputs
from casebook.policy import DEMO
from tallyhouse import schemas
from tallyhouse.operators import checks, ledger, marts
from tallyhouse.plans import load
from tallyhouse.plans.warehouse import Warehouse
from tallyhouse.sources import feed as feeds
from tallyhouse.sources import sinks
from tallyhouse.streaming.arrivals import arrived
from tests.rows import line, staged, values

MAY, JUNE, JULY = ("2001-05-10 08:00:00", "2001-06-10 08:00:00", "2001-07-10 08:00:00")
NEW = "2002-02-01"


class Stop(Exception):
    pass


def stopping(monkeypatch, at):
    """The run stops in front of the ``at``-th change that a sink makes to the file system."""
    made = count()
    for name in ("_move", "delete", "_write_text"):

        def step(*args, real=getattr(sinks, name)):
            if next(made) == at:
                raise Stop
            real(*args)

        monkeypatch.setattr(sinks, name, step)


def stopped(monkeypatch, at, run):
    """Whether the run was stopped."""
    with monkeypatch.context() as patch:
        stopping(patch, at)
        try:
            run()
        except Stop:
            return True
    return False


def rows(spark, path):
    return values(sinks.read_table(spark, path), "month_id", "concept")


def test_a_swap_that_stops_is_whole_or_not_done(spark, tmp_path, monkeypatch):
    """May is emptied, June replaced, July new: stopped in front of every step, read, then repeated."""
    schema = "month_id int, concept string, load_ts timestamp"
    table = lambda *months: spark.createDataFrame([(m, c, None) for m, c in months], schema).coalesce(1)
    old, new = [(200105, "m"), (200106, "j")], [(200106, "k"), (200107, "n")]
    seen = set()
    for at in count():
        path = str(tmp_path / f"t{at}")
        sinks.store_months(table(*old), path, load_ts="load_ts")
        replace = partial(sinks.store_months, table(*new), path, {200105, 200106}, "load_ts")
        more = stopped(monkeypatch, at, replace)
        found = rows(spark, path)
        assert found in (old, new)
        seen.add(str(found))
        replace()
        assert rows(spark, path) == new
        assert values(sinks.read_files(spark, path), "month_id", "lines") == [(200106, 1), (200107, 1)]
        assert [file.name for file in tmp_path.iterdir() if file.name.startswith(f"t{at}.")] == []
        if not more:
            break
    assert at > 8 and len(seen) == 2


@pytest.mark.parametrize("at", [2, 6, 9])
def test_a_load_that_stops_may_be_repeated(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    first = [line(when=MAY, concept="m", src_file="a"), line(when=JUNE, concept="j", src_file="b")]
    second = staged(spark, first[0], line(when=MAY, concept="new", src_file="c", loaded=NEW), line(when=JUNE, concept="k", src_file="c", loaded=NEW))
    load.load_month_batch(spark, path, staged(spark, *first))
    run = partial(load.load_month_batch, spark, path, second, spark.createDataFrame([(200106,)], "month_id int"))
    stopped(monkeypatch, at, run)
    run()
    assert rows(spark, path) == [(200105, "m"), (200105, "new"), (200106, "k")]


def test_a_refresh_that_stops_is_finished(spark, tmp_path, monkeypatch):
    for at in count():
        path = str(tmp_path / f"t{at}")
        sinks.overwrite_table(spark.range(5).toDF("n"), path)
        more = stopped(monkeypatch, at, lambda: sinks.overwrite_table(spark.range(3).toDF("n"), path))  # noqa: B023
        assert sinks.read_table(spark, path).count() in (3, 5)
        assert sinks.overwrite_table(spark.range(3).toDF("n"), path).count() == 3
        if not more:
            break
    assert at > 2


@pytest.mark.parametrize("by", ["months", "files", "warehouse"])
def test_stray_lines_survive_a_repeated_load(spark, sf, tmp_path, by):
    """A file named for June holds a line of May, too."""
    first = staged(spark, line(when=MAY, src_file="x_0105.csv", concept="a"))
    stray = [line(when=when, src_file="x_0106.csv", loaded=NEW, concept=name) for when, name in ((MAY, "stray"), (JUNE, "b"), ("2001-06-11 08:00:00", "c"))]
    exports = first.unionByName(staged(spark, *stray))
    june = spark.createDataFrame([(200106,)], "month_id int")
    files = spark.createDataFrame([("x_0106.csv",)], "uri string")
    path = str(tmp_path / "stg_transactions")
    house = Warehouse(spark, str(tmp_path), DEMO)
    if by == "warehouse":
        house.load_reference(inputs.keys(spark), inputs.budget(spark, sf), inputs.mortgage(spark, sf))
        house.load_lines(first)
    else:
        load.load_month_batch(spark, path, first)
    for _ in range(2):
        if by == "months":
            load.load_month_batch(spark, path, exports, june)
        elif by == "files":
            load.load_month_batch(spark, path, exports, files=files)
        else:
            house.load_lines(exports, files=files)
        assert rows(spark, path) == [(200105, "a"), (200105, "stray"), (200106, "b"), (200106, "c")]


def test_files_older_than_the_newest_are_replaced_too(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = [line(when=MAY, src_file="a.csv", concept="a"), line(when=MAY, src_file="b.csv", concept="b", loaded=NEW)]
    load.load_month_batch(spark, path, staged(spark, *lines))
    again = staged(spark, line(when=MAY, src_file="a.csv", concept="a2"), lines[1])
    load.load_month_batch(spark, path, again, files=spark.createDataFrame([("a.csv",)], "uri string"))
    assert rows(spark, path) == [(200105, "a2"), (200105, "b")]


def spoil(folder):
    """Whoever reads the lines of this month fails."""
    for file in folder.glob("*.parquet"):
        file.write_bytes(b"no parquet")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("by", ["batch", "pending", "files", "stream"])
def test_no_line_of_an_untouched_month_is_read(spark, tmp_path, by):
    path = str(tmp_path / "t")
    first = staged(spark, line(when=MAY, src_file="in/a.csv"), line(when=JUNE, src_file="in/b.csv"))
    new = staged(spark, line(when=JUNE, src_file="again/b.csv", concept="new", loaded=NEW))
    if by == "stream":
        arrived(spark, path, first)
    else:
        load.load_month_batch(spark, path, first)
    spoil(tmp_path / "t" / "month_id=200105")
    if by == "stream":
        arrived(spark, path, new)
    elif by == "files":
        load.load_month_batch(spark, path, new, files=spark.createDataFrame([("in/b.csv",)], "uri string"))
    else:
        load.load_month_batch(spark, path, new, mode=load.ALL_PENDING if by == "pending" else load.LATEST)
    assert values(sinks.read_table(spark, path).filter("month_id = 200106"), "concept") == [("new",)]


def part_files(folder):
    return {file.name for file in folder.glob("*.parquet")}


def test_arriving_lines_join_a_month_that_is_not_read(spark, tmp_path):
    path, may = str(tmp_path / "t"), tmp_path / "t" / "month_id=200105"
    arrived(spark, path, staged(spark, line(when=MAY, src_file="in/a.csv"), line(when=None, src_file="in/a.csv")))
    stored = {name: (may / name).read_bytes() for name in part_files(may)}
    spoil(may)
    spoil(tmp_path / "t" / "month_id=__HIVE_DEFAULT_PARTITION__")
    # An older file of a stored name and the lesser of two new ones of a name are left out, whatever months they hold.
    late = [line(when=when, src_file="old/a.csv", loaded="2001-01-01", concept="late") for when in (MAY, JUNE)]
    lesser = [line(when=when, src_file="in/b.csv", concept="lesser") for when in (MAY, JULY)]
    arrived(spark, path, staged(spark, *late, *lesser, line(when=MAY, src_file="in/c.csv"), *(line(when=when, src_file="new/b.csv", concept="new", loaded=NEW) for when in (MAY, None))))
    for name, content in stored.items():
        (may / name).write_bytes(content)
    table = sinks.read_table(spark, path).filter("month_id IS NOT NULL")
    assert values(table, "month_id", "src_file", "concept") == [(200105, "in/a.csv", "Lunch"), (200105, "in/c.csv", "Lunch"), (200105, "new/b.csv", "new")]
    files = [(200105, "in/a.csv", 1), (200105, "in/c.csv", 1), (200105, "new/b.csv", 1), (None, "in/a.csv", 1), (None, "new/b.csv", 1)]
    assert values(sinks.read_files(spark, path), "month_id", "src_file", "lines") == files
    # A repeated batch, and a newer file of a name, take their lines' place.
    for concept, when, loaded in (("Lunch", MAY, "2002-01-01"), ("again", JUNE, "2002-03-01")):
        arrived(spark, path, staged(spark, line(when=when, src_file="in/c.csv", concept=concept, loaded=loaded)))
        table = sinks.read_table(spark, path).filter("month_id IS NOT NULL AND src_file = 'in/c.csv'")
        assert values(table, "concept") == [(concept,)]


def test_arriving_lines_are_written_once(spark, tmp_path, monkeypatch):
    path, writes = str(tmp_path / "t"), []
    first, second = staged(spark, line(src_file="a.csv")), staged(spark, line(src_file="b.csv"), line(when=JUNE, src_file="b.csv"))
    writer = type(first.write)
    real = writer.parquet

    def parquet(self, *args, **options):
        if "txn_id" in self._df.columns:
            writes.append(self._df.count())
        real(self, *args, **options)

    monkeypatch.setattr(writer, "parquet", parquet)
    arrived(spark, path, first)
    arrived(spark, path, second)
    assert writes == [1, 2]


def test_a_month_of_many_arrivals_stays_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PIECES", 2)
    path, most = str(tmp_path / "t"), 0
    for n in range(5):
        june = [line(when=JUNE, src_file=f"{n}.csv", concept=str(n))] if n == 3 else []
        arrived(spark, path, staged(spark, line(when=MAY, src_file=f"{n}.csv", concept=str(n)), *june).coalesce(1))
        most = max(most, len(part_files(tmp_path / "t" / "month_id=200105")))
    assert most == 2
    assert rows(spark, path) == [*((200105, str(n)) for n in range(5)), (200106, "3")]
    assert values(sinks.read_files(spark, path), "month_id", "src_file", "lines") == [*((200105, f"{n}.csv", 1) for n in range(5)), (200106, "3.csv", 1)]


def test_files_that_join_a_month_come_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """May gains lines in several files, June is replaced, July new: stopped in front of every step, then read."""
    schema = "month_id int, concept string, load_ts timestamp"
    table = lambda parts, *months: spark.createDataFrame([(m, c, None) for m, c in months], schema).repartition(parts, "concept")
    old, new = [(200105, "m"), (200106, "j")], [(200105, "a"), (200105, "b"), (200105, "c"), (200106, "k"), (200107, "n")]
    after, seen = sorted([old[0], *new], key=str), set()
    for at in count():
        path = str(tmp_path / f"t{at}")
        sinks.store_months(table(1, *old), path, load_ts="load_ts")
        aside = sinks.stage_months(table(8, *new), path, "load_ts", placed=True)
        more = stopped(monkeypatch, at, partial(sinks.take_months, spark, aside, path, {200106}, {200105}))
        found = rows(spark, path)
        assert found in (old, after)
        seen.add(str(found))
        if found == after:
            assert values(sinks.read_files(spark, path).groupBy("month_id").agg(F.sum("lines").alias("lines")), "month_id", "lines") == [(200105, 4), (200106, 1), (200107, 1)]
        if not more:
            break
    assert at > 8 and len(seen) == 2


@pytest.mark.parametrize("at", [3, 8])
def test_a_batch_that_stops_may_be_repeated(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    arrived(spark, path, staged(spark, line(when=MAY, src_file="a.csv", concept="a"), line(when=JUNE, src_file="b.csv", concept="b")))
    more = staged(spark, line(when=MAY, src_file="c.csv", concept="c"), line(when=JUNE, src_file="b.csv", concept="new", loaded=NEW))
    run = partial(arrived, spark, path, more)
    assert stopped(monkeypatch, at, run)
    run()
    assert rows(spark, path) == [(200105, "a"), (200105, "c"), (200106, "new")]


def test_exports_known_to_hold_nothing_new_are_not_opened(spark, tmp_path):
    header = ",".join(schemas.FEED.names)
    one = "2001-0{}-10 08:00:00,Card,Food,,Lunch,,Expense,1,1,1,PEN"
    for month in (5, 6):
        (tmp_path / f"x_010{month}.csv").write_text(f"{header}\n{one.format(month)}\n")
    lines = feeds.read_feed(spark, str(tmp_path))
    from tallyhouse.operators.ledger import stage_transactions

    source = stage_transactions(lines)
    path = str(tmp_path / "stg")
    load.load_month_batch(spark, path, source)
    spared = load._not_read_for(sinks.read_files(spark, path), {200106})
    assert len(spared) == 1 and "x_0105.csv" in spared[0]
    mark = F.concat("src_file", F.lit("|"), F.unix_micros("load_ts").cast("string"))
    assert source.filter(F.coalesce(~mark.isin(spared), F.lit(True))).select("txn_id").rdd.getNumPartitions() == 1
    assert load.load_month_batch(spark, path, source, spark.createDataFrame([(200106,)], "month_id int")) == {200106}
    assert len(rows(spark, path)) == 2


def test_membership_filter(spark, monkeypatch):
    """It never misses a key, lets few others pass, and those that pass do no harm."""
    stored = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    stored = stored.unionByName(spark.range(50).select(F.lit(None).cast("string").alias("k"), "id").toDF("k", "v"))
    # One key has many stored rows.
    stored = stored.unionByName(spark.range(3000).select(F.md5(F.lit("7")).alias("k"), (F.col("id") + 50_000).alias("v"))).cache()
    updates = stored.filter("v < 500 AND k IS NOT NULL").withColumn("v", -F.col("v") - 1).union(spark.createDataFrame([("new", -9999), (None, -5000)], "k string, v long"))
    may = load.membership(updates.filter("k IS NOT NULL"), "k", 501)
    passed = stored.filter(may)
    assert passed.filter("v < 500 AND k IS NOT NULL").count() == 500
    assert passed.filter("v BETWEEN 500 AND 19999").count() < 1000
    expected = sorted(row.v for row in load.merge_by_key(stored, updates, "k").collect())
    for bits in (16, 1):
        monkeypatch.setattr(load, "FILTER_BITS", bits)
        merged = load.merge_by_key(stored, updates, "k", max_rows=0)
        assert sorted(row.v for row in merged.collect()) == expected
    monkeypatch.setattr(load, "FILTER_WORDS", 0)
    assert sorted(row.v for row in load.merge_by_key(stored, updates, "k", max_rows=0).collect()) == expected


def test_headers_of_many_kinds(spark, tmp_path):
    names = list(schemas.FEED.names)
    cells = dict(zip(names, "2001-05-10 08:00:00,Card,Food,,Lunch,C/ Ana,Expense,12.50,12.50,12.50,PEN".split(","), strict=True))
    kinds = {"a b.csv": names, "b{1}.csv": names[::-1], "c.csv": [n for n in names if n != "currency"], "d.csv": list(schemas.SPANISH_FEED_COLUMNS)}
    spanish = schemas.SPANISH_FEED_COLUMNS
    for name, header in kinds.items():
        lines = [",".join(cells[spanish.get(column, column)] for column in header)] * 3
        (tmp_path / name).write_text("\n".join([",".join(header), *lines]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    got = feeds.read_feed(spark, str(tmp_path), mixed=True, optional=("currency",))
    assert got.columns[: len(names)] == names and got.count() == 12
    assert values(got.groupBy("currency", "concept").count(), "currency", "concept", "count") == [("PEN", "Lunch", 9), (None, "Lunch", 3)]
    assert got.select("src_file").distinct().count() == 4
    with pytest.raises(ValueError, match="does not name"):
        feeds.read_feed(spark, str(tmp_path), mixed=True)


SALARY = {"category": "Salary", "flow": "Income", "comment": "20 dias trabajados", "amount": "100"}


@pytest.fixture
def house(spark, sf, tmp_path):
    house = Warehouse(spark, str(tmp_path), DEMO)
    house.load_reference(inputs.keys(spark), inputs.budget(spark, sf).limit(0), inputs.mortgage(spark, sf))
    return house


def test_a_change_of_the_latest_pay_rewrites_no_old_month(spark, house, tmp_path):
    """April has no pay: its line costs what the latest month pays, whichever that is."""
    april = line(when="2001-04-10 08:00:00")
    first = [april, line(when=MAY, **SALARY), line(when=MAY)]
    house.load_lines(staged(spark, *first))
    house.load_marts()
    before = {file.name for file in (tmp_path / "life_cost_lines" / "month_id=200104").iterdir()}
    more = staged(spark, *first, line(when=JUNE, loaded=NEW, **SALARY | {"amount": "900"}), line(when=JUNE, loaded=NEW))
    house.load_lines(more)
    assert house.load_marts() == {200106}
    assert {file.name for file in (tmp_path / "life_cost_lines" / "month_id=200104").iterdir()} == before
    fact = house.table("fact_transactions")
    expected = marts.life_cost(fact, marts.hourly_pay(fact, DEMO), DEMO)
    names = ("month_id", "hours_worked", "pay_per_hour", "cost_hours")
    assert values(house.table("life_cost"), *names) == values(expected, *names)


def test_marts_that_fail_are_whole_after_the_next_run(spark, house, monkeypatch):
    first = [line(when="2001-04-10 08:00:00"), line(when=MAY, **SALARY), line(when=MAY)]
    house.load_lines(staged(spark, *first))
    house.load_marts()
    source = staged(spark, *first, line(when=JUNE, loaded=NEW, **SALARY | {"amount": "300"}))
    real = load.replace_months
    # Three line tables and five marts; what was stopped is done by the run that follows.
    for at in range(8):
        made = count()

        def step(*args, at=at, made=made):
            if next(made) == at:
                raise Stop
            return real(*args)

        with monkeypatch.context() as patch, pytest.raises(Stop):
            patch.setattr(load, "replace_months", step)
            house.load_lines(source)
            house.load_marts()
    house.load_marts()
    fact = house.table("fact_transactions")
    pay = marts.hourly_pay(fact, DEMO)
    assert values(house.table("hourly_pay"), "month", "pay_per_hour") == values(pay, "month", "pay_per_hour")
    names = ("month_id", "pay_per_hour", "cost_hours")
    assert values(house.table("life_cost"), *names) == values(marts.life_cost(fact, pay, DEMO), *names)
    assert house._marked("changed_lines") == house._marked("changed_months") == set()


def test_a_changed_dictionary_reaches_the_months_that_use_it(spark, house):
    lines = [line(when=MAY, comment="Inm/ Unit 1"), line(when=JUNE, comment="Zz/ x"), line(when=JULY, comment="C/ Ana")]
    house.load_lines(staged(spark, *lines))
    house.load_marts()
    keys = inputs.keys(spark).filter("tag <> 'Inm/'").unionByName(inputs.keys(spark).limit(1).withColumn("tag", F.lit("Zz/")))
    house.load_reference(keys, house.table("budget"), house.table("mortgage"))
    assert house.load_marts() == {200105, 200106}
    assert values(house.table("fact_transactions"), "month_id", "tag") == [(200105, None), (200106, "Zz/"), (200107, "C/")]
    # The same tables again change nothing.
    house.load_reference(keys, house.table("budget"), house.table("mortgage"))
    assert house.load_marts() == set()


def test_membership_filter_of_many_keys(spark):
    """With more keys than the full width allows it still holds every key; no word is looked up in a list of words."""
    updates = spark.range(2_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    others = spark.range(2_000, 4_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    count = 64 * load.FILTER_WORDS // load.LEAST_BITS
    may = load.membership(updates, "k", count)
    asked = updates.unionByName(others).filter(may)
    assert "map_from_entries" not in asked._jdf.queryExecution().toString()
    assert asked.join(updates, "k", "left_semi").count() == 2_000
    assert asked.join(others, "k", "left_semi").count() < 200
    assert load.membership(updates, "k", count + 1) is None


def test_merge_copies_only_keys_of_many_lines(spark, monkeypatch):
    """The updates' keys are copied only where one of them owns many stored rows."""
    stored = spark.range(5_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    hot = spark.range(3_000).select(F.md5(F.lit("7")).alias("k"), (F.col("id") + 10_000).alias("v"))
    seen, real = [], load.hot_keys
    monkeypatch.setattr(load, "hot_keys", lambda lines, on: seen.append(real(lines, on)) or seen[-1])
    updates = stored.withColumn("v", -F.col("v") - 1)
    merged = load.merge_by_key(stored.unionByName(hot), updates, "k", max_rows=0)
    assert sorted(row.v for row in merged.collect()) == list(range(-5_000, 0))
    assert [row.k for row in seen[0].collect()] == [stored.filter("v = 7").first().k]


def test_lines_that_lie_by_month_are_not_shuffled(spark, house, monkeypatch):
    """Tables whose rows are stored lines one by one stay in the tasks that read them."""
    shuffled, real = {}, sinks.stage_months

    def stage(df, path, load_ts=None, *placed):
        plan = sinks._by_month(df, *placed)._jdf.queryExecution().optimizedPlan().toString()
        shuffled[path.rsplit("/", 1)[1]] = "RebalancePartitions" in plan
        return real(df, path, load_ts, *placed)

    monkeypatch.setattr(sinks, "stage_months", stage)
    house.load_lines(staged(spark, line(when=MAY), line(when=JUNE, account="Personal"), line(when=None)))
    house.load_marts()
    for name in ("fact_transactions", "fact_personal", "property_ledger", "life_cost_lines"):
        assert shuffled[name] is False
    assert shuffled["stg_transactions"] and shuffled["largest"]
    assert values(house.table("fact_transactions"), "month_id") == [(200105,), (None,)]
    assert values(house.table("fact_personal"), "month_id") == [(200106,)]


def test_the_ledger_is_derived_after_its_rows_were_spread(spark, sf):
    """Numbers are shuffled and not the texts made of them; the rows are the same."""
    spread = inputs.run_sql(spark, sf, inputs.LEDGER, inputs._spread)
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "Transfer in" in plan and "Transfer in" not in plan[plan.index("RebalancePartitions"):]
    plain = inputs.run_sql(spark, sf, inputs.LEDGER)
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_lines_staged_by_month_travel_without_what_is_derived(spark, sf, tmp_path):
    """The id is made after the lines of a month were brought together, and a load of such lines moves them no more."""
    feed = inputs.feed(spark, sf)
    plain, dealt = ledger.stage_transactions(feed), ledger.stage_transactions(feed, by_month=True)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "md5" not in plan[plan.index("RebalancePartitions"):]
    assert dealt.schema == plain.schema and dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
    for name, lines, placed in (("plain", plain, False), ("dealt", dealt, True)):
        load.load_month_batch(spark, str(tmp_path / name), inputs.first_batch(lines))
        load.load_month_batch(spark, str(tmp_path / name), inputs.after_second_batch(lines), placed=placed)
    stored = [sinks.read_table(spark, str(tmp_path / name)) for name in ("plain", "dealt")]
    assert stored[0].exceptAll(stored[1]).isEmpty() and stored[1].exceptAll(stored[0]).isEmpty()
    assert all(file.name.endswith(".zstd.parquet") for file in (tmp_path / "dealt").rglob("part-*.parquet"))


@pytest.mark.parametrize("max_rows", [10, 0])
def test_only_ids_of_repeated_hashes_are_counted(spark, tmp_path, max_rows):
    """The check finds what it finds without the hashes, also in a part of the rows and if a hash is one of a single
    value; a row without a month has a hash like others."""
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1), ("c", None), ("c", None), ("d", 2), ("d", 2), ("d", 2)]
    lines = spark.createDataFrame(rows, "id string, month int")
    prints = checks.repeated_prints(lines, "id", keys=("month",))
    assert prints.count() == 3
    chance = lines.filter("id = 'b'").select(F.xxhash64("month", "id").alias("_print"))
    prints.union(chance).write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    for part in (lines, lines.filter("id <> 'd'"), lines.dropDuplicates()):
        plain = checks.check_unique(part, "id", keys=("month",))
        found = checks.check_unique(part, "id", keys=("month",), prints=prints, max_rows=max_rows)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
