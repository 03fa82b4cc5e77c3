"""Loads of many ledgers into one table: what a load replaces are months of owners, and each owner has their own
newest load time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.calendar import MONTH_ID, Dates, month_id
from tallyhouse.functions.text import word
from tallyhouse.operators import ledger, marts
from tallyhouse.operators.lookups import BROADCAST_ROWS, is_small, lookup_join
from tallyhouse.plans import cells
from tallyhouse.plans.load import append_columns, merge_by_key
from tallyhouse.policy import Policy
from tallyhouse.sources import ledgers, sinks
from tallyhouse.sources.ledgers import BUCKET, BUCKETS, LEDGER, Cell

NAMED, NEWEST, LINE = "_named", "_newest", "_line"

# Tables of a row for each ledger and month, or for each of its categories.
FEW = ("hourly_pay", "tagged_share", "budget_compliance")


def touched_owner_months(source: DataFrame, owner: str, load_ts: str = "load_ts") -> DataFrame:
    """``owner`` and month of the rows of each owner's latest load; lines are reduced to months before any ranking."""
    months = source.groupBy(owner, MONTH_ID).agg(F.max(load_ts).alias("_at"))
    latest = F.max("_at").over(Window.partitionBy(owner))
    return months.withColumn("_latest", latest).filter("_at = _latest").select(owner, MONTH_ID)


def _cells_of(rows: DataFrame) -> set[Cell]:
    """Distinct directories: they follow the buckets and the calendar, whatever the table holds."""
    return {(row[0], row[1]) for row in rows.select(BUCKET, MONTH_ID).distinct().collect()}


def _mark_named(lines: DataFrame, named: DataFrame, max_rows: int) -> DataFrame:
    marks = named.select(LEDGER, MONTH_ID, F.lit(True).alias(NAMED))
    return lookup_join(lines, marks, [LEDGER, MONTH_ID], F.struct("txn_time", "txn_id"), max_rows)


def _side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], None]]) -> None:
    """Run jobs that do not wait for each other at once: a short one leaves most of the cluster idle. An error is raised
    when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()


def load_owner_months(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    owner: str,
    months: DataFrame | None = None,
    key: str | None = "txn_id",
    load_ts: str = "load_ts",
    buckets: int = BUCKETS,
    max_rows: int = BROADCAST_ROWS,
    before: Callable[[set[Cell]], None] | None = None,
) -> set[Cell]:
    """Run one load of many ledgers into the table at ``path``; the (bucket, month) directories it changed.

    ``owner`` names the column that tells ledgers apart. ``months`` (``owner``, ``month_id``) defaults to the months of
    each owner's latest load. A named month of an owner is replaced by all that the source holds of it, and emptied if
    the source has none; the same month of other owners stays. Of an owner's other months the source rows are merged by
    ``key`` that are newer than what the table holds of that owner outside the named months. Equal keys of different
    owners are different lines. A load may be repeated and is atomic, like that of one ledger.

    The source should hold the exports that may bring something new: rows that do not are read and left out. Lines
    meet named months and owners' load times in a broadcast while these are at most ``max_rows``; beyond, the lines of
    an owner with many are spread over tasks. Stored lines are read in the changed directories only. ``buckets`` counts
    at the first load. ``before`` is called with the changed directories when nothing is changed yet.

    Lines without an owner are a ledger of their own, lines without a time are merged and never replaced by month, and
    lines without a key are added.
    """
    path, before = path.rstrip("/"), before or (lambda _: None)
    target = sinks.read_table(spark, path)
    if target is None:
        aside = ledgers.stage_cells(source, path, owner, buckets, load_ts)
        arriving = ledgers.stored_cells(spark, aside)
        before(arriving)
        ledgers.take_cells(spark, aside, path)
        return arriving
    buckets = ledgers.buckets_of(spark, path)
    asked, moved = sinks.scratch_path(spark, "named"), sinks.scratch_path(spark, "updates")
    try:
        pairs = touched_owner_months(source, owner, load_ts) if months is None else months
        named = ledgers.with_ledger(pairs, owner, buckets).select(LEDGER, BUCKET, MONTH_ID)
        named.filter(F.col(MONTH_ID).isNotNull()).distinct().write.parquet(asked)
        named = spark.read.schema(named.schema).parquet(asked)
        known = ledgers.read_files(spark, path)
        on = [LEDGER, BUCKET, MONTH_ID]
        lost = _cells_of(known.join(named, on, "left_semi"))
        newest = known.join(named, on, "left_anti").groupBy(LEDGER).agg(F.max("load_ts").alias(NEWEST))
        marked = _mark_named(source.withColumn(LEDGER, ledgers.ledger_of(owner)), named, max_rows)
        marked = lookup_join(marked, newest, [LEDGER], F.struct("txn_time", "txn_id"), max_rows)
        fresh = F.col(NEWEST).isNull() | (F.col(load_ts) > F.col(NEWEST))
        updates = marked.filter(F.coalesce(NAMED, F.lit(False)) | fresh).select(*source.columns)
        aside = ledgers.stage_cells(updates, path, owner, buckets, load_ts)
        held, arriving = ledgers.stored_cells(spark, path), ledgers.stored_cells(spark, aside)
        changed = lost | arriving
        before((held & lost) | arriving)
        if held & changed:
            # The staged rows are moved out of the way of the next ones.
            sinks._move(spark, aside, moved)
            stored = target.filter(ledgers.in_cells(held & changed)).withColumn(LEDGER, ledgers.ledger_of(owner))
            keep = _mark_named(stored, named, max_rows).filter(F.col(NAMED).isNull()).select(*target.columns)
            staged = sinks.read_table(spark, moved)
            came = ledgers.read_files(spark, moved)
            # An update replaces a line of its own ledger only; the files tell whether any of those is kept.
            kept = known.filter(ledgers.in_cells(held & changed)).join(named, on, "left_anti")
            if key and not kept.join(came, LEDGER, "left_semi").isEmpty():
                # One text for owner and key, NULL where the key is.
                line = F.concat(F.col(key).cast("string"), F.lit("|"), ledgers.ledger_of(owner))
                count = came.agg(F.sum("lines")).first()[0] or 0
                result = merge_by_key(keep.withColumn(LINE, line), staged.withColumn(LINE, line), LINE, count, max_rows).drop(LINE)
            else:
                result = append_columns(keep, staged)
            aside = ledgers.stage_cells(result.drop(BUCKET), path, owner, buckets, load_ts)
        ledgers.take_cells(spark, aside, path, changed)
        return (held & lost) | arriving
    finally:
        sinks.delete(spark, asked)
        sinks.delete(spark, moved)


@dataclass(frozen=True)
class LedgerHouse:
    """The stored tables of many ledgers under one folder, told apart by the column ``owner``.

    A load of some owners refreshes the directories of their months and no others: money lines, sums, largest lines and
    the marts that are kept. Views are computed where they are read, for all ledgers in one job. The dictionary of tags
    is shared; budget rows have an owner. Lines without an owner are stored and summed as one ledger, but have no pay
    and no budget to be joined with.
    """

    spark: SparkSession
    root: str
    policy: Policy
    owner: str = "owner"
    buckets: int = BUCKETS

    @property
    def keys(self) -> tuple[str]:
        return (self.owner,)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        stored = sinks.read_table(self.spark, self.path(name))
        if stored is None:
            raise ValueError(f"table {name!r} was not loaded yet")
        return stored.drop(BUCKET)

    def life_cost(self) -> DataFrame:
        """Expenses in hours, each at the pay of its own ledger."""
        return marts.life_cost(self.table("fact_transactions"), self.table("hourly_pay").drop(MONTH_ID), self.policy, self.keys)

    def income_summary(self) -> DataFrame:
        return marts.income_summary(self.sums(), self.policy, self.keys)

    def sums(self, dates: Dates = None) -> DataFrame:
        """What the operators that add amounts up by month ask for, with ``keys``: sums of whole months, and lines where
        a bound lies inside a month."""
        return cells.routed(cells.as_lines(self.table("cells")), self.table("fact_transactions"), dates)

    def largest(self, dates: Dates = None, n: int = cells.LARGEST) -> DataFrame:
        """Lines among which the ``n`` largest of each ledger are."""
        fact = self.table("fact_transactions")
        return fact if n > cells.LARGEST else cells.routed(self.table("largest"), fact, dates)

    def load_reference(self, keys: DataFrame, budget: DataFrame) -> None:
        """Full refresh of dictionary and budget. The next ``refresh`` tags the directories again whose comments use a
        word that came or went, and rebuilds those of owners' months whose budget rows differ."""
        words, known = (sinks.read_table(self.spark, self.path(name)) for name in ("words", "keys"))
        if words is not None and known is not None:
            tags = [frame.select(F.col("tag").alias("word")).filter("word IS NOT NULL").distinct() for frame in (known, keys)]
            moved = tags[0].exceptAll(tags[1]).union(tags[1].exceptAll(tags[0]))
            self._mark(_cells_of(words.join(moved, "word", "left_semi")))
        before = sinks.read_table(self.spark, self.path("budget"))
        if before is not None:
            before = before.select(*budget.columns)
            differing = before.exceptAll(budget).union(budget.exceptAll(before))
            self._mark(_cells_of(self._planned(differing)) & ledgers.stored_cells(self.spark, self.path("stg_transactions")))
        for name, rows in (("keys", keys), ("budget", budget)):
            sinks.overwrite_table(rows, self.path(name))

    def load_lines(self, staged: DataFrame, months: DataFrame | None = None) -> set[Cell]:
        """Load staged lines as ``load_owner_months`` does and refresh what follows from them. A run that stops is
        made good by the next load or ``refresh``."""
        load_owner_months(
            self.spark, self.path("stg_transactions"), staged, self.owner, months, buckets=self.buckets, before=self._mark
        )
        return self.refresh()

    def refresh(self) -> set[Cell]:
        """Replace the marked directories in every table that follows from the lines; returns them."""
        changed = self._marked()
        if not changed:
            return changed
        policy, keys = self.policy, self.keys
        lines = sinks.read_table(self.spark, self.path("stg_transactions")).filter(ledgers.in_cells(changed)).drop(BUCKET)
        words = lines.select(self.owner, MONTH_ID, word(F.col("comment"), 0).alias("word")).filter("word IS NOT NULL")
        money = ledger.fact_transactions(lines, self.table("keys"), policy, owners=keys)
        self._store_all((("fact_transactions", money), ("words", words.distinct())), changed)
        fact = sinks.read_table(self.spark, self.path("fact_transactions")).filter(ledgers.in_cells(changed)).drop(BUCKET)
        pay = marts.hourly_pay(fact, policy, keys).withColumn(MONTH_ID, (F.col("year") * 100 + F.col("month")).cast("int"))
        budget = self._planned(self.table("budget")).filter(ledgers.in_cells(changed)).drop(LEDGER, BUCKET, MONTH_ID)
        kept = (
            ("cells", cells.month_cells(fact, keys)),
            ("largest", cells.largest_lines(fact, policy, keys=keys)),
            ("hourly_pay", pay),
            ("tagged_share", self._dated(marts.tagged_share(fact, policy, keys))),
            ("budget_compliance", self._dated(marts.budget_compliance(fact, budget, policy, keys))),
        )
        self._store_all(kept, changed)
        sinks.overwrite_table(self._rows(set()), self.path("changed"))
        return changed

    def _dated(self, mart: DataFrame) -> DataFrame:
        return mart if MONTH_ID in mart.columns else mart.withColumn(MONTH_ID, month_id(F.col("month_start")))

    def _planned(self, budget: DataFrame) -> DataFrame:
        dated = budget.withColumn(MONTH_ID, month_id(F.col("month_start")))
        return ledgers.with_ledger(dated, self.owner, self._buckets())

    def _buckets(self) -> int:
        path = self.path("stg_transactions")
        return self.buckets if sinks.read_table(self.spark, path) is None else ledgers.buckets_of(self.spark, path)

    def _store(self, name: str, rows: DataFrame, changed: set[Cell]) -> None:
        ledgers.store_cells(rows, self.path(name), self.owner, self._buckets(), changed, self._layout(name))

    def _store_all(self, tables: Sequence[tuple[str, DataFrame]], changed: set[Cell]) -> None:
        """Tables that do not follow from each other."""
        _side_by_side(self.spark, [partial(self._store, name, rows, changed) for name, rows in tables])

    def _layout(self, name: str) -> str:
        # Money lines are shuffled on their way only if they meet a dictionary too long to be broadcast.
        if name == "fact_transactions" and is_small(self.table("keys")):
            return ledgers.PLACED
        return ledgers.FEW if name in FEW else ledgers.BY_SIZE

    # Marked directories: those in which the other tables are behind the lines.

    def _rows(self, marked: set[Cell]) -> DataFrame:
        return self.spark.createDataFrame(sorted(marked, key=str), f"{BUCKET} int, {MONTH_ID} int")

    def _marked(self) -> set[Cell]:
        marked = sinks.read_table(self.spark, self.path("changed"))
        return set() if marked is None else _cells_of(marked)

    def _mark(self, found: set[Cell]) -> None:
        marked = self._marked()
        if not found <= marked:
            sinks.overwrite_table(self._rows(marked | found), self.path("changed"))
