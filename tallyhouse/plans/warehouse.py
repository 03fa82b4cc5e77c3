"""Refresh of all stored tables, in the order in which they read each other."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID, Dates, in_range_of_months, month_id
from tallyhouse.functions.text import word
from tallyhouse.operators import cashflow, checks, ledger, lookups, marts, wealth
from tallyhouse.plans import cells, load
from tallyhouse.policy import Policy
from tallyhouse.sources import sinks

VIEWS = ("income_summary", "investment_plan", "investment_tracking", "life_cost")


def _named(found: dict[str, list[DataFrame]]) -> DataFrame:
    """Offenders of several checks with the name of their table."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("table"), "*") for name, parts in found.items() for rows in parts])


@dataclass(frozen=True)
class Warehouse:
    """Tables under one folder. Line tables and marts of lines are partitioned by month, reference tables are not."""

    spark: SparkSession
    root: str
    policy: Policy

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        """A stored table, or the view of that name."""
        if name in VIEWS:
            return getattr(self, name)()
        stored = sinks.read_table(self.spark, self.path(name))
        if stored is None:
            raise ValueError(f"table {name!r} was not loaded yet")
        return stored

    # Views: computed where they are read.

    def income_summary(self) -> DataFrame:
        return marts.income_summary(self.sums(), self.policy)

    def investment_plan(self) -> DataFrame:
        return marts.investment_plan(self.sums(), self.table("budget"), self.table("mortgage"), self.policy)

    def investment_tracking(self) -> DataFrame:
        return marts.investment_tracking(self.table("fact_transactions"), self.investment_plan(), self.policy)

    def life_cost(self) -> DataFrame:
        """Each expense in hours. The price of its own month is stored; the latest month's, which stands in where a
        month has none, is looked up here, so no stored line goes stale when the latest pay changes."""
        return marts.priced_at_latest(self.table("life_cost_lines"), self.table("hourly_pay"))

    # Loads. Months are marked before anything changes: a run that stops is repeated for them by the next one.

    def load_reference(self, keys: DataFrame, budget: DataFrame, mortgage: DataFrame) -> None:
        """Full refresh of the small tables; arguments come from the functions in ``sources.reference``.

        The next load of lines or marts follows: it tags again the months whose comments use a word that came into the
        dictionary or left it, and rebuilds the marts of months whose budget rows differ.
        """
        words = sinks.read_table(self.spark, self.path("words"))
        known = sinks.read_table(self.spark, self.path("keys"))
        if words is not None and known is not None:
            tags = [frame.select(F.col("tag").alias("word")).filter("word IS NOT NULL").distinct() for frame in (known, keys)]
            moved = tags[0].exceptAll(tags[1]).union(tags[1].exceptAll(tags[0]))
            self._mark("changed_lines", load.months_of(words.join(moved, "word", "left_semi")))
        before = sinks.read_table(self.spark, self.path("budget"))
        if before is None:
            self._mark("changed_months", self._budget_months(budget))
        else:
            before = before.select(*budget.columns)
            self._mark("changed_months", self._budget_months(before.exceptAll(budget).union(budget.exceptAll(before))))
        for name, table in (("keys", keys), ("budget", budget), ("mortgage", mortgage)):
            sinks.overwrite_table(table, self.path(name))

    def load_lines(
        self,
        staged: DataFrame,
        months: DataFrame | None = None,
        mode: str = load.LATEST,
        files: DataFrame | None = None,
        placed: bool = False,
    ) -> set:
        """Load staged lines and carry the months they change into the line tables; returns these months.

        ``months``, ``mode``, ``files`` and ``placed`` are those of ``load_month_batch``. The months are also kept for the next
        ``load_marts``, however many loads come before it.
        """
        load.load_month_batch(
            self.spark, self.path("stg_transactions"), staged, months, mode=mode, files=files,
            before=lambda changed: self._mark("changed_lines", changed), placed=placed,
        )
        return self._refresh_lines()

    def _refresh_lines(self) -> set:
        """Line tables of the marked months and what is kept of them: the words that comments begin with, sums, largest
        lines and what the checks find."""
        changed = self._marked("changed_lines")
        if not changed:
            return changed
        keys, lines = self.table("keys"), self.table("stg_transactions").filter(load.in_months(changed))
        words = lines.select(MONTH_ID, word(F.col("comment"), 0).alias("word")).filter("word IS NOT NULL").distinct()
        # Lines are shuffled on their way into these tables only if they meet a dictionary too long to be broadcast.
        placed = lookups.is_small(keys)
        built = (
            ("fact_transactions", ledger.fact_transactions(lines, keys, self.policy), placed),
            ("fact_personal", ledger.fact_personal(lines, keys, self.policy), placed),
            ("words", words, False),
        )
        for name, table, stays in built:
            load.replace_months(self.spark, self.path(name), table, changed, stays)
        fact = self.table("fact_transactions").filter(load.in_months(changed))
        load.replace_months(self.spark, self.path("cells"), cells.month_cells(fact), changed)
        load.replace_months(self.spark, self.path("largest"), cells.largest_lines(fact, self.policy), changed)
        path = sinks.scratch_path(self.spark, "prints")
        try:
            prints = checks.repeated_prints(lines, "txn_id", keys=(MONTH_ID,))
            prints.write.parquet(path)
            prints = self.spark.read.schema(prints.schema).parquet(path)
            load.replace_months(self.spark, self.path("line_checks"), self._line_checks(lines, fact, keys, prints), changed)
        finally:
            sinks.delete(self.spark, path)
        self._carry(changed)
        self._mark("changed_months", changed)
        self._clear("changed_lines")
        return changed

    def _carry(self, changed: set) -> None:
        """Running sums at the end of the changed months and of all later ones, from the sums of these months and the
        newest month before them. Months before keep theirs."""
        known = sinks.read_table(self.spark, self.path("carry")) is not None
        first = min(changed) if known and None not in changed else None
        later = sinks.stored_months(self.spark, self.path("cells")) | changed
        later = {month for month in later if first is None or (month is not None and month >= first)}
        moves = wealth.month_moves(self.table("cells").filter(load.in_months(later)), self.policy)
        sums = cells.running_sums(moves, self._carried(first)).filter(load.in_months(later))
        load.replace_months(self.spark, self.path("carry"), sums, later)

    def _carried(self, month: int | None) -> DataFrame | None:
        """Running sums at the end of the newest month before ``month``: one row of one directory."""
        if month is None:
            return None
        carry = self.table("carry")
        earlier = {known for known in sinks.stored_months(self.spark, self.path("carry")) if known is None or known < month}
        newest = max(earlier - {None}, default=None)
        return carry.filter(load.in_months({newest})) if earlier else None

    def load_marts(self) -> set:
        """Replace every month that changed since the last call in all stored marts; returns these months."""
        self._refresh_lines()
        policy, changed = self.policy, self._marked("changed_months")
        fact = self.table("fact_transactions").filter(load.in_months(changed))
        hidden = policy.property_hidden_categories
        self._replace("hourly_pay", marts.hourly_pay(fact, policy), changed, "txn_time")
        self._replace("tagged_share", marts.tagged_share(fact, policy), changed, "month_start")
        self._replace("property_ledger", marts.tag_ledger(fact, policy.property_tag, hidden), changed, "txn_time", placed=True)
        # A month's own pay comes from lines of the month, so no other month is priced anew.
        self._replace("life_cost_lines", marts.life_cost_lines(fact, self.table("hourly_pay"), policy), changed, "txn_time", placed=True)
        planned = self.table("budget").withColumn(MONTH_ID, month_id(F.col("month_start"))).filter(load.in_months(changed))
        self._replace("budget_compliance", marts.budget_compliance(fact, planned, policy), changed, "month_start")
        self._clear("changed_months")
        return changed

    # States in the place of lines.

    def sums(self, dates: Dates = None) -> DataFrame:
        """Money lines for the dates as the operators that add amounts up by month need them: sums of whole months, and
        lines where a bound lies inside a month."""
        return cells.routed(cells.as_lines(self.table("cells")), self.table("fact_transactions"), dates)

    def largest(self, dates: Dates = None, n: int = cells.LARGEST) -> DataFrame:
        """Money lines for the dates among which the ``n`` largest are, as the lists of largest lines need them."""
        fact = self.table("fact_transactions")
        return fact if n > cells.LARGEST else cells.routed(self.table("largest"), fact, dates)

    def _since(self, dates: Dates) -> dict:
        """Sums of the months that have a day in the range, and what was carried into the first of them."""
        start = dates[0] if dates else None
        fact = cells.as_lines(self.table("cells").filter(in_range_of_months(dates)))
        return {"fact": fact, "policy": self.policy, "dates": dates, "carried": self._carried(start and start.year * 100 + start.month)}

    def net_worth(self, dates: Dates = None) -> DataFrame:
        """``wealth.net_worth`` at the end of the months that have a day in the range; reads no earlier month but one row."""
        return wealth.net_worth(mortgage=self.table("mortgage"), **self._since(dates))

    def passive_income(self, dates: Dates = None) -> DataFrame:
        """``cashflow.passive_income`` of the months that have a day in the range, read like ``net_worth``."""
        return cashflow.passive_income(**self._since(dates))

    # Checks.

    def _line_checks(self, staged: DataFrame, fact: DataFrame, keys: DataFrame, prints: DataFrame) -> DataFrame:
        """What the checks of lines find, by month. An id covers the time, so equal ids are of one month. Money lines are
        a part of the staged ones, so the repeated hashes of these, ``prints``, serve both."""
        month = (MONTH_ID,)
        found = {
            "stg_transactions": [
                checks.check_unique(staged, "txn_id", keys=month, prints=prints),
                checks.check_not_null(staged, "txn_id", "src_file", keys=month),
                checks.check_not_null(staged, "txn_time", "src_file", keys=month),
            ],
            "fact_transactions": [
                checks.check_unique(fact, "txn_id", keys=month, prints=prints),
                checks.check_relationship(fact, "tag", keys, "tag", keys=month),
                checks.check_value_for_tag(fact, keys=month),
                checks.check_worked_days(fact, keys=month),
            ],
        }
        return _named(found)

    def checks(self, as_of: datetime | None = None, stale_after: timedelta = timedelta(days=30)) -> DataFrame:
        """Offenders of every check that the stored tables must pass, as (table, check, key, detail).

        What the lines were found to hold is kept by month, so this reads no line: only small tables and, with
        ``as_of``, the newest month, whose newest line must not be older than ``stale_after``.
        """
        pay, share, compliance = (self.table(name) for name in ("hourly_pay", "tagged_share", "budget_compliance"))
        budget, plan = self.table("budget"), self.investment_plan()
        category = budget.withColumn("category", F.upper("category"))
        found = {
            "hourly_pay": [checks.check_unique(pay, "year", "month"), checks.check_net_le_gross(pay)],
            "tagged_share": [checks.check_unique(share, "month_start")],
            "budget": [checks.check_unique(category, "month_start", "category")],
            "budget_compliance": [
                checks.check_unique(compliance, "month_cat_id"),
                checks.check_not_null(compliance, "month_cat_id", "category"),
            ],
            "investment_plan": [checks.check_unique(plan, MONTH_ID), checks.check_not_null(plan, MONTH_ID)],
        }
        if as_of is not None:
            staged = self.table("stg_transactions")
            months = sinks.stored_months(self.spark, self.path("stg_transactions")) - {None}
            newest = staged.filter(F.col(MONTH_ID) == max(months)) if months else staged
            found["stg_transactions"] = [checks.check_freshness(newest, "txn_time", as_of, warn_after=stale_after)]
        lines = self.table("line_checks")
        # A value that the dictionary lacks is one offender, in however many months it occurs.
        counted = F.col("check").startswith("relationship:")
        values = lines.filter(counted).groupBy("table", "check", "key").agg(F.sum(F.col("detail").cast("long")).cast("string").alias("detail"))
        return lines.filter(~counted).drop(MONTH_ID).unionByName(values).unionByName(_named(found))

    # Marked months: of which the line tables, or the marts, are behind.

    def _months(self, months: set) -> DataFrame:
        return self.spark.createDataFrame([(month,) for month in sorted(months, key=str)], f"{MONTH_ID} int")

    def _marked(self, name: str) -> set:
        marked = sinks.read_table(self.spark, self.path(name))
        return set() if marked is None else load.months_of(marked)

    def _mark(self, name: str, months: set) -> None:
        marked = self._marked(name)
        if not months <= marked:
            sinks.overwrite_table(self._months(marked | months), self.path(name))

    def _clear(self, name: str) -> None:
        sinks.overwrite_table(self._months(set()), self.path(name))

    def _budget_months(self, budget: DataFrame) -> set:
        return load.months_of(budget.select(month_id(F.col("month_start")).alias(MONTH_ID)))

    def _replace(self, name: str, mart: DataFrame, changed: set, time: str, placed: bool = False) -> None:
        """Replace whole months, computed from all their lines and not only from the newest ones."""
        if MONTH_ID not in mart.columns:
            mart = mart.withColumn(MONTH_ID, month_id(F.col(time)))
        load.replace_months(self.spark, self.path(name), mart, changed, placed)
