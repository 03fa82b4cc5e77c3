"""A stored table of the lines of many ledgers. Its directories are (bucket of owners, month).

A bucket holds the owners whose hash falls into it. So small ledgers share files, the directories follow the number of
buckets and the calendar and not the number of owners, and a big owner is split into files by size like any big month.
Beside the lines of a directory stands which files of which owner they came from. New files are staged and take their
place by the same journal as those of a table of one ledger.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID
from tallyhouse.sources import sinks

BUCKET, LEDGER = "owner_bucket", "_ledger"
BUCKETS = 64
OWNERS = "_owners.json"
FILE_ROWS = f"{LEDGER} string, src_file string, load_ts timestamp, lines long, {BUCKET} int, {MONTH_ID} int"

# (bucket, month); lines without a time are of month None.
Cell = tuple[int, int | None]

# How rows come to the task that writes their directory. BY_SIZE splits what is too big for a task and packs what is
# small. FEW is for rows that follow the owners and the calendar and not the lines: there the files take the time, so
# the directories are dealt over all tasks. PLACED rows lie together already, as those of a stored table do.
BY_SIZE, FEW, PLACED = "by size", "few", "placed"


def ledger_of(owner: str) -> Column:
    """The ledger a line belongs to, never NULL: lines without an owner are a ledger of their own."""
    return F.when(F.col(owner).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(owner).cast("string")))


def with_ledger(lines: DataFrame, owner: str, buckets: int) -> DataFrame:
    marked = lines.withColumn(LEDGER, ledger_of(owner))
    return marked.withColumn(BUCKET, F.pmod(F.xxhash64(LEDGER), F.lit(buckets)).cast("int"))


def in_cells(cells: Iterable[Cell]) -> Column:
    """Whether a row lies in one of the directories; asks nothing but partition columns, so others are not read."""
    code = F.col(BUCKET).cast("long") * 1_000_000 + F.coalesce(F.col(MONTH_ID), F.lit(0))
    return code.isin([bucket * 1_000_000 + (month or 0) for bucket, month in cells])


def cell_directory(cell: Cell) -> str:
    return f"{BUCKET}={cell[0]}/{sinks.month_directory(cell[1])}"


def stored_cells(spark: SparkSession, path: str) -> set[Cell]:
    """Directories of a table: a listing, no read."""
    files, name = sinks._files(spark, path)
    found = set()
    for status in files.globStatus(name(f"{path}/{BUCKET}=*/{MONTH_ID}=*")) or ():
        month = status.getPath().getName().split("=", 1)[1]
        bucket = int(status.getPath().getParent().getName().split("=", 1)[1])
        found.add((bucket, None if month == "__HIVE_DEFAULT_PARTITION__" else int(month)))
    return found


def buckets_of(spark: SparkSession, path: str) -> int:
    """The number of buckets that the first load of a table settled."""
    return json.loads(sinks._read_text(spark, f"{path}/{OWNERS}"))["buckets"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that the stored lines of each ledger came from: one row for each file, ledger and month."""
    return spark.read.schema(FILE_ROWS).parquet(f"{path}/{sinks.FILES}")


def _dealt(rows: DataFrame, layout: str) -> DataFrame:
    if layout == PLACED:
        return rows
    if layout == FEW:
        return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, BUCKET, MONTH_ID)
    return rows.hint("rebalance", BUCKET, MONTH_ID)


def _write_files(lines: DataFrame, load_ts: str, path: str) -> None:
    file = F.col("src_file") if "src_file" in lines.columns else F.lit(None).cast("string")
    found = lines.groupBy(BUCKET, MONTH_ID, LEDGER, file.alias("src_file"))
    files = found.agg(F.max(load_ts).cast("timestamp").alias("load_ts"), F.count(F.lit(1)).alias("lines"))
    sinks.parquet_writer(_dealt(files, FEW)).partitionBy(BUCKET, MONTH_ID).parquet(path)


def stage_cells(
    lines: DataFrame, path: str, owner: str, buckets: int, load_ts: str | None = None, layout: str = BY_SIZE
) -> str:
    """Write rows aside in the layout of the table at ``path``, with their files if ``load_ts`` names the load time."""
    spark = lines.sparkSession
    aside = sinks._aside(spark, path)
    marked = with_ledger(lines, owner, buckets)
    try:
        order = [BUCKET, MONTH_ID, LEDGER, *(["txn_time"] if "txn_time" in lines.columns else [])]
        dealt = _dealt(marked, layout).sortWithinPartitions(*order).drop(LEDGER)
        sinks.parquet_writer(dealt).partitionBy(BUCKET, MONTH_ID).parquet(aside)
        if load_ts:
            stored = spark.read.schema(dealt.schema).parquet(aside)
            _write_files(stored.withColumn(LEDGER, ledger_of(owner)), load_ts, f"{aside}/{sinks.FILES}")
        sinks._remember(spark, aside, dealt.schema)
        sinks._write_text(spark, f"{aside}/{OWNERS}", json.dumps({"owner": owner, "buckets": buckets}))
    except BaseException:
        sinks.delete(spark, aside)
        raise
    return aside


def take_cells(spark: SparkSession, aside: str, path: str, changed: Iterable[Cell] = ()) -> None:
    """Swap in the directories that were staged, those of lines and those of their files; the others of ``changed`` are
    emptied. All or nothing, also if it stops."""
    if not sinks._exists(spark, path):
        sinks._swap(spark, path, [["replace", aside, path]])
        return
    new, old = stored_cells(spark, aside), stored_cells(spark, path)
    steps = []
    for part in ("", f"{sinks.FILES}/") if sinks._exists(spark, f"{aside}/{sinks.FILES}") else ("",):
        places = [f"{part}{cell_directory(cell)}" for cell in sorted(new, key=str)]
        steps += [["replace", f"{aside}/{place}", f"{path}/{place}"] for place in places]
        steps += [["drop", f"{path}/{part}{cell_directory(cell)}"] for cell in sorted(set(changed) & old - new, key=str)]
    sinks._remember(spark, path, sinks.stored_schema(spark, aside))
    sinks._swap(spark, path, [*steps, ["drop", aside]])


def store_cells(
    rows: DataFrame, path: str, owner: str, buckets: int, changed: Iterable[Cell], layout: str = BY_SIZE
) -> None:
    """Make a derived table equal ``rows`` in the changed directories; ``rows`` lie in these only."""
    take_cells(rows.sparkSession, stage_cells(rows, path, owner, buckets, layout=layout), path, changed)
