"""Loads driven by arriving files: each micro-batch replaces the lines of the exports it re-issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.functions.calendar import MONTH_ID
from tallyhouse.operators import lookups
from tallyhouse.operators.ledger import stage_transactions
from tallyhouse.plans import load
from tallyhouse.sources import sinks


def _name(files: DataFrame) -> DataFrame:
    return files.withColumn("_name", F.substring_index("src_file", "/", -1))


def arrived(spark: SparkSession, path: str, staged: DataFrame, placed: bool = False) -> None:
    """Put the lines of arriving files into the table at ``path``.

    An export is known by its file name without folders. Of all files of one name that ever arrived, the one of the
    newest load time counts, of equal times the one of the larger path; the lines of the others are left out or
    removed. So the table does not depend on how files fall into batches, nor on a batch that is repeated.

    Which file counts is settled on the files that the table keeps beside its months. Lines are written once, by month,
    and their files join the stored ones. Only a month that loses stored lines, or holds many small files, is read and
    written anew; of months where arriving lines give way, these are left out before. ``placed`` is that of
    ``sinks.store_months``.
    """
    path = path.rstrip("/")
    files, moved = sinks.scratch_path(spark, "files"), sinks.scratch_path(spark, "arrived")
    target = sinks.read_table(spark, path)
    known = None if target is None else _name(sinks.remember_files(spark, path))
    aside = sinks.stage_months(staged, path, "load_ts", placed)
    try:
        # With every load time that its lines name, should a file have several.
        marks = "src_file", F.col("load_ts").cast("timestamp"), MONTH_ID
        sinks.read_table(spark, aside).select(*marks).distinct().write.parquet(files)
        came = _name(spark.read.schema(f"src_file string, load_ts timestamp, {MONTH_ID} int").parquet(files))
        names = came.select("_name").distinct()
        stored = came.limit(0) if known is None else known.join(names, "_name", "left_semi").select(*came.columns)
        newest = came.unionByName(stored).groupBy("_name").agg(F.max(F.struct("load_ts", "src_file")).alias("_newest"))
        winners = newest.select("_newest.*")
        if lookups.is_small(winners):
            winners = F.broadcast(winners)
        # Where a stored file goes on counting, nothing changes; else all files of the name give way to the new one.
        taken = came.join(winners, ["load_ts", "src_file"], "left_semi").select("_name").distinct()
        gone = stored.join(taken, "_name", "left_semi")
        arriving = sinks.stored_months(spark, aside)
        anew = load.months_of(gone) | arriving & sinks.crowded_months(spark, path)
        sifted = anew | load.months_of(came.join(winners, ["load_ts", "src_file"], "left_anti"))
        if sifted:
            # The staged lines are moved out of the way of the next ones.
            sinks._move(spark, aside, moved)
            lines = sinks.read_table(spark, moved).filter(load.in_months(sifted))
            rows = lines.join(winners, ["load_ts", "src_file"], "left_semi").select(*lines.columns)
            if anew:
                left = gone.select("src_file").distinct()
                rest = target.filter(load.in_months(anew)).join(F.broadcast(left) if lookups.is_small(left) else left, "src_file", "left_anti")
                rows = load.append_columns(rest.select(*target.columns), rows)
            aside = sinks.stage_months(rows, path, "load_ts")
            sinks.add_staged(spark, moved, aside, arriving - sifted)
        sinks.take_months(spark, aside, path, anew, added=(arriving | sifted) - anew)
    finally:
        for scratch in (files, moved):
            sinks.delete(spark, scratch)


def load_arrivals(feed: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stage the lines of newly arrived files into the table at ``path``; ``feed`` comes from ``stream_feed``.

    A re-issued export arrives under its old name in another folder.
    """

    def load_batch(batch: DataFrame, _: int) -> None:
        arrived(batch.sparkSession, path, stage_transactions(batch, by_month=True), placed=True)

    writer = feed.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
