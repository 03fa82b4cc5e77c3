"""Parquet sinks. Months are directories, so a load rewrites the months it touches and nothing else.

New files are written aside and take their place by renaming. What is to be renamed is written down first, beside the
table: a run that stops between two renames is finished by the next access, so a table is always the old or the new one.
One process at a time works on a table. Beside the lines of a month the table keeps which files they came from, with
their load time and number of lines; loads ask this short table instead of the lines.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyhouse.functions.calendar import MONTH_ID


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; set ``spark.checkpoint.dir`` where it is missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallyhouse/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its path type."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once nothing reads it any more."""
    files, name = _files(spark, path)
    files.delete(name(path), True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, name = _files(spark, target)
    files.mkdirs(name(target).getParent())
    if not files.rename(name(source), name(target)):
        raise OSError(f"{source} could not be moved")


def _exists(spark: SparkSession, path: str) -> bool:
    files, name = _files(spark, path)
    return files.exists(name(path))


def _listed(spark: SparkSession, pattern: str) -> list:
    files, name = _files(spark, pattern)
    return list(files.globStatus(name(pattern)) or ())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    files, name = _files(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    stream = files.create(name(draft), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _move(spark, draft, path)


def _read_text(spark: SparkSession, path: str) -> str:
    files, name = _files(spark, path)
    stream = files.open(name(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _journal(path: str) -> str:
    return f"{path}.swap"


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a stopped run had written down. Every step may be repeated."""
    path = path.rstrip("/")
    if not _exists(spark, _journal(path)):
        return
    for kind, *where in json.loads(_read_text(spark, _journal(path))):
        if kind == "drop":
            delete(spark, where[0])
        elif kind == "add":
            for file in _listed(spark, f"{where[0]}/*"):
                _move(spark, file.getPath().toString(), f"{where[1]}/{file.getPath().getName()}")
        elif _exists(spark, where[0]):
            # Still aside: the old files may be gone already.
            delete(spark, where[1])
            _move(spark, *where)
    delete(spark, _journal(path))


def _swap(spark: SparkSession, path: str, steps: list) -> None:
    _write_text(spark, _journal(path), json.dumps(steps))
    recover(spark, path)


def _aside(spark: SparkSession, path: str) -> str:
    """A place beside the table for its new files. What runs left there that stopped before their swap goes."""
    recover(spark, path)
    files, name = _files(spark, path)
    for pattern in (f"{path}.new-*", f"{_journal(path)}.*"):
        for left in files.globStatus(name(pattern)) or ():
            files.delete(left.getPath(), True)
    return f"{path}.new-{uuid.uuid4().hex}"


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns kept beside a table. They hold for empty tables too, and spare the look into every file."""
    files, name = _files(spark, path)
    kept = files.globStatus(name(f"{path}/_schema/*.json")) or ()
    newest = max((status.getPath() for status in kept), key=lambda p: int(p.getName().split(".")[0]), default=None)
    return T.StructType.fromJson(json.loads(_read_text(spark, newest.toString()))) if newest else None


def _remember(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Add columns that are new; a column once stored is never forgotten."""
    known = stored_schema(spark, path)
    names = set(known.names) if known else set()
    columns = [*(known or []), *(field for field in schema if field.name not in names)]
    if known is None or len(columns) > len(known):
        _write_text(spark, f"{path}/_schema/{len(columns)}.json", T.StructType(columns).json())


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table with all its columns, or None before its first load."""
    recover(spark, path)
    schema = stored_schema(spark, path)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    # A table written elsewhere: every file is asked for its columns.
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def parquet_writer(df: DataFrame) -> DataFrameWriter:
    """How stored tables are written: ids are hashes as text, which only an entropy coder makes smaller."""
    return df.write.option("compression", "zstd")


def overwrite_table(df: DataFrame, path: str) -> DataFrame:
    """Full refresh. The new table is written aside and takes the old one's place by renaming, so a failing job leaves
    the old rows, a stopped swap is finished by the next access, and a table may be computed from itself."""
    spark, path = df.sparkSession, path.rstrip("/")
    aside = _aside(spark, path)
    try:
        parquet_writer(df).parquet(aside)
        _remember(spark, aside, df.schema)
    except BaseException:
        delete(spark, aside)
        raise
    _swap(spark, path, [["replace", aside, path]])
    return spark.read.schema(df.schema).parquet(path)


def _by_month(df: DataFrame, placed: bool = False) -> DataFrame:
    """Rows of a month together, in files of the advisory size: a month that is too big for one task is split again,
    small ones share a task. Both follow from the sizes the shuffle measured. The order inside a file, which the
    writer needs for the months anyway, also lets a scan skip row groups by time. Rows that are ``placed``, each a row
    of a table in month directories or of lines staged ``by_month``, lie together already and stay in their task."""
    order = [MONTH_ID, "txn_time"] if "txn_time" in df.columns else [MONTH_ID]
    return (df if placed else df.hint("rebalance", MONTH_ID)).sortWithinPartitions(*order)


FILES = "_files"
FILE_ROWS = f"src_file string, load_ts timestamp, lines long, {MONTH_ID} int"


def month_directory(month: int | None) -> str:
    return f"{MONTH_ID}={'__HIVE_DEFAULT_PARTITION__' if month is None else month}"


def stored_months(spark: SparkSession, path: str) -> set:
    """Months that have a directory: a listing, no read."""
    files, name = _files(spark, path)
    found = files.globStatus(name(f"{path}/{MONTH_ID}=*")) or ()
    values = (status.getPath().getName().split("=", 1)[1] for status in found)
    return {None if value == "__HIVE_DEFAULT_PARTITION__" else int(value) for value in values}


# So many files below this size may lie in a month before the next lines that come to it make it be written anew. The
# size is well below that of the files which a month is split into, so what was written anew is not crowded again.
PIECES, SMALL = 16, 4 << 20


def crowded_months(spark: SparkSession, path: str) -> set:
    """Months of many small files: a listing, no read."""
    small = Counter(f.getPath().getParent().getName() for f in _listed(spark, f"{path}/{MONTH_ID}=*/*.parquet") if f.getLen() < SMALL)
    return {month for month in stored_months(spark, path) if small[month_directory(month)] >= PIECES}


def files_of(lines: DataFrame, load_ts: str = "load_ts") -> DataFrame:
    """The files of each month of ``lines``, with load time and number of lines."""
    file = F.col("src_file") if "src_file" in lines.columns else F.lit(None).cast("string")
    found = lines.groupBy(MONTH_ID, file.alias("src_file"))
    return found.agg(F.max(load_ts).cast("timestamp").alias("load_ts"), F.count(F.lit(1)).alias("lines")).select("src_file", "load_ts", "lines", MONTH_ID)


def read_files(spark: SparkSession, path: str) -> DataFrame | None:
    """The files that the stored lines came from: ``src_file``, ``load_ts``, ``lines``, ``month_id``. None where they
    are not known, as in a table that was not written by a load."""
    recover(spark, path)
    if not _exists(spark, f"{path}/{FILES}"):
        return None
    return spark.read.schema(FILE_ROWS).parquet(f"{path}/{FILES}")


def _write_files(rows: DataFrame, place: str) -> None:
    parquet_writer(rows.hint("rebalance")).mode("overwrite").parquet(place)


def remember_files(spark: SparkSession, path: str, load_ts: str = "load_ts") -> DataFrame:
    """The files of all stored lines, which are read once for it if they are not known yet."""
    known = read_files(spark, path)
    if known is None:
        aside = _aside(spark, path)
        _write_files(files_of(read_table(spark, path), load_ts), aside)
        _swap(spark, path, [["replace", aside, f"{path}/{FILES}"]])
        known = read_files(spark, path)
    return known


def stage_months(df: DataFrame, path: str, load_ts: str | None = None, placed: bool = False) -> str:
    """Write rows aside in the layout of the table at ``path``, with their files if ``load_ts`` names the load time."""
    spark = df.sparkSession
    aside = _aside(spark, path)
    try:
        parquet_writer(_by_month(df, placed)).partitionBy(MONTH_ID).parquet(aside)
        if load_ts:
            _write_files(files_of(spark.read.schema(df.schema).parquet(aside), load_ts), f"{aside}/{FILES}")
        _remember(spark, aside, df.schema)
    except BaseException:
        delete(spark, aside)
        raise
    return aside


def add_staged(spark: SparkSession, source: str, aside: str, months: Iterable[int | None]) -> None:
    """Put staged months of ``source`` next to other months that are staged in ``aside``."""
    months = set(months)
    if not months:
        return
    for month in months:
        _move(spark, f"{source}/{month_directory(month)}", f"{aside}/{month_directory(month)}")
    files = read_files(spark, source).filter(_of_months(months)).hint("rebalance")
    parquet_writer(files).mode("append").parquet(f"{aside}/{FILES}")


def _of_months(months: Iterable[int | None]) -> Column:
    # NULL is a month of its own.
    return F.coalesce(F.col(MONTH_ID), F.lit(0)).isin([m or 0 for m in months])


def take_months(
    spark: SparkSession, aside: str, path: str, changed: Iterable[int | None] = (), added: Iterable[int | None] = ()
) -> None:
    """Swap in the months that were staged; the others of ``changed`` are emptied. All or nothing, also if it stops. The
    files of months in ``added`` join those that are stored and take no place."""
    if not _exists(spark, path):
        _swap(spark, path, [["replace", aside, path]])
        return
    new, old = stored_months(spark, aside), stored_months(spark, path)
    added = new & old & set(added)
    changed = (new | set(changed)) - added
    steps = [["add" if m in added else "replace", f"{aside}/{month_directory(m)}", f"{path}/{month_directory(m)}"] for m in sorted(new, key=str)]
    steps += [["drop", f"{path}/{month_directory(m)}"] for m in sorted(changed & old - new, key=str)]
    known, came = read_files(spark, path), read_files(spark, aside)
    if known is not None and came is not None:
        _write_files(known.filter(~_of_months(changed)).unionByName(came), f"{aside}/_merged")
        steps.append(["replace", f"{aside}/_merged", f"{path}/{FILES}"])
    else:
        steps.append(["drop", f"{path}/{FILES}"])
    if stored_schema(spark, path) is not None:
        _remember(spark, path, stored_schema(spark, aside))
    _swap(spark, path, [*steps, ["drop", aside]])


def store_months(
    df: DataFrame, path: str, changed: Iterable[int | None] = (), load_ts: str | None = None, placed: bool = False
) -> None:
    """Replace the months present in ``df`` and empty the others of ``changed``. ``df`` may read the table. ``placed``
    says that its rows lie by month already and need no shuffle."""
    take_months(df.sparkSession, stage_months(df, path.rstrip("/"), load_ts, placed), path.rstrip("/"), changed)


def write_months(df: DataFrame, path: str) -> None:
    """First load of a month-partitioned table, or a full refresh of it."""
    recover(df.sparkSession, path)
    parquet_writer(_by_month(df)).mode("overwrite").partitionBy(MONTH_ID).parquet(path)
    _remember(df.sparkSession, path, df.schema)


def overwrite_months(df: DataFrame, path: str) -> None:
    """Replace the months present in ``df``; other months stay as they are.

    Spark stages the new files and swaps directories only when the job has succeeded, so ``df`` may read ``path``. The
    files of the lines are no longer known then.
    """
    spark = df.sparkSession
    recover(spark, path)
    delete(spark, f"{path}/{FILES}")
    writer = parquet_writer(_by_month(df)).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_ID).parquet(path)
    if stored_schema(spark, path) is not None:
        _remember(spark, path, df.schema)
