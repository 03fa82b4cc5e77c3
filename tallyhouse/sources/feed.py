"""Monthly CSV exports and what is known about their files."""

from __future__ import annotations

import csv
import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyhouse import schemas


BAD_LINE = "bad_line"


def _decoded(path: Column) -> Column:
    """A file name as the folder holds it: Spark's metadata encode blanks and the like, a listing does not."""
    # A plus sign stands for itself in paths.
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _with_file(lines: DataFrame) -> DataFrame:
    """File name, size and time as Spark read them; they cost no join and no extra pass."""
    return lines.select(
        "*",
        _decoded(F.col("_metadata.file_path")).alias("src_file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_created_at"),
        F.col("_metadata.file_modification_time").alias("load_ts"),
    )


def _reader(reader, schema: T.StructType, options: Mapping[str, str]):
    """Headers must name the columns in this order; a line that does not fit is kept whole in ``bad_line``."""
    kept = T.StructType([*schema, T.StructField(BAD_LINE, T.StringType())])
    reader = reader.schema(kept).option("header", True).option("escape", '"').option("enforceSchema", False)
    return reader.option("columnNameOfCorruptRecord", BAD_LINE).options(**options)


def _engine_names(header: Sequence[str], schema: T.StructType, optional: Collection[str] = ()) -> dict[str, str]:
    """The engine's name of each column of a header. All columns must be there but the optional ones."""
    known = {name: name for name in schema.names}
    known |= {old: new for old, new in schemas.SPANISH_FEED_COLUMNS.items() if new in known}
    names = {name: known.get(name) for name in header}
    found = sorted([*names.values(), *(set(optional) - set(names.values()))], key=str)
    if len(names) < len(header) or found != sorted(schema.names):
        raise ValueError(f"header {list(header)} does not name the columns {schema.names}")
    return names


def _typed(names: Mapping[str, str], schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(name, schema[new].dataType) for name, new in names.items()])


def _in_file_order(
    spark: SparkSession, path: str | list[str], schema: T.StructType, options: Mapping[str, str]
) -> tuple[T.StructType, dict[str, str]]:
    """The schema in the order and with the names of the header, and the engine's name of each."""
    try:
        header = spark.read.option("header", True).option("escape", '"').options(**options).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        header = []
    names = _engine_names(header or schema.names, schema)
    return _typed(names, schema), names


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a task, without reading on."""
    for batch in batches:
        if len(batch):
            yield batch.slice(0, 1)
            return


def _header_groups(spark: SparkSession, path: str | list[str], options: Mapping[str, str]) -> dict[str, list[str]]:
    """Files by their first line, from one distributed pass that reads only the beginning of each part of a file."""
    listing = {name: value for name, value in options.items() if name in LISTING_OPTIONS}
    size = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(size)
    # Files count as so large that no task gets two of them.
    spark.conf.set(size, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
        lines = spark.read.options(**listing).text(path).select("value", *where)
        first = lines.mapInArrow(_first_rows, lines.schema).filter("start = 0")
        groups = first.groupBy("value").agg(F.sort_array(F.collect_list(_decoded(F.col("file")))).alias("files")).collect()
    finally:
        spark.conf.set(size, before)
    return {row["value"].lstrip("\ufeff"): row["files"] for row in sorted(groups, key=lambda row: row["files"])}


# Options that choose files; the rest say how to read them.
LISTING_OPTIONS = ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter", "encoding", "lineSep")


def _literal_path(path: str) -> str:
    """A file name in which no character stands for others."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = schemas.FEED,
    columns: Mapping[str, str] | None = None,
    mixed: bool = False,
    optional: Collection[str] = (),
    **options: str,
) -> DataFrame:
    """Ledger lines of CSV exports, their columns found by the engine's or the Spanish names in the header.

    The files of one call share one order of columns; a file of another order, or a header with missing or unknown
    names, is an error. With ``mixed`` every header is read first, in one pass over the beginnings of all files, and
    each group of files of one header is scanned in its own order; columns named in ``optional`` may be missing and are
    NULL then. Values that cannot be read become NULL, and ``bad_line`` then holds the line (``check_readable`` lists
    them). ``columns`` renames columns to the engine's names when ``schema`` uses the exporter's own. Options go to the
    CSV reader. Lines stay splittable, so one huge file is read by many tasks. Files without a line are left out.
    """
    scans = []
    if mixed:
        for header, files in _header_groups(spark, path, options).items():
            read = csv.reader([header], delimiter=options.get("sep", ","), quotechar=options.get("quote", '"'))
            scans.append((_engine_names([name.strip() for name in next(read)], schema, optional), [_literal_path(file) for file in files]))
    if not scans:
        scans = [(_in_file_order(spark, path, schema, options)[1], path)]
    parts = []
    for names, files in scans:
        lines = _with_file(_reader(spark.read, _typed(names, schema), options).csv(files)).withColumnsRenamed(names)
        missing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema if field.name not in names.values()]
        lines = lines.select("*", *missing)
        parts.append(lines.select(*schema.names, *(name for name in lines.columns if name not in schema.names)))
    lines = reduce(DataFrame.unionByName, parts)
    return lines.withColumnsRenamed(dict(columns)) if columns else lines


def stream_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.FEED,
    columns: Mapping[str, str] | None = None,
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """The same lines as a stream of newly arrived files. Their headers must be like those of the files that are there
    at the start, or follow ``schema`` if there is none. A re-issued export must arrive under its old name in another
    folder."""
    found, names = _in_file_order(spark, path, schema, options)
    reader = _reader(spark.readStream, found, options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = _with_file(reader.csv(path)).withColumnsRenamed(names)
    return lines.withColumnsRenamed(dict(columns)) if columns else lines


def file_catalog(rows: DataFrame) -> DataFrame:
    """Catalog rows in engine form: creation time from microseconds, update time as the load time."""
    return rows.select(
        F.col("uri").cast("string"),
        F.col("size").cast("bigint").alias("file_size"),
        F.timestamp_micros(F.col("generation").cast("bigint")).alias("file_created_at"),
        F.col("updated").cast("timestamp").alias("load_ts"),
    )


def read_file_catalog(spark: SparkSession, path: str, listing: bool = False, pattern: str = "*.csv") -> DataFrame:
    """One row per export file: from a stored catalog, or from a listing of the export folder itself.

    The listing reads names, sizes and times only; the contents column is pruned away.
    """
    if not listing:
        return file_catalog(spark.read.schema(schemas.FILE_CATALOG).parquet(path))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select(
        _decoded(F.col("path")).alias("uri"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_created_at"),
        F.col("modificationTime").alias("load_ts"),
    )
