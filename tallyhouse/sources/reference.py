"""Small reference tables: tag dictionary, budget, mortgage schedule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import schemas


def _cast(df: DataFrame, schema: T.StructType, columns: Mapping[str, str] | None, lenient: tuple[str, ...] = ()):
    if columns:
        df = df.withColumnsRenamed(dict(columns))
    return df.select(
        *(
            (F.col(f.name).try_cast(f.dataType) if f.name in lenient else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in schema
        )
    )


def key_dictionary(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Tag dictionary. A bad number or date becomes NULL; the load time is the time of the run."""
    cast = _cast(df, schemas.KEY_DICTIONARY, columns, lenient=("number", "introduced_on"))
    return cast.withColumn("load_ts", F.current_timestamp())


def budget_table(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Budget rows; a bad value fails the job."""
    return _cast(df, schemas.BUDGET, columns)


def mortgage_table(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Amortization schedule of 23 columns; a bad value fails the job."""
    return _cast(df, schemas.MORTGAGE, columns)
