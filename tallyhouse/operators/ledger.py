"""From exported lines to the two line tables: money lines and personal-log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import MONTH_ID, month_id
from tallyhouse.functions.money import plain_number, ratio
from tallyhouse.functions.text import like_any, tag_value, word, worked_days
from tallyhouse.operators.lookups import BROADCAST_ROWS, lookup_join
from tallyhouse.policy import NEGATIVE, POSITIVE, Policy

FILE_COLUMNS = ("file_size", "file_created_at", "load_ts")
MONEY = "decimal(18,4)"


# English day names, Sunday first, as Spark numbers the days.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def line_id() -> Column:
    """MD5 over seven fields. NULL account, amount or category gives a NULL id; the other fields have stand-ins."""
    return F.md5(
        F.concat(
            F.col("occurred_at").cast("timestamp_ntz").cast("string"),
            F.col("account"),
            plain_number(F.col("amount_main").try_cast(MONEY)),
            F.coalesce("concept", F.lit("transfer")),
            F.coalesce("comment", F.lit("null")),
            F.col("category"),
            F.coalesce("subcategory", F.lit("null")),
        )
    )


def day_name(moment: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.dayofweek(moment))


def stage_transactions(
    feed: DataFrame, catalog: DataFrame | None = None, max_rows: int = BROADCAST_ROWS, by_month: bool = False
) -> DataFrame:
    """Typed lines with id, month and the metadata of their file.

    Without a catalog the feed carries the file metadata Spark read along with each line, and nothing is joined. With
    one, each line looks up its file; lines of files the catalog does not know keep NULL metadata.

    ``by_month`` brings the lines of a month together, by size like the sinks, before anything is derived from them: the
    id and the day's name, a third of a line's bytes, then do not travel. A load of such lines is told ``placed``.
    """
    month = month_id(F.col("occurred_at"))
    if by_month:
        feed, month = feed.withColumn(MONTH_ID, month).hint("rebalance", MONTH_ID), F.col(MONTH_ID)
    if catalog is not None:
        files = catalog.select(F.col("uri").alias("src_file"), F.lit(True).alias("_known"), *FILE_COLUMNS)
        lines = feed.drop(*FILE_COLUMNS)
        feed = lookup_join(lines, files, ["src_file"], F.struct("occurred_at", "amount_main", "comment"), max_rows)
        feed = feed.withColumn("src_file", F.when(F.col("_known"), F.col("src_file")))
    return feed.select(
        line_id().alias("txn_id"),
        month.alias(MONTH_ID),
        F.col("occurred_at").cast("timestamp_ntz").alias("txn_time"),
        day_name(F.col("occurred_at")).alias("day_of_week"),
        *(F.col(name).cast("string") for name in ("account", "category", "subcategory", "concept")),
        F.col("amount_main").try_cast(MONEY).alias("amount_main"),
        F.col("flow").cast("string"),
        F.col("comment").cast("string"),
        F.col("amount_native").try_cast(MONEY).alias("amount_native"),
        F.col("currency").cast("string"),
        F.col("amount_txn").try_cast(MONEY).alias("amount_txn"),
        "src_file",
        *FILE_COLUMNS,
    )


def parse_tag(lines: DataFrame, keys: DataFrame, policy: Policy, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``tag``, the comment's first word if the dictionary knows it, and ``tag_value``."""
    known = keys.filter(F.col("tag").isNotNull()).select(F.col("tag").alias("_word"), F.col("tag")).distinct()
    spread = F.struct("txn_time", "amount_main", "comment")
    tagged = lookup_join(lines.withColumn("_word", word(F.col("comment"), 0)), known, ["_word"], spread, max_rows)
    return tagged.drop("_word").withColumn("tag_value", tag_value(F.col("comment"), F.col("tag"), policy.companion_tag))


def fact_transactions(
    staged: DataFrame, keys: DataFrame, policy: Policy, max_rows: int = BROADCAST_ROWS, owners: Sequence[str] = ()
) -> DataFrame:
    """Money lines with implied exchange rate, worked days, tag and tag value; ``owners`` are columns that tell ledgers
    apart and are passed on."""
    money = staged.filter(~F.col("account").isin(*policy.non_money_accounts))
    return parse_tag(money, keys, policy, max_rows).select(
        *owners, "txn_id", "month_id", "txn_time", "day_of_week", "account", "category", "subcategory", "concept",
        "amount_main", "flow", "comment", "amount_native", "currency", "amount_txn",
        ratio(F.col("amount_main"), F.col("amount_txn"), 3).try_cast(MONEY).alias("fx_rate"),
        worked_days(F.col("comment")).alias("worked_days"),
        "tag", "tag_value", "src_file", "file_created_at", "load_ts",
    )


def fact_personal(staged: DataFrame, keys: DataFrame, policy: Policy, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Personal-log lines with the polarity of their flow, tag and tag value."""
    flow = F.lower("flow")
    personal = staged.filter(F.col("account").isin(*policy.personal_accounts))
    return parse_tag(personal, keys, policy, max_rows).select(
        "txn_id", "month_id", "txn_time", "account", "category", "subcategory", "concept",
        F.when(like_any(flow, policy.positive_patterns), POSITIVE)
        .when(like_any(flow, policy.negative_patterns), NEGATIVE)
        .alias("sentiment"),
        "comment", "amount_native", "currency", "amount_txn", "tag", "tag_value", "load_ts",
    )
