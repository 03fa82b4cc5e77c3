"""Texts of a ledger line: comment tags, worked days, defaults for missing texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.policy import WORKED_DAYS_ENDINGS

# Characters that trimming removes on either side.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def trim_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def word(text: Column, position: int) -> Column:
    """Space-separated word, counted from 0; NULL past the end."""
    if position == 0:
        return F.substring_index(text, " ", 1)
    return F.get(F.split(text, " "), F.lit(position))


def says_worked_days(comment: Column) -> Column:
    """Whether the comment ends in a worked-days phrase, whatever its letter case and accent."""
    lower = F.lower(comment)
    folded = F.rtrim(F.translate(lower, "í", "i"), F.lit(BLANKS))
    endings = reduce(or_, (folded.endswith(ending) for ending in WORKED_DAYS_ENDINGS))
    # The plain search comes first: it spares most comments the folding.
    return lower.contains("trabajado") & endings


def worked_days(comment: Column) -> Column:
    """Leading number of a comment that ends in a worked-days phrase; NULL where it is not a number."""
    return F.when(says_worked_days(comment), word(comment, 0).try_cast("decimal(18,4)"))


def tag_value(comment: Column, tag: Column, companion_tag: str) -> Column:
    """The second word for companions; otherwise the text between the first slash and the next one."""
    after_slash = trim_blanks(F.get(F.split(comment, "/"), F.lit(1)))
    return F.when(tag == companion_tag, word(comment, 1)).when(tag.isNotNull(), after_slash)


def text_or(text: Column, default: str) -> Column:
    """``text``, or ``default`` where it is NULL or empty."""
    return F.when(F.length(text) > 0, text).otherwise(F.lit(default))


def like_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, (text.like(pattern) for pattern in patterns))
