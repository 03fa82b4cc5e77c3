"""Line-first quality rules: lines are judged and removed one by one, then documents that lose too much text go.

A line with a word fails if no sentence ends in it, if it is a navigation bar, if it is full of marks, or if it holds
boilerplate. Boilerplate, such as a notice below a short text, goes without telling against the rest of the document.
What the base rules reject (few words, repeated passages of words) is judged on the whole text and never cleaned first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters of the base rules.
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
# A sentence ends in one of these marks, with closing quotes and brackets behind it, in front of a blank.
END = """(?:[.!?:;]|…|。|！|？)(?:["')\\]]|»|”|’)*(?:[ \\t-\\r]|$)"""
# Marks that separate the entries of a navigation bar.
BARS = "|<>"
WIDE_BARS = ("•", "·")
# Words that end in a run of marks: shouting, or markup left over from a page.
MARKED = "(?:!!|\\?\\?|##|\\*\\*|\\$\\$|%%|&&)[.,;:]?(?:[ \\t-\\r]|$)"
# Phrases of page furniture, in lower case.
PHRASES = (
    "all rights reserved", "cookie policy", "enable javascript", "licensed under the", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "terms of service", "terms of use",
)
_END, _MARKED = re.compile(END.encode()), re.compile(MARKED.encode())
# The same ends for the usual marks alone: a set in front is found fast.
_USUAL_END = re.compile(END.replace("(?:[.!?:;]|…|。|！|？)", "[.!?:;]").encode())
_WIDE_BARS, _PHRASES = [mark.encode() for mark in WIDE_BARS], [phrase.encode() for phrase in PHRASES]
STEP = 1 << 20
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_failed_lines long, lost_chars long, kept boolean, cleaned binary"


@dataclass(frozen=True)
class Rules:
    """Limits in per cent and words."""

    least_words: int = 10
    most_repeated: int = 20
    window: int = 5
    most_bars: int = 20
    most_marked: int = 20
    most_lost: int = 50


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words; words are split a stretch at a time."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    out = []
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        # A stretch ends in front of a blank, or with the text.
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        words = text[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_words(words: np.ndarray, window: int) -> int:
    """Words in windows found twice or more. Windows are compared by exact codes, packed while they fit 63 bits."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    base = int(words.max()) + 1
    code, most = words[:n], base
    for i in range(1, window):
        if most * base >= 2**63:
            values, code = np.unique(code, return_inverse=True)
            most = len(values)
        code, most = code * base + words[i : n + i], most * base
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def word_chars(text: bytes) -> int:
    return len(text.translate(None, BLANKS + _CONTINUED))


def is_junk(line: bytes, rules: Rules) -> bool:
    """Whether a line with a word has no end of a sentence, is a navigation bar, or is full of marks."""
    if not _USUAL_END.search(line) and not _END.search(line):
        return True
    bars = len(line) - len(line.translate(None, BARS.encode())) + sum(map(line.count, _WIDE_BARS))
    marked = len(_MARKED.findall(line))
    if not bars and not marked:
        return False
    words = len(line.split())
    return 100 * bars > rules.most_bars * words or 100 * marked > rules.most_marked * words


def is_furniture(line: bytes) -> bool:
    low = line.lower()
    return any(phrase in low for phrase in _PHRASES)


def judge(text: bytes, rules: Rules) -> tuple:
    numbers = word_numbers(text)
    chars, repeats = word_chars(text), repeated_words(numbers, rules.window)
    seen: set[bytes] = set()
    kept, copies, lines, failed, lost, furniture = [], 0, 0, 0, 0, 0
    for line in text.split(b"\n"):
        if not line.strip():
            kept.append(line)
            continue
        lines += 1
        if line in seen:
            copies += 1
        else:
            seen.add(line)
        if is_junk(line, rules):
            failed += 1
            lost += word_chars(line)
        elif is_furniture(line):
            failed += 1
            furniture += word_chars(line)
        else:
            kept.append(line)
    base_failed = len(numbers) < rules.least_words or 100 * repeats > rules.most_repeated * len(numbers)
    good = not base_failed and 100 * lost <= rules.most_lost * chars and lost + furniture < chars
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(numbers), chars, symbols, copies, repeats, base_failed, lines, failed, lost, good, b"\n".join(kept)


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_COLUMNS = [(name, _KINDS[kind]) for name, kind in (part.split() for part in OUT.split(", "))]


def _judged(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(zip(*(judge(text.as_py() or b"", rules) for text in batch.column(1)), strict=True)) or [()] * len(_COLUMNS)
        columns = [pa.array(values, kind) for values, (_, kind) in zip(found, _COLUMNS, strict=True)]
        yield pa.record_batch([batch.column(0), *columns], names=["row", *(name for name, _ in _COLUMNS)])


def clean_lines(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``row`` (the input row), the base counts, and the verdict on every document.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` count in
    the whole text; ``base_failed`` is the verdict of the base rules. ``n_lines`` lines hold a word, ``n_failed_lines``
    of them break a line rule and go; ``cleaned`` is what is left, in UTF-8. ``lost_chars`` counts the code points of
    words in those that are not boilerplate. ``kept`` is false for documents that fail a base rule, lose more than
    ``most_lost`` per cent in this way, or have no word left.

    A NULL text counts as empty, and an empty one fails for its few words. Repeated rows, rows without an id and any
    other columns pass through as they are; an empty table gives no rows. One text must fit a worker's memory; beyond
    the text itself a word takes eight bytes. Nothing is shuffled: each row is judged where it is read.
    """
    row = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    packed = docs.select(row, F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL(OUT)])
    return packed.mapInArrow(partial(_judged, rules=rules), schema)
