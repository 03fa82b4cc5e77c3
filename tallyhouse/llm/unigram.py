"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary lists, for each end of a word, the pieces that end there, longest first.
Dynamic programming over the ends carries the best score and its number of pieces. A later piece replaces an equal
score never, as in the tokenizers library: of equal splits the one whose last piece is longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.stage import column_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Counts of words that a worker remembers; beyond it starts over.
REMEMBERED = 500_000
# Longer words are counted along a ring of ends and not remembered.
LONG = 256
_COUNTERS: dict[int, WordCounts] = {}


class WordCounts(dict):
    """Number of pieces of a word, which begins with the mark of a space; those of short words are remembered."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.known = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def __missing__(self, rest: str) -> int:
        if len(rest) > LONG:
            return self.count(MARK + rest)
        if len(self) >= REMEMBERED:
            self.clear()
        self[rest] = found = self.count(MARK + rest)
        return found

    def count(self, word: str) -> int:
        if len(word) > LONG or not self.known.issuperset(word):
            return self.count_along(word)
        score, count = [float("-inf")] * (len(word) + 1), [0] * (len(word) + 1)
        score[0] = 0.0
        for end, (length, gain) in self.automaton.iter(word):
            begin = end + 1 - length
            reached = score[begin] + gain
            if reached > score[end + 1]:
                score[end + 1] = reached
                count[end + 1] = count[begin] + 1
        return count[-1]

    def count_along(self, word: str) -> int:
        """As ``count``, for words of any length and where some characters have no piece of their own. No piece reaches
        back farther than the longest one, so a ring of that many ends is all that is held."""
        size = self.longest + 1
        score, count = [float("-inf")] * size, [0] * size
        score[0] = 0.0
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        match = next(matches, None)
        at, unknown = 0, False
        for end, character in enumerate(word, 1):
            before, at = at, end % size
            best, pieces = float("-inf"), 0
            while match is not None and match[0] == end - 1:
                length, gain = match[1]
                begin = (end - length) % size
                if score[begin] + gain > best:
                    best, pieces = score[begin] + gain, count[begin] + 1
                match = next(matches, None)
            joins, unknown = unknown, False
            if character not in self.known and score[before] + self.unknown > best:
                best, unknown = score[before] + self.unknown, True
                # Neighbouring unknown characters are one piece, unless each of their bytes is one.
                pieces = count[before] + (len(character.encode()) if self.byte_fallback else int(not joins))
            score[at], count[at] = best, pieces
        return count[at]


class Pieces:
    """Vocabulary with scores, read once on the driver and sent to the tasks; some 32,000 entries."""

    def __init__(self, spark: SparkSession, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids]
        self.byte_fallback = sum(model.is_byte(i) for i in ids) == 256
        self.key = hash((path, len(pieces)))
        self.pieces = spark.sparkContext.broadcast(pieces)

    def load(self) -> WordCounts:
        if self.key not in _COUNTERS:
            _COUNTERS[self.key] = WordCounts(self.pieces.value, self.byte_fallback)
        return _COUNTERS[self.key]


def count_pieces(text: str, counts: WordCounts) -> int:
    """Spaces become marks, one is put in front unless the text begins with one, and every mark begins a word."""
    if not text:
        return 0
    words = text.replace(MARK, " ").split(" ")
    return sum(map(counts.__getitem__, words if words[0] else words[1:]))


def _count(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    counts = pieces.load()
    for batch in batches:
        found = [count_pieces(value.as_py() or "", counts) for value in column_of(batch, "text")]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])


def token_counts(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars`` and ``n_tokens`` for every row, counted where the text is read.

    Texts are taken as they are, without normalisation or added tokens. NULL counts as empty and has no tokens;
    characters without a piece count one token for each byte if the vocabulary has all byte pieces, else one for each
    run. A text may be one word of any length: what is held beside it follows the longest piece. Repeated rows are counted each; other columns are ignored.
    """
    own = F.col(f"`{text}`").cast("string")
    length = F.coalesce(F.length(own), F.lit(0)).cast("long")
    columns = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), length.alias("n_chars"), own.alias("text"))
    return columns.mapInArrow(partial(_count, pieces=pieces), "doc_id long, n_chars long, n_tokens long")
