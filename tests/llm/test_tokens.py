"""BPE against tiktoken, unigram counts against the tokenizers library."""

import base64
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyhouse.llm import bpe, unigram

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(100, 20), (64, 8), (32_768, 2_048)])
def test_bpe_equals_the_library(spark, library, chunk, overlap):
    """Runs longer than the overlap, white space of all kinds, contractions at cuts, NULL and repeated rows."""
    pick = random.Random(2)
    parts = ["a", "é", " ", "\n", "  ", "'ll", "9", "!!", "word ", "　", "\x1c", "日", "🎉", "<|endoftext|>"]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.choice([0, 1, 50, 300, 900])))) for i in range(120)]
    rows += [(500, None), (501, "a" * 700), (502, " " * 600), (503, "b" * 300 + " " * 300), (1, "dup"), (1, "dup"), (None, "x" * 200), (504, "ab 'll" * 12_000)]
    docs = spark.createDataFrame([(*row, 0) for row in rows], "doc_id long, text string, tie int")
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(docs, vocabulary, chunk=chunk, overlap=overlap), vocabulary).collect()
    assert sorted((r.row.doc_id, r.row.text) for r in coded if r.row.doc_id is not None and r.row.text is not None) == sorted(r for r in rows if r[0] is not None and r[1] is not None)
    assert len(coded) == len(rows)
    for row in coded:
        assert row.ids == library.encode_ordinary(row.row.text or "")
        assert bytes(row.decoded) == (row.row.text or "").encode()
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_unigram_counts_equal_the_library(spark, sf):
    pieces = unigram.Pieces(spark, PIECES)
    known = Tokenizer(models.Unigram(pieces.pieces.value, unk_id=0, byte_fallback=True))
    known.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = ["", " ", "  a", "▁", "a▁b", "\n\nx", "日本語 🎉🎉 x", "<0x41> <s>", "é\t\tq", "x " * 5, "z" * 3000, None, "same", "same"]
    texts = [row.text for row in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + odd
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs, pieces).collect()}
    assert got == {i: len(known.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert unigram.token_counts(docs.limit(0), pieces).count() == 0


def test_ties_and_unknown_pieces():
    """Equal scores: the longest last piece wins. Unknown neighbours are one piece without byte pieces."""
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -3.0), ("ba", -2.0)]
    counts = unigram.WordCounts(vocab, byte_fallback=False)
    known = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    known.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for text in ("ab", "aba", "baab", "ab ba", "aééb", "éé", "aéb ééa", "abaéé" * 100, "baab" * 100):
        assert unigram.count_pieces(text, counts) == len(known.encode(text, add_special_tokens=False).ids), text
        # Along the ring too, whatever the length.
        words = text.split(" ")
        assert unigram.count_pieces(text, counts) == sum(counts.count_along(unigram.MARK + word) for word in words), text


def test_a_very_long_word_needs_no_memory_of_its_length(spark):
    pieces = unigram.Pieces(spark, PIECES)
    counts, word = pieces.load(), "extraordinary日本語x" * 20_000
    known = Tokenizer(models.Unigram(pieces.pieces.value, unk_id=0, byte_fallback=True))
    known.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    before = len(counts)
    tracemalloc.start()
    try:
        found = counts[word]
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert found == len(known.encode(word, add_special_tokens=False).ids)
    # Two bytes a character for the word with its mark, four for the automaton's copy, and no list by character.
    assert peak < 6 * len(word) + 100_000 and len(counts) == before
