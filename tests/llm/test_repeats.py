"""Suffix-array and substring dedup against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import hashing, substring_dedup, suffix_dedup


def by_bytes(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        own = (text or "").encode()
        gone = bytearray(len(own))
        for i in range(len(own) - length + 1):
            window = own[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[doc] = (len(own), sum(gone), spans, bytes(x for x, c in zip(own, gone) if not c))
    return out


def by_words(rows, length):
    words = {doc: re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()) for doc, text in rows}
    counts = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for doc, own in words.items():
        gone = [0] * len(own)
        for i in range(len(own) - length + 1):
            if counts[tuple(own[i : i + length])] > 1:
                gone[i : i + length] = [1] * length
        out[doc] = (len(own), sum(gone), b" ".join(x for x, c in zip(own, gone) if not c))
    return out


def corpus(seed):
    """Shared passages, periodic and very long texts, empty ones, ties and NULL."""
    pick = random.Random(seed)
    noise = lambda n: "".join(pick.choice("abé \n") for _ in range(n))
    pieces = [noise(pick.randint(20, 400)) for _ in range(10)]
    rows = [(0, None), (1, ""), (2, "a" * 2000), (3, "a" * 99), (4, "a" * 100), (5, "ab é" * 120), (6, "To " * 90), (7, noise(40_000))]
    for doc in range(8, 70):
        parts = (pick.choice(pieces)[pick.randint(0, 30) :] if pick.random() < 0.6 else noise(pick.randint(1, 300)) for _ in range(pick.randint(1, 6)))
        rows.append((doc, "".join(parts)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd, block", [(64, 1 << 17), (1, 1 << 9)])
def test_bytes_and_words(spark, crowd, block):
    """Also with every group counted as crowded, and texts cut into many blocks."""
    rows = corpus(crowd)
    docs = spark.createDataFrame([(doc, text, "x") for doc, text in rows], "doc_id long, text string, anchor string").repartition(4)
    cut = suffix_dedup.remove_repeats(docs, crowd=crowd, block=block)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()}
    assert got == by_bytes(rows, 100)
    assert cut.filter("row.anchor = 'x'").count() == len(rows)
    cut = substring_dedup.remove_repeated_passages(docs, crowd=crowd)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in cut.select("row.doc_id", "n_words", "n_removed", "kept").collect()}
    assert got == by_words(rows, 35)


def test_a_phrase_never_repeats_a_window_of_its_own():
    """A group of one phrase is settled unseen, so a period must end phrases."""
    import numpy as np

    text = np.frombuffer(("CIÓNASJA.!! SE!! CIÓNCIEZ!! " * 12).encode(), np.uint8)
    row, start, n, _, _ = suffix_dedup.byte_phrases(text, np.array([0, len(text)]), 100, 36, 64)
    for first, count in zip(start.tolist(), n.tolist()):
        windows = [text[i : i + 100].tobytes() for i in range(first, first + count)]
        assert len(set(windows)) == len(windows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (2, "other"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = suffix_dedup.remove_repeats(docs).select("row.doc_id", "row.text", "n_removed").collect()
    removed = sorted(((r.doc_id, r.text == text, r.n_removed) for r in cut), key=str)
    # A row without an id comes first.
    size = len(text)
    assert removed == sorted([(None, True, 0), (1, True, size), (1, True, size), (2, True, size), (2, False, 0)], key=str)
    words = substring_dedup.remove_repeated_passages(docs).select("row.doc_id", "n_removed").collect()
    assert sorted(r.n_removed for r in words) == [0, 60, 60, 60, 60]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == substring_dedup.remove_repeated_passages(docs).count() == 0


def test_difference_cover():
    for period in (1, 7, 21):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_words_are_hashed_in_blocks(monkeypatch):
    """What a task holds beside the phrases follows the block, not the text of a batch; the phrases do not."""
    pick = np.random.default_rng(3)
    data = pick.integers(97, 123, 8 << 20, dtype=np.uint8)
    data[pick.integers(0, len(data), len(data) // 6)] = 32
    offsets = np.arange(0, len(data) + 1, 1 << 11)
    offsets = np.sort(np.append(offsets, [0, 4096, len(data)]))
    args = (data, offsets, 35, 21, substring_dedup.difference_cover(21))
    peaks, found = [], []
    for block in (1 << 30, substring_dedup.BLOCK):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        monkeypatch.setattr(hashing, "_POWERS", {})
        tracemalloc.start()
        found.append(substring_dedup.word_phrases(*args))
        peaks.append(tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in found[-1]))
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*found, strict=True))
    assert peaks[1] < 40 << 20 and peaks[0] > 2 * peaks[1]
