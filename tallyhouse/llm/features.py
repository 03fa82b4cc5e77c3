"""Counts of character trigrams, of what they spell and of their shape, as dense vectors of bounded size."""

from __future__ import annotations

import numpy as np

from tallyhouse.llm.hashing import word_hashes, word_spans

LETTERS, SHAPES = 4096, 4096
STEP = 1 << 18
# Bytes as letters: A to Z lower-cased, other ASCII as a blank, bytes above as they are.
_SPELLED = np.full(256, 32, np.uint32)
_SPELLED[97:123] = np.arange(97, 123)
_SPELLED[65:91] = np.arange(97, 123)
_SPELLED[128:] = np.arange(128, 256)
# Bytes as one of 16 shapes: small, capital, digit, space, line break and groups of punctuation.
_SHAPE = np.zeros(256, np.uint32)
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2
_SHAPE[[32, 9, 11, 12, 13]] = 3
_SHAPE[10] = 4
_SHAPE[:9] = _SHAPE[14:32] = _SHAPE[127] = 5
for _number, _marks in enumerate((b".,;:", b"!", b"?'\"", b"|", b"*&", b"%$#", b"()[]{}<>", b"/\\-_", b"=+~^`", b"@"), 6):
    _SHAPE[list(_marks)] = _number


def letter_trigrams(text: np.ndarray) -> np.ndarray:
    """Counts of hashed letter trigrams; runs of blanks count as they stand."""
    counts = np.zeros(LETTERS, np.int64)
    for at in range(0, len(text), STEP):
        x = _SPELLED[text[at : at + STEP + 2]]
        if at == 0:
            x = np.concatenate(([np.uint32(32)], x))
        if len(x) >= 3:
            code = (x[:-2] * np.uint32(65_599) + x[1:-1] * np.uint32(257) + x[2:]) * np.uint32(2_654_435_769)
            counts += np.bincount(code >> np.uint32(20), minlength=LETTERS)
    counts[_BLANK] = 0
    return counts


_BLANK = int((np.uint32((32 * 65_599 + 32 * 257 + 32) * 2_654_435_769 % 2**32)) >> np.uint32(20))


def shape_trigrams(text: np.ndarray) -> np.ndarray:
    counts = np.zeros(SHAPES, np.int64)
    for at in range(0, len(text), STEP):
        x = _SHAPE[text[at : at + STEP + 2]]
        if len(x) >= 3:
            counts += np.bincount(x[:-2] << np.uint32(8) | x[1:-1] << np.uint32(4) | x[2:], minlength=SHAPES)
    return counts


def repetition(text: np.ndarray) -> np.ndarray:
    """Shares, 0 to 1: words equal to the word before, words seen before, and words equal to the one two before."""
    words = word_hashes(text, *word_spans(text, np.array([0, len(text)])))
    if len(words) < 3:
        return np.zeros(3)
    seen = 1 - len(np.unique(words)) / len(words)
    return np.array([(words[1:] == words[:-1]).mean(), seen**4, (words[2:] == words[:-2]).mean()])
