"""Counts of the base rules against plain Python, and each line rule."""

import random
import re
from collections import Counter

from tallyhouse.llm.line_rules import STEP, Rules, clean_lines, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    hit = {i + j for i, window in enumerate(windows) if times[window] > 1 for j in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    pick = random.Random(9)
    word = lambda: pick.choice(["a", "über", "Ça", "日本", "x|y", "#", "\x00", "\x1c", "b\x85c"])
    texts = ["".join(word() + pick.choice([" ", "\n", "\t", "\x0b", "  ", "\r\n", "\xa0 "]) for _ in range(pick.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " \n\t", "\n\n", "a b c d e a b c d e", "one. " * 30, "z" * (STEP + 5) + " y" * 9, ("lang wort " * 20 + "\n") * 3000]
    rows = [(i if i % 7 else None, text, i, "k") for i, text in enumerate(texts)] + [(5, "twice", 0, None), (5, "twice", 0, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = clean_lines(table).collect()
    assert len(got) == len(rows)
    for row in got:
        n, *_, repeated = expected = base(row.row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (row.kept and row.base_failed)
    assert clean_lines(table.limit(0)).count() == 0


def test_windows_of_many_words():
    """More different words than one packed code can hold."""
    words = [f"w{i}" for i in range(9000)]
    text = " ".join(words + words[100:108])
    assert judge(text.encode(), Rules())[4] == base(text)[4] == 16


def test_line_rules():
    good = "The ship left the harbour at dawn and nobody on the quay saw it go."
    for bad in (
        "Home | News | Sport | Weather.", "Start • Shop • Shoes.", "WIN!! NOW!! HERE!! YES!!", "the*** old&&& man$$$ sat.%%%",
        "We use cookies, see our Cookie Policy.", "Licensed under the Apache License, Version 2.0.", "no sentence ends here",
    ):
        verdict = judge(f"{good}\n{bad}".encode(), Rules())
        assert verdict[6:8] == (2, 1) and verdict[10] == good.encode(), bad
    for fine in (good, "«Ça va?» Oui.", "He said: “go.”", "东京很大。 再见。", "Costs $5 & more (20%).", "Wait, what?! Yes."):
        assert judge(fine.encode(), Rules())[7] == 0, fine
    mostly = f"{good}\n" + "Home | News | Sport | Weather | Travel | Money | Video | Radio | Food | Music | Arts | Taster | Local\n" * 2
    assert not judge(mostly.encode(), Rules())[9] and judge(f"{good}\n{good[::-1]}.\nHome | News".encode(), Rules())[9]


def test_bad_labels_go_and_good_ones_stay(spark):
    """Of the labelled documents that pass the base rules, all good ones are kept and nearly all bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    judged = clean_lines(docs.join(labels, "doc_id")).filter("NOT base_failed").select("kept", "row.quality").collect()
    good, bad = ([row.kept for row in judged if row.quality == label] for label in (1, 0))
    assert all(good) and bad and sum(bad) / len(bad) < 0.05
