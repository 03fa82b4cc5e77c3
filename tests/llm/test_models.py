"""Language mixtures, quality votes and transcript roles: held-out accuracy and defined results."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat, language, quality, queries


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out(spark, docs):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang = lang_pred").count() > 0.97 * held.count()
    assert found.count() == docs.count() and found.filter("score < 0 OR score > 1").count() == 0


def test_shares_against_plain_expectation_maximisation():
    """Each text by itself over dictionaries; six languages in equal parts all come out."""
    import math

    import numpy as np

    pick = np.random.default_rng(2)
    learned = pick.dirichlet(np.full(40, 0.15), 6) * 50_000
    model = language.Model(list("abcdef"), learned.round())
    grams = [dict(enumerate(row)) for row in model.grams.tolist()]
    mixes = [np.eye(6)[0], np.eye(6)[3], [0.5, 0.5, 0, 0, 0, 0], [0, 0, 0.2, 0, 0.8, 0], np.full(6, 1 / 6)]
    texts = np.array([pick.multinomial(30_000, mix @ model.grams) for mix in mixes], np.float64)

    def plain(text, start):
        shares = dict(start)
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(shares, 0.0)
            for gram, n in enumerate(text):
                seen = sum(shares[i] * grams[i][gram] for i in shares)
                for i in shares:
                    new[i] += n * shares[i] * grams[i][gram] / seen
            new = {i: x / sum(text) for i, x in new.items()}
            moved = max(abs(new[i] - shares[i]) for i in shares)
            shares = new
            if moved <= language.TOLERANCE:
                return shares
        return shares

    found = model.shares(texts, 2.0)
    for text, own in zip(texts.tolist(), found, strict=True):
        whole = plain(text, dict.fromkeys(range(6), 1 / 6))
        best, score = None, -math.inf
        for size in range(1, 7):
            chosen = sorted(whole, key=lambda i: (-whole[i], i))[:size]
            total = sum(max(whole[i], 1e-9) for i in chosen)
            tried = {i: max(whole[i], 1e-9) / total for i in chosen}
            tried = plain(text, tried) if size > 1 else tried
            fit = sum(n * math.log(max(sum(tried[i] * grams[i][g] for i in tried), 1e-300)) for g, n in enumerate(text))
            fit -= 2.0 * size * math.log(sum(text) + 1)
            if fit <= score:
                break
            best, score = tried, fit
        assert np.allclose(own, [best.get(i, 0.0) for i in range(6)], atol=1e-9)
    assert (found[4] > 0.1).all() and found[0].tolist() == [1, 0, 0, 0, 0, 0]


def test_language_sample_is_bound(spark, monkeypatch):
    """NULL and equal ids, and equal rows, do not widen the sample."""
    learned = []
    real = language.Model
    monkeypatch.setattr(language, "Model", lambda names, counts: learned.append(counts.sum()) or real(names, counts))
    rows = [(None if i % 2 else 7, f"wort {chr(97 + i % 26)}{chr(97 + i // 26)}xx", "de") for i in range(400)] + [(9, "wort wort", "de")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (5, 50):
        language.fit(docs, per_language=most)
    assert 9 * learned[0] < learned[1] < 11 * learned[0]


def test_language_edges(spark, docs):
    model = language.fit(docs)
    half = " ".join("the thing and ered" if i % 2 else "keit und schen ungen" for i in range(60))
    rows = [(1, None), (2, ""), (3, "12 %% ?"), (4, half), (4, half), (None, "thing " * 50_000)]
    got = language.identify(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string"), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 6 and {by_id[i].lang_pred for i in (1, 2, 3)} == {"und"} and by_id[1].score == 0
    assert set(by_id[4].languages) == {"de", "en"}
    assert by_id[None].lang_pred == "en"
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs.limit(5), nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() > 0.95 * held.count()


def test_quality_edges(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    twice = labels.unionByName(labels.limit(1).withColumn("quality", 1 - F.col("quality"))).unionByName(labels.limit(0))
    model = quality.fit(docs, twice, per_label=60)
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 100_000, 1)], "doc_id long, text string, score int")
    got = {r.row.doc_id: r.score for r in quality.scores(rows, model).collect()}
    assert got[1] == got[2] == model.prior and 0 <= got[3] <= 1
    assert quality.scores(rows.limit(0), model).count() == 0
    unlabelled = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scores(rows, unlabelled).collect()} == {1.0}


def test_quality_ratio_of_labels(spark, docs):
    """The same share of labels gives the same votes and decisions, whether or not the sample is cut."""
    alike = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("the same words for all").alias("text"))
    labels = alike.select("doc_id", (F.col("doc_id") % 8 > 0).cast("int").alias("quality"))
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "the same words for all")], "doc_id long, text string")
    for per_label in (10, 15, 1000):
        model = quality.fit(alike, labels, per_label=per_label)
        got = {r.row.doc_id: r.score for r in quality.scores(asked, model, neighbours=1000).collect()}
        assert got == pytest.approx({1: 0.875, 2: 0.875, 3: 0.875}), per_label
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    small, large = (quality.fit(docs, given, per_label=n).prior for n in (20, 1000))
    assert small == large > quality.THRESHOLD


def test_quality_sample(spark):
    """The sample is 1,000 documents of a label, and learning from it needs less memory than one more copy of it."""
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id")).alias("text"))
    model = quality.fit(docs, docs.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("quality")))
    assert np.bincount(model.labels.astype(int)).tolist() == [100, 1000]
    vectors = np.random.default_rng(1).random((800, quality.FEATURES), np.float32)
    tracemalloc.start()
    quality.Model(vectors, np.arange(800) % 2, (400, 400), quality.DIMENSIONS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < vectors.nbytes


def test_roles_held_out(spark):
    sf = "/root/testdata/sf0.01"
    told = spark.read.parquet(f"{sf}/conversations.parquet")
    found = queries.op3_chat_format(spark, sf).withColumnRenamed("role", "found").join(told, ["conv_id", "turn"])
    held = found.filter(queries.remainder(F.col("conv_id"), 4) == 2)
    assert held.filter("found = role").count() > 0.9 * held.count()
    assert found.count() == told.count()


def test_transcripts(spark):
    model = chat.fit(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    text = "System: be kind.\nUser: hi there?\nmore\nAssistant: hello to you\nand so on.\n<|im_start|>user> ok"
    rows = [(1, 0, text), (1, 1, None), (1, 2, ""), (None, None, "x"), (None, 3, "y?"), (None, 3, "y?")]
    got = chat.format_turns(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, text string, part int"), model).collect()
    first = sorted((r.part, r.role, r.rendered) for r in got if r.conv_id == 1 and r.turn == 0)
    assert [(p, role) for p, role, _ in first] == [(0, "system"), (1, "user"), (2, "assistant"), (3, "user")]
    assert first[1][2] == "<|user|>\nhi there?\nmore\n<|end|>\n" and first[3][2] == "<|user|>\nok\n<|end|>\n"
    assert len(got) == 9 and sum(r.conv_id is None for r in got) == 3
    none = spark.createDataFrame([], "conv_id long, turn long, text string")
    assert chat.format_turns(none, model).count() == 0


def test_segments_do_not_matter(spark):
    """One conversation over many segments and tasks gives the same roles as in one piece."""
    model = chat.fit(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    pick = random.Random(3)
    rows = [(7, i, pick.choice(["a?", "User: hello", "long text " * 30, "x\ny"])) for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    whole = sorted(map(tuple, chat.format_turns(table, model).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        assert sorted(map(tuple, chat.format_turns(table, model).collect())) == whole
    finally:
        spark.conf.unset(size)


def _talk(convs: int, pick: random.Random) -> list[tuple]:
    said = {"user": ["what is it?", "and then?"], "assistant": ["It is so.\nBecause it is.", "Well: yes."], "tool": ["{rows: 3}", ""]}
    rows = []
    for conv in range(convs):
        for turn in range(pick.randrange(1, 9)):
            role = pick.choice(sorted(said))
            rows += [(conv, turn, role.upper() if turn % 2 else role, pick.choice(said[role]))] * pick.choice([1, 1, 3])
    return rows + [(None, 0, "user", "lost"), (1, None, "user", "lost"), (1, 0, None, "lost")]


def test_roles_are_learned_from_sums(spark):
    """Counts equal those of one loop over the sorted messages, into however many ranges these are cut."""
    import numpy as np

    rows = _talk(60, random.Random(4)) + [(9, turn, "user", "on?") for turn in range(10, 200)]
    roles, known = ("assistant", "tool", "user"), sorted((r[0], r[1], r[2].lower(), r[3]) for r in rows if None not in r)
    lines, sizes = np.zeros((3, chat.LENGTHS * chat.SIGNS)), np.zeros((3, chat.SIZES))
    turns, first, before = np.zeros((3, 3)), np.zeros(3), None
    for conv, _, name, text in known:
        role = roles.index(name)
        for _, seen, _, size in chat.parse(text, roles):
            lines[role, seen] += 1
            if size >= 0:
                sizes[role, size] += 1
        if before is None or before[0] != conv:
            first[role] += 1
        else:
            turns[before[1], role] += 1
        before = conv, role
    plain = chat.Model(roles, lines, sizes, turns, first)
    shuffle, join = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(shuffle)
    try:
        spark.conf.set(join, "false")
        for parts in ("1", "3", "29"):
            spark.conf.set(shuffle, parts)
            model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(int(parts)))
            assert model.roles == roles
            for name in ("emit", "head", "next", "first"):
                assert (getattr(model, name) == getattr(plain, name)).all(), (parts, name)
    finally:
        spark.conf.set(shuffle, old)
        spark.conf.unset(join)


def test_roles_against_brute_force(spark):
    """Every way through the lines of short conversations; the best one has the roles that come out."""
    from itertools import product

    rows = [row for row in _talk(40, random.Random(6)) if None not in row]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pick = random.Random(8)
    texts = ["what?", "Tool: {3}", "It is so.", "user: and\nthen?", "", "{a: 1}\nfunction: b"]
    table = [(conv, turn, pick.choice(texts)) for conv in range(30) for turn in range(pick.randrange(1, 5))]
    got = chat.format_turns(spark.createDataFrame(table, "conv_id long, turn long, text string"), model).collect()
    found: dict = {}
    for row in sorted(got, key=lambda r: (r.conv_id, r.turn, r.part)):
        found.setdefault(row.conv_id, []).append((row.turn, row.role))
    for conv in range(30):
        said = [(turn, text) for c, turn, text in table if c == conv]
        lines = [(turn, i, *line) for turn, text in said for i, line in enumerate(chat.parse(text, model.roles))]

        def score(states):
            total = 0
            for at, (state, (_, i, _, seen, mark, size)) in enumerate(zip(states, lines, strict=True)):
                steady = i > 0 and mark < 0
                total += model.first[state] if at == 0 else (model.within if steady else model.next)[states[at - 1], state]
                total += (model.head[state, size] if size >= 0 else model.emit[state, seen]) + (model.marked[state, mark] if mark >= 0 else 0)
            return int(total) >> chat.TIE_BITS

        scores = {states: score(states) for states in product(range(3), repeat=len(lines))}
        best = max(scores.values())
        # The lowest bits, which decide ties, can tell ways apart only where they are less than one unit a line apart.
        near = [states for states, own in scores.items() if own >= best - len(lines)]
        wanted = []
        for states in near:
            parts: list = []
            for (turn, i, *_), state in zip(lines, states, strict=True):
                if i == 0 or parts[-1] != (turn, model.roles[state]):
                    parts.append((turn, model.roles[state]))
            wanted.append(parts)
        assert found[conv] in wanted
