"""Recover who speaks in a transcript and write its turns in one form.

A hidden Markov model over lines: states are roles, what is seen is a speaker marker, the length of a line and its last
sign. Where a message begins any role may follow; within a message a role rarely changes unless a marker says so. The
most likely roles come from the Viterbi algorithm in its associative form: a segment of lines is reduced to the best
score between each pair of first and last states, segments are chained by these small tables, and each segment then
follows its own path back. So one conversation may span any number of segments and tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.hashing import mix
from tallyhouse.llm.stage import keep

# Where no message tells its role.
ROLES = ("assistant", "system", "user")
# Words that name a speaker in front of a colon or inside chat tags, besides the names of the roles.
SPEAKERS = {
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "a": "assistant",
    "system": "system", "instruction": "system", "instructions": "system",
    "user": "user", "human": "user", "customer": "user", "q": "user", "prompter": "user",
    "function": "tool",
}
END_MARK = re.compile(r"\s*<\|(?:im_end|end)\|>\s*$")
LENGTHS, SIGNS, SIZES = 14, 5, 40
# Scores are whole numbers, so their sums do not depend on where segments are cut; the lowest bits decide ties.
SCALE, TIE_BITS, NEVER = 2**16, 10, -(2**60)
# A role is learned if at least this share of the messages has it.
LEAST_SHARE = 1e-3
MARKER_TRUST, DRIFT, SMOOTHING = 1e-4, 1e-6, 1.0
NEXT, WITHIN = 0, 1
# In counts of steps: before the first message of a conversation.
FIRST = -1


@cache
def _marker(roles: tuple[str, ...]) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of a speaker marker, and the number of the role that each word in it names."""
    words = {word: roles.index(role) for word, role in SPEAKERS.items() if role in roles}
    words |= {role: number for number, role in enumerate(roles)}
    names = "|".join(re.escape(word) for word in sorted(words, key=len, reverse=True))
    front, end = r"^\s*(?:<\|(?:im_start\|>)?|\[|#{2,3} ?|\*\*)?(", r")(?:\|>|\]|:\*\*|\*\*:|\s*:|>)\s*"
    return re.compile(front + names + end, re.IGNORECASE), words


def _seen(line: str) -> int:
    """Length on a scale of powers of two, and the kind of the last sign."""
    length = min(len(line).bit_length(), LENGTHS - 1)
    last = line[-1:]
    sign = 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3 if last in ":{(," else 4
    return length * SIGNS + sign


def parse(text: str | None, roles: tuple[str, ...] = ROLES) -> list[tuple[str, int, int, int]]:
    """Lines of a message: text without marker, what is seen, number of the marked role or -1, and for the first line
    of the message and each marked line the size of what follows up to the next one, else -1."""
    found, (marker, words) = [], _marker(roles)
    for number, line in enumerate((text or "").split("\n")):
        match = marker.match(line)
        role = words.get(match[1].lower(), -1) if match else -1
        body = END_MARK.sub("", line[match.end() :] if match else line)
        if number == 0 or match:
            head = number
            found.append([body, _seen(body), role, 0])
        else:
            found.append([body, _seen(body), role, -1])
        found[head][3] += len(body)
    for line in found:
        if line[3] >= 0:
            line[3] = min(int(3 * math.log2(line[3] + 1)), SIZES - 1)
        else:
            line[3] = -1
    return [tuple(line) for line in found]


class Model:
    """Scaled log probabilities of ``roles``, from counts in messages whose role is known."""

    def __init__(self, roles: tuple[str, ...], lines: np.ndarray, sizes: np.ndarray, turns: np.ndarray, first: np.ndarray):
        def scaled(shares: np.ndarray) -> np.ndarray:
            return np.round(np.log(shares) * SCALE).astype(np.int64) << TIE_BITS

        def learned(counts: np.ndarray) -> np.ndarray:
            counts = counts + SMOOTHING
            return scaled(counts / counts.sum(axis=-1, keepdims=True))

        self.roles = roles
        self.emit, self.head, self.first, self.next = learned(lines), learned(sizes), learned(first), learned(turns)
        # The state before the first line of a conversation; no line can enter it.
        self.start = size = len(roles)
        self.within = scaled(np.full((size, size), DRIFT) + np.eye(size) * (1 - size * DRIFT))
        self.marked = scaled(np.full((size, size), MARKER_TRUST) + np.eye(size) * (1 - size * MARKER_TRUST))

    def steps(self, lines: np.ndarray) -> np.ndarray:
        """Score of each step from state to state, one table for each line (place, seen, mark, size, tie)."""
        place, seen, mark, size, tie = lines.T
        own = np.where(size[:, None] >= 0, self.head[:, size].T, self.emit[:, seen].T)
        own = own + np.where(mark[:, None] >= 0, self.marked[:, mark].T, 0)
        steady = (place == WITHIN) & (mark < 0)
        start, states = self.start, self.start + 1
        steps = np.full((len(lines), states, states), NEVER)
        steps[:, :start, :start] = np.where(steady[:, None, None], self.within, self.next)
        steps[:, start, :start] = self.first
        steps[:, :, :start] += own[:, None, :]
        chance = tie.astype(np.uint64)[:, None] * np.uint64(max(64, states**2)) + np.arange(states**2, dtype=np.uint64)
        return steps + (mix(chance) & np.uint64(2**TIE_BITS - 1)).astype(np.int64).reshape(steps.shape)


def _best(steps: np.ndarray) -> np.ndarray:
    """Best score from each state before the first step to each state after the last."""
    reached = np.where(np.eye(steps.shape[1], dtype=bool), 0, NEVER)
    for step in steps:
        reached = np.maximum((reached[:, :, None] + step[None]).max(axis=1), NEVER)
    return reached


def _path(steps: np.ndarray, before: int, after: int) -> list[int]:
    """States of all lines on the best way between two states."""
    score, back = np.where(np.arange(steps.shape[1]) == before, 0, NEVER), []
    for step in steps:
        ways = score[:, None] + step
        back.append(ways.argmax(axis=0))
        score = np.maximum(ways.max(axis=0), NEVER)
    states = [after]
    for choice in reversed(back[1:]):
        states.append(int(choice[states[-1]]))
    return states[::-1]


COUNTS = "role int, seen int, n long"
STEPS = "part int, first_conv long, first int, last_conv long, last int, n long"


def _counts(batches: Iterator[pa.RecordBatch], roles: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """How often each role shows each kind of line, and behind these kinds each size: one row for each, per task."""
    counts = np.zeros((len(roles), LENGTHS * SIGNS + SIZES), np.int64)
    for batch in batches:
        for role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for _, seen, _, size in parse(text, roles):
                counts[role, seen] += 1
                if size >= 0:
                    counts[role, LENGTHS * SIGNS + size] += 1
    role, seen = np.nonzero(counts)
    yield pa.record_batch([pa.array(role, pa.int32()), pa.array(seen, pa.int32()), pa.array(counts[role, seen])], names=["role", "seen", "n"])


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Steps from role to role in one range of sorted messages (conversation, turn, role, number of such messages).

    One row for each pair of roles, and one, without ``n``, for the range: its first and last conversation and role.
    """
    steps = np.zeros((size + 1, size), np.int64)
    edge = last = None
    for batch in batches:
        conv, role, n = (batch.column(i).to_numpy() for i in (0, 2, 3))
        if not len(conv):
            continue
        np.add.at(steps, (role, role), n - 1)
        same = conv[1:] == conv[:-1]
        np.add.at(steps, (np.where(same, role[:-1], FIRST), role[1:]), 1)
        if edge is None:
            edge = int(conv[0]), int(role[0])
        else:
            steps[last[1] if last[0] == conv[0] else FIRST, role[0]] += 1
        last = int(conv[-1]), int(role[-1])
    if edge is None:
        return
    part = TaskContext.get().partitionId()
    rows = [(part, None, a if a < size else FIRST, None, b, int(steps[a, b])) for a, b in zip(*(x.tolist() for x in np.nonzero(steps)), strict=True)]
    kinds = {"part": pa.int32(), "first_conv": pa.int64(), "first": pa.int32(), "last_conv": pa.int64(), "last": pa.int32(), "n": pa.int64()}
    yield _batch(pa.schema(kinds.items()), [*rows, (part, *edge, *last, None)])


def fit(messages: DataFrame, least_share: float = LEAST_SHARE) -> Model:
    """Learn from all messages of ``messages`` (``conv_id``, ``turn``, ``role``, ``text``) that name their role.

    Roles are the names in ``role``, in lower case, of at least ``least_share`` of the messages; ``ROLES`` if there is
    none. Messages without a conversation, turn or role are not learned from. Lines are counted in tasks, and so are
    steps from role to role, in ranges of sorted messages that may cut a conversation anywhere; only the sums for each
    role reach the driver.
    """
    role = F.lower("role").alias("name")
    known = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, F.col("text").cast("string").alias("text"))
    known = known.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND name IS NOT NULL")
    # At most one name for each ``least_share`` comes back.
    least = known.count() * least_share
    roles = tuple(sorted(row["name"] for row in known.groupBy("name").count().filter(F.col("count") >= least).collect())) or ROLES
    number = F.array_position(F.array(*(F.lit(name) for name in roles)), F.col("name")).cast("int") - 1
    known = known.withColumn("number", number).filter("number >= 0")
    size, kinds = len(roles), LENGTHS * SIGNS
    seen = np.zeros((size, kinds + SIZES))
    counted = known.select("number", "text").mapInArrow(partial(_counts, roles=roles), COUNTS)
    for row in counted.groupBy("role", "seen").agg(F.sum("n").alias("n")).collect():
        seen[row["role"], row["seen"]] = row["n"]
    order = ["conv_id", "turn", "number"]
    ranges = known.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = keep(ranges.mapInArrow(partial(_steps, size=size), STEPS), "steps")
    # One row for each range, in order: does it go on with the conversation that the range before it ended in?
    edges, before = found.filter("n IS NULL"), Window.orderBy("part")
    follows = F.lag("last_conv").over(before) == F.col("first_conv")
    joined = edges.select(F.when(follows, F.lag("last").over(before)).otherwise(FIRST).alias("first"), F.col("first").alias("last"), F.lit(1).alias("n"))
    steps = np.zeros((size + 1, size))
    for row in found.filter("n IS NOT NULL").select("first", "last", "n").union(joined).groupBy("first", "last").agg(F.sum("n").alias("n")).collect():
        steps[row["first"], row["last"]] = row["n"]
    return Model(roles, seen[:, :kinds], seen[:, kinds:], steps[:FIRST], steps[FIRST])


SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("turns", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("best", pa.list_(pa.int64()))]
)
SEGMENT = "conv_id long, part int, number int, turns array<long>, texts array<string>, best array<long>"
STATES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])


def _batch(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lines(turns: list[int | None], texts: list[str | None], roles: tuple[str, ...]) -> tuple[list[list[str]], np.ndarray]:
    """Text lines of each message; for all lines place, seen, mark, size and a number that decides ties."""
    parsed = [parse(text, roles) for text in texts]
    numbers = [
        (NEXT if i == 0 else WITHIN, *line[1:], ((turn or 0) * 8191 + i) & 0xFFFFFFFF)
        for turn, lines in zip(turns, parsed, strict=True)
        for i, line in enumerate(lines)
    ]
    return [[line[0] for line in lines] for lines in parsed], np.array(numbers, np.int64)


def _segments(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """One row for each run of one conversation in a batch; batches come sorted within range partitions."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows: list[list] = []
        for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not rows or conv != rows[-1][0]:
                number += 1
                rows.append([conv, part, number, [], []])
            rows[-1][3].append(turn)
            rows[-1][4].append(text)
        for row in rows:
            row.append(_best(model.value.steps(_lines(row[3], row[4], model.value.roles)[1])).ravel().tolist())
        yield _batch(SEGMENTS, rows)


def _chained(conversation: list[tuple]) -> list[tuple]:
    """Best states before and after each segment of one conversation, from their tables."""
    states = math.isqrt(len(conversation[0][2]))
    score, back = np.where(np.arange(states) == states - 1, 0, NEVER), []
    for _, _, table in conversation:
        ways = score[:, None] + np.array(table).reshape(states, states)
        back.append(ways.argmax(axis=0))
        score = np.maximum(ways.max(axis=0), NEVER)
    states = [int(score.argmax())]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    states.reverse()
    return [(part, number, states[i], states[i + 1]) for i, (part, number, _) in enumerate(conversation)]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations come whole and sorted, one row for each segment."""
    conv, held = None, []
    for batch in batches:
        found = []
        for own, *segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and own != conv:
                found += _chained(held)
                held = []
            conv = own
            held.append(segment)
        yield _batch(STATES, found)
    if held:
        yield _batch(STATES, _chained(held))


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("rendered", pa.string())])


def _rendered(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    roles = model.value.roles
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            bodies, lines = _lines(row["turns"], row["texts"], roles)
            states = iter(_path(model.value.steps(lines), row["before"], row["after"]))
            for turn, own in zip(row["turns"], bodies, strict=True):
                blocks: list[tuple[int, list[str]]] = []
                for line, state in zip(own, states, strict=False):
                    if not blocks or blocks[-1][0] != state:
                        blocks.append((state, []))
                    blocks[-1][1].append(line)
                for part, (state, block) in enumerate(blocks):
                    text = "\n".join(block).strip()
                    out.append((row["conv_id"], turn, part, roles[state], f"<|{roles[state]}|>\n{text}\n<|end|>\n"))
        yield _batch(TURNS, out)


def format_turns(messages: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``part``, ``role``, ``rendered``: canonical turns of every message.

    Roles are recovered from the texts and their order alone. A message becomes one turn, or several numbered parts
    where its speaker changes. NULL and empty texts are one empty line and get a turn; messages of one conversation and
    turn are ordered by text, repeated ones are kept; messages without a conversation id form one conversation, and
    those without a turn come first in theirs. Other columns are ignored.
    """
    own = messages.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").cast("string").alias("text")
    )
    order = ["conv_id", "turn", "text"]
    shared = messages.sparkSession.sparkContext.broadcast(model)
    # Range partitions split a long conversation by its turns.
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = keep(ordered.mapInArrow(partial(_segments, model=shared), SEGMENT), "segments")
    tables = segments.select("conv_id", "part", "number", "best").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    states = tables.mapInArrow(_chain, "part int, number int, before int, after int")
    walked = segments.select("conv_id", "part", "number", "turns", "texts").join(states, ["part", "number"])
    return walked.mapInArrow(partial(_rendered, model=shared), "conv_id long, turn long, part int, role string, rendered string")
