"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (role, starts a turn | goes on). A line shows its speaker marker,
whether it begins with a capital, its length class (blank is one) and its
last sign; given the state these are independent. Counts over the training
conversations give all probabilities. Viterbi runs over blocks of lines: a
block's transfer matrix (max-plus) is folded along its conversation, so that
a conversation of any length is decoded block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, shuffle_parts, stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r starts: 2r, goes on: 2r + 1
#: Speaker markers by role, as they stand at the start of a line.
MARKERS = {"system": r"(?i)^\s*(?:#+\s*|\[)?system(?:\])?\s*:\s?", "user": r"(?i)^\s*(?:#+\s*|\[)?(?:user|human|customer|q)(?:\])?\s*:\s?", "assistant": r"(?i)^\s*(?:#+\s*|\[)?(?:assistant|ai|bot|a)(?:\])?\s*:\s?"}
BLOCK = 2048
#: Sizes of the features: marker (none or a role), capital, length class, last sign.
SIZES = (4, 2, 4, 3)


def line_features(lines: DataFrame) -> DataFrame:
    """Add ``code`` to ``lines(line)``: its four features as one number."""
    line = F.coalesce("line", F.lit(""))
    marker = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES))):
        marker = F.when(line.rlike(MARKERS[role]), i + 1).otherwise(marker)
    size = F.length(F.trim(line))
    length = F.when(size == 0, 0).when(size < 40, 1).when(size < 160, 2).otherwise(3)
    last = F.when(F.rtrim(line).endswith("?"), 2).when(F.rtrim(line).endswith("."), 1).otherwise(0)
    return lines.withColumn("code", (((marker * 2 + line.rlike(r"^\s*\p{Lu}").cast("int")) * 4 + length) * 3 + last).cast("int"))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a sorted partition: each turn's place in its conversation, and the lines of it before."""
    turns = lines = 0
    last: object = _place  # no conversation's id
    for b in batches:
        turn, line = [], []
        for conv, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if conv != last or last is _place:
                turns, lines, last = 0, 0, conv
            turn.append(turns)
            line.append(lines)
            turns, lines = turns + 1, lines + n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turn, pa.int64()), pa.array(line, pa.int64())], [*b.schema.names, "turn", "before"])


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Each turn as raw transcript lines: ``conv``, ``turn``, ``at`` (in the turn), ``number`` (in the conversation), ``line``, ``role``.

    A conversation has one of four marker styles by a hash of its id; about
    one later turn in six has no marker, only a blank line before it.

    Turns are range-partitioned by (conversation, turn, role, text hash) and
    numbered where they lie. Only the conversations that go on from one range
    into the next, one for each range at most, need what the ranges before
    hold of them.
    """
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("given"), "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv"), F.lit(4))
    names = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "[system]: ", "user": "Human: ", "assistant": "AI: "}, {"system": "### System:\n", "user": "### User:\n", "assistant": "### Assistant:\n"}, {"system": "SYSTEM: ", "user": "Q: ", "assistant": "A: "}]
    head = F.lit("")
    for s, by_role in enumerate(names):
        for role, text in by_role.items():
            head = F.when((style == s) & (F.col("role") == role), F.lit(text)).otherwise(head)
    bare = (F.pmod(F.xxhash64("conv", "given"), F.lit(6)) == 0) & F.coalesce(F.col("given") > 0, F.lit(False))
    turns = turns.withColumn("raw", F.concat(F.when(bare, F.lit("\n")).otherwise(head), "text"))
    turns = turns.select("conv", "given", "role", F.size(F.split("raw", "\n", -1)).cast("long").alias("n"), "raw")
    order = [F.col("conv").asc_nulls_first(), F.col("given").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("raw")]
    dealt = turns.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = turns.schema["conv"].dataType.simpleString()
    dealt = stored(dealt.mapInArrow(_place, f"conv {kind}, given long, role string, n long, raw string, part int, turn long, before long"), "chat-turns")

    parts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("lines"))
    ahead = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    goes_on = parts.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.sum("turns").over(ahead).alias("turns"), F.sum("lines").over(ahead).alias("lines")).filter("turns > 0")
    rows = dealt.join(F.broadcast(goes_on), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    rows = rows.select("conv", (F.col("turn") + F.coalesce("turns", F.lit(0))).alias("turn"), "role", (F.col("before") + F.coalesce("lines", F.lit(0))).alias("before"), "raw")
    return rows.select("conv", "turn", "role", "before", F.posexplode(F.split("raw", "\n", -1)).alias("at", "line")).withColumn("number", F.col("before") + F.col("at")).drop("before")


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # log probabilities by state
    step: np.ndarray  # from, to
    show: np.ndarray  # code, state

    def transfer(self, codes: np.ndarray) -> np.ndarray:
        """Best log probability from each state before the block to each at its end."""
        m = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(m, 0.0)
        for c in codes:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + self.show[c]
        return m

    def decode(self, codes: np.ndarray, before: np.ndarray, last: int | None = None) -> np.ndarray:
        """The best states of a block; ``before``: scores of the first line's states without what it shows."""
        score, back = before + self.show[codes[0]], []
        for c in codes[1:]:
            way = score[:, None] + self.step
            back.append(way.argmax(axis=0))
            score = way.max(axis=0) + self.show[c]
        state = int(score.argmax()) if last is None else last
        path = [state]
        for b in reversed(back):
            state = int(b[state])
            path.append(state)
        return np.array(path[::-1])


def fit(lines: DataFrame, train: Column) -> Hmm:
    """Count over the lines of training conversations whose role is known; add one to every count.

    ``lines(conv, turn, at, role, code)``. The step between turns is counted
    from turns, not lines, so a step needs no order of all lines: within a
    turn a start is followed by the same role's going on.
    """
    lines = lines.filter(train & F.col("role").isin(*ROLES))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    state = role * 2 + (F.col("at") > 0).cast("int")
    shown = lines.groupBy(state.alias("state"), "code").agg(F.count(F.lit(1)).alias("n")).collect()
    turns = lines.groupBy("conv", "turn").agg(F.max(role).alias("r"), F.count(F.lit(1)).alias("n"))
    after = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    between = turns.join(after, ["conv", "turn"]).groupBy("r", "next", (F.col("n") > 1).alias("long")).agg(F.count(F.lit(1)).alias("c")).collect()
    inside = turns.groupBy("r").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("first"), F.sum(F.greatest(F.lit(0), F.col("n") - 2)).alias("later")).collect()
    opens = turns.filter("turn = 0").groupBy("r").agg(F.count(F.lit(1)).alias("c")).collect()
    start, step = np.full(STATES, 1e-3), np.full((STATES, STATES), 1e-3)
    for r in opens:
        start[2 * r["r"]] += r["c"]
    for r in inside:
        step[2 * r["r"], 2 * r["r"] + 1] += 1 + r["first"]
        step[2 * r["r"] + 1, 2 * r["r"] + 1] += 1 + r["later"]
    for r in between:
        step[2 * r["r"] + int(r["long"]), 2 * r["next"]] += 1 + r["c"]
    for r in range(len(ROLES)):  # unseen steps between roles stay possible
        step[2 * r : 2 * r + 2, ::2] += 0.1
    sizes = [np.ones((STATES, n)) for n in SIZES]
    for row in shown:
        code, s, n = row["code"], row["state"], row["n"]
        sizes[3][s, code % 3] += n
        sizes[2][s, code // 3 % 4] += n
        sizes[1][s, code // 12 % 2] += n
        sizes[0][s, code // 24] += n
    logs = [np.log(x / x.sum(axis=1, keepdims=True)) for x in sizes]
    codes = np.arange(int(np.prod(SIZES)))
    show = (logs[0][:, codes // 24] + logs[1][:, codes // 12 % 2] + logs[2][:, codes // 3 % 4] + logs[3][:, codes % 3]).T
    return Hmm(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), show)


def _transfers(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.transfer(np.array(c[1:] if k == 0 else c, dtype=int)).ravel().tolist() for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c[0] for c in b.column(2).to_pylist()], pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["conv", "block", "code", "transfer"])

    return run


def _fold(model: Hmm):
    """Along one conversation's blocks: the scores each begins with, the state before it (-1 at the start) and the state it ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blocks in enumerate(b.column(1).to_pylist()):
                score, begins, moves = model.start, [], []
                for j, x in enumerate(blocks):
                    m = np.array(x["transfer"]).reshape(STATES, STATES)
                    if j:
                        begins.append((score[:, None] + model.step).max(axis=0))
                        way = score[:, None] + m
                    else:
                        begins.append(score)
                        way = (score + model.show[x["code"]])[:, None] + m
                    moves.append(way.argmax(axis=0))
                    score = way.max(axis=0)
                ends = [int(score.argmax())]
                for m in reversed(moves[1:]):
                    ends.append(int(m[ends[-1]]))
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], n), pa.array([x["block"] for x in blocks], pa.int64()), pa.array([v.tolist() for v in begins], pa.list_(pa.float64())), pa.array([-1, *ends[:0:-1]], pa.int32()), pa.array(ends[::-1], pa.int32())], ["conv", "block", "begin", "prior", "last"])

    return run


def opening(states: np.ndarray, prior: int) -> np.ndarray:
    """Which lines open a turn: where a state says so, the role changes, or nothing is before (``prior`` is -1)."""
    before = np.append(prior, states[:-1])
    return (states % 2 == 0) | (before < 0) | (before // 2 != states // 2)


def _decode(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, opened = [], []
            for codes, begin, prior, last in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                states = model.decode(np.array(codes, dtype=int), np.array(begin), last)
                opens = opening(states, prior)
                turns = np.cumsum(opens)
                opened.append(int(turns[-1]))
                out.append([{"state": s, "opens": o, "nth": t} for s, o, t in zip(states.tolist(), opens.tolist(), turns.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("state", pa.int32()), ("opens", pa.bool_()), ("nth", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(opened, pa.int64()), pa.array(out, kind)], ["conv", "block", "opened", "found"])

    return run


def recovered_lines(lines: DataFrame, model: Hmm) -> DataFrame:
    """Add ``state``, ``opens`` and ``turn_no`` to ``lines(conv, number, code, ...)``; ``number`` counts a conversation's lines from 0.

    Turns are counted within blocks and over the blocks' totals, so that no
    conversation's lines meet in one task.
    """
    kind = lines.schema["conv"].dataType.simpleString()
    blocks = lines.groupBy("conv", F.expr(f"number div {BLOCK}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "code"))), lambda x: x["code"]).alias("codes"))
    blocks = stored(blocks, "chat-blocks")
    moves = blocks.mapInArrow(_transfers(model), f"conv {kind}, block long, code int, transfer array<double>")
    # 36 numbers stand for a block of lines here.
    folded = moves.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "code", "transfer"))).alias("blocks"))
    known = folded.mapInArrow(_fold(model), f"conv {kind}, block long, begin array<double>, prior int, last int")
    known = known.withColumnsRenamed({"conv": "c", "block": "b"})
    known = blocks.join(known, blocks["conv"].eqNullSafe(F.col("c")) & (blocks["block"] == F.col("b"))).select("conv", "block", "codes", "begin", "prior", "last")
    states = stored(known.mapInArrow(_decode(model), f"conv {kind}, block long, opened long, found array<struct<state:int,opens:boolean,nth:long>>"), "chat-states")
    # One row for each block.
    ahead = F.coalesce(F.sum("opened").over(W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = states.select(F.col("conv").alias("c"), F.col("block").alias("b"), ahead.alias("turns"))
    flat = states.join(turns, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("c", "block", "turns", F.posexplode("found").alias("i", "x"))
    flat = flat.select("c", (F.col("block") * BLOCK + F.col("i")).alias("n"), "x.state", "x.opens", (F.col("turns") + F.col("x.nth") - 1).alias("turn_no"))
    return lines.join(flat, lines["conv"].eqNullSafe(F.col("c")) & (lines["number"] == F.col("n"))).drop("c", "n")


def canonical_turns(lines: DataFrame) -> DataFrame:
    """``conv``, ``turn_no``, ``role``, ``text``, ``rendered`` from ``lines(conv, number, line, state, opens, turn_no)``; a turn's own lines meet in one row."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.expr("state div 2").cast("int") + 1)
    rows = lines.withColumn("role", role)
    bare = F.coalesce("line", F.lit(""))
    for pattern in MARKERS.values():
        bare = F.when(F.col("opens"), F.regexp_replace(bare, pattern, "")).otherwise(bare)
    rows = rows.withColumn("bare", bare).withColumn("skip", F.col("opens") & (F.trim("bare") == ""))
    parts = F.array_sort(F.collect_list(F.when(~F.col("skip"), F.struct("number", "bare"))))
    turns = rows.groupBy("conv", "turn_no").agg(F.first("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["bare"]), "\n").alias("text"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def chat_turns(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of ``conversations``, parsed back: ``conv_id``, ``turn_no``, ``role``, ``text``, ``rendered``, ``held_out``.

    The model learns from conversations whose crc32 of the id as text is no
    multiple of 5; ``held_out`` marks the rest. Null text is an empty line,
    texts of any length are taken whole; a null or unknown role is not learned
    from and gets no marker; rows of one conversation, turn and role stand by a
    hash of their text, equal rows are turns of their own; a null turn comes
    first, a null id is a conversation of its own. Empty tables give no rows;
    other columns are not looked at.
    """
    lean(conversations.sparkSession)
    lines = transcript_lines(conversations.select("conv_id", "turn", "role", "text"))
    lines = stored(line_features(lines), "chat-lines")
    held_out = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = fit(lines, ~held_out)
    turns = canonical_turns(recovered_lines(lines.select("conv", "number", "line", "code"), model))
    return turns.select(F.col("conv").alias("conv_id"), "turn_no", "role", "text", "rendered", held_out.alias("held_out"))
