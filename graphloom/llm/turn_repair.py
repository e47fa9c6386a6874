"""Repair of conversations whose turns are missing, empty, repeated, cut short or out of role.

Roles must spell nothing, or a system turn if any and then user and assistant
in turn. The states of that grammar are nothing yet (0), after the system turn
(1), an assistant is due (2), and after an assistant (3). A dynamic program
from the last row back gives the cost to go of each row and state; a walk from
the first row on then takes, of the edits that the cost to go allows, the one
whose letter is least in ASCII, which gives the least of all cheapest edits.
Then the turns are rebuilt and hashed.

Rows are dealt by ranges of (conversation, turn), so a very long conversation
lies in several partitions one after another. What it has in one of them is a
piece: a 4 x 4 table of costs from state to state, and counts. Only
conversations that a border between partitions cuts have more than one piece,
at most one for each border, so that the driver can join their tables; each
piece is then walked by its own task with the cost to go at its end and the
state at its start. A hash takes its bytes in order, so the bytes of a cut
conversation pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.llm.common import table, tidy, width

SPACE = " \t\n\x0b\f\r"
NEVER = 1 << 60
DUE = ("user", "user", "assistant", "user")  # what an inserted or changed role is, by state
TO = (2, 2, 3, 2)  # and the state that it leads to
KEEPS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
END = (0, NEVER, NEVER, 0)
RIGHT = {"su", "ua", "au"}
FLUSH = 1 << 20  # characters of a cut conversation's chunk
#: Fault codes.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: the rows as the damage leaves them; null roles and texts are one space.

    By crc32 of ``conv:turn`` modulo 20: 0 drops the row (gone), 1 empties its
    text, 2 takes its full stops, question and exclamation marks, 3 repeats it,
    4 makes it a user's.
    """
    kind = F.crc32(F.concat(_said(F.col(conv)), F.lit(":"), _said(F.col(turn))).cast("binary")) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), _said(F.col(role)).alias("role"), _said(F.col(text)).alias("text"), kind.alias("kind"))
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, gone) with the first fault of each: blank, seen before in its conversation, or cut short."""
    same = Window.partitionBy("conv", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.withColumn("fault", fault)


def options(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state: the (letter, cost, next state) that a row allows, least letter first."""
    out, extra = [], 5 if fault == TRUNCATED else 0
    for state in range(4):
        ways = [("D", 2, state)]
        if fault in (0, TRUNCATED):
            kept = KEEPS.get(initial, (-1,) * 4)[state]
            ways += [("K", extra, kept)] * (kept >= 0) + [("R", 1 + extra, TO[state])]
        out.append(ways)
    return out


OPTIONS = {(i, f): options(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def inserted(costs: list) -> list:
    """Costs to go where turns may also be put in before the row."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, 5 + out[TO[s]]) for s, c in enumerate(out)]
    return out


def back(rows: list[tuple[str, int]], end) -> list[list]:
    """The cost to go before each row, and after the last, by state; ``rows`` are (initial, fault)."""
    to_go = inserted(end)
    out = [to_go]
    for row in reversed(rows):
        to_go = inserted([min(cost + to_go[to] for _, cost, to in ways) for ways in OPTIONS[row]])
        out.append(to_go)
    return out[::-1]


def forward(rows: list[tuple[str, int]], to_go: list[list], state: int, last: bool):
    """(row or None, letter, role put in or changed or None) of the least letters that the cost to go allows; returns the state at the end.

    Turns put in after the last row belong to the piece behind, but for the last piece.
    """
    n = len(rows)
    for i in range(n + 1):
        while True:
            here = to_go[i][state]
            ways = OPTIONS[rows[i]][state] if i < n else []
            taken = next((w for w in ways if w[1] + to_go[i + 1][w[2]] == here), None)
            put_in = 5 + to_go[i][TO[state]] == here and (i < n or last and not (state in (0, 3) and here == 0))
            if put_in and (taken is None or taken[0] > "I"):
                yield None, "I", DUE[state]
                state = TO[state]
                continue
            break
        if taken:
            yield i, taken[0], DUE[state] if taken[0] == "R" else None
            state = taken[2]
    return state


def table_of(rows: list[tuple[str, int]]) -> list[int]:
    """Costs from each state before the rows to each after them, row by row, turns put in behind them not counted."""
    columns = []
    for end in range(4):
        to_go = [0 if s == end else NEVER for s in range(4)]
        for row in reversed(rows):
            to_go = inserted([min(cost + to_go[to] for _, cost, to in ways) for ways in OPTIONS[row]])
        columns.append(to_go)
    return [min(columns[e][s], NEVER) for s in range(4) for e in range(4)]


class Piece:
    """Rows of a conversation within a partition, and the counts that need no text."""

    def __init__(self, conv):
        self.conv, self.rows, self.faults, self.illegal = conv, [], [0, 0, 0, 0], 0
        self.first = self.before = self.low = self.high = None
        self.turns, self.last_turn = 0, None
        self.content: list[tuple[str, str]] = []

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in RIGHT
        else:
            self.first = initial
        self.before = initial
        self.rows.append((initial if initial in KEEPS else "", fault))
        self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        if text is not None:
            self.content.append((role, text))

    def said(self, state: int, to_go: list[list], last: bool):
        """(letter, line or None) in order, the state at the end by ``StopIteration``."""
        for i, letter, role in forward(self.rows, to_go, state, last):
            if letter == "I":
                yield letter, f"{role}:"
            elif letter == "D":
                yield letter, None
            else:
                yield letter, f"{role or self.content[i][0]}:{self.content[i][1]}"


def _pieces(batches, with_text: bool):
    """The pieces of a partition sorted by conversation and turn, with whether each is its first or last."""
    piece, first = None, True
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        for conv, turn, role, text, gone, fault in zip(*columns, strict=True):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    yield piece, first, False
                    first = False
                piece = Piece(conv)
            if not gone:
                piece.add(turn, role, text if with_text else None, fault)
    if piece is not None:
        yield piece, first, True


BORDER = "part int, place int, conv string, costs array<long>, faults array<int>, illegal int, first string, last string, low long, high long, turns long"


@tidy
def _borders(batches):
    """The first and the last piece of a partition, which may be parts of longer conversations."""
    part = TaskContext.get().partitionId()
    for k, (p, first, last) in enumerate(_pieces(batches, False)):
        if first or last:
            one = lambda x, kind: pa.array([x], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    one(part, pa.int32()), one(k, pa.int32()), one(None if p.conv is None else str(p.conv), pa.string()), one(table_of(p.rows), pa.list_(pa.int64())), one(p.faults, pa.list_(pa.int32())), one(p.illegal, pa.int32()),
                    one(p.first, pa.string()), one(p.before, pa.string()), one(p.low, pa.int64()), one(p.high, pa.int64()), one(p.turns, pa.int64()),
                ],
                [f.split()[0] for f in BORDER.split(", ")],
            )


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(rows) -> dict:
    """(part, conversation) of each cut piece to its end costs, its place, whether it is the last, and the whole's counts."""
    chains: list[list] = []
    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        if chains and chains[-1][-1]["part"] != r["part"] and chains[-1][-1]["conv"] == r["conv"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    out = {}
    for chain in chains:
        if len(chain) < 2:
            continue
        ends, end = [], list(END)
        for r in reversed(chain):
            ends.append(end)
            end = inserted(end)
            end = [min(r["costs"][4 * s + e] + end[e] for e in range(4)) for s in range(4)] if any(r["faults"]) else end
        ends.reverse()
        counts = np.array([r["faults"] for r in chain]).sum(0)
        illegal, before = sum(r["illegal"] for r in chain), None
        low = high = None
        turns = 0
        for r in chain:
            if r["first"] is not None:
                illegal += before is not None and before + r["first"] not in RIGHT
                before = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        gaps = high - low + 1 - turns if low is not None else 0
        totals = [int(gaps), int(counts[BLANK]), int(counts[DUPLICATE]), int(counts[TRUNCATED]), int(illegal), int(inserted(end)[0])]
        # the state at each start is found when the pieces before it are walked
        for k, r in enumerate(chain):
            out[(r["part"], r["conv"])] = (ends[k], k, k == len(chain) - 1, totals)
    return out


def _whole(ids: pa.DataType, cut: dict):
    """Results of the conversations that lie within a partition."""

    @tidy
    def run(batches):
        part, out = TaskContext.get().partitionId(), []

        def rows():
            columns = list(zip(*out, strict=True))
            kinds = [ids] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["conv_id", *(f.split()[0] for f in RESULT.split(", "))])

        for p, _, _ in _pieces(batches, True):
            if (part, None if p.conv is None else str(p.conv)) in cut:
                continue
            digest, letters, lines = hashlib.sha256(), [], 0
            to_go = back(p.rows, END)
            for letter, line in p.said(0, to_go, True):
                letters.append(letter)
                if line is not None:
                    digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
                    lines += 1
            gaps = p.high - p.low + 1 - p.turns if p.low is not None else 0
            out.append((p.conv, gaps, p.faults[BLANK], p.faults[DUPLICATE], p.faults[TRUNCATED], p.illegal, to_go[0][0], "".join(letters), digest.hexdigest()))
            if len(out) == 1000:
                yield rows()
                out = []
        if out:
            yield rows()

    return run


def _end_states(cut: dict):
    """For each cut piece, the state at its end for each state at its start."""

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        for p, _, _ in _pieces(batches, False):
            key = (part, None if p.conv is None else str(p.conv))
            if key in cut:
                end, place, last, _ = cut[key]
                to_go, states = back(p.rows, end), []
                for state in range(4):
                    at = state
                    if to_go[0][state] < NEVER:
                        walk = forward(p.rows, to_go, state, last)
                        while True:
                            try:
                                next(walk)
                            except StopIteration as done:
                                at = done.value
                                break
                    states.append(at)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key[1]], pa.string()), pa.array([place], pa.int32()), pa.array([states], pa.list_(pa.int32()))], ["part", "conv", "place", "states"])

    return run


def _chunks(ids: pa.DataType, cut: dict, starts: dict):
    """Letters and bytes of the cut pieces, in chunks."""

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        for p, _, _ in _pieces(batches, True):
            key = (part, None if p.conv is None else str(p.conv))
            if key not in cut:
                continue
            end, place, last, totals = cut[key]

            def chunk(k, letters, body, conv=p.conv, place=place, totals=totals):
                return pa.RecordBatch.from_arrays([pa.array([conv], ids), pa.array([place], pa.int32()), pa.array([k], pa.int64()), pa.array(["".join(letters)], pa.string()), pa.array(["".join(body).encode("utf-8", "surrogatepass")], pa.binary()), pa.array([totals], pa.list_(pa.int64()))], ["conv_id", "place", "k", "letters", "body", "totals"])

            letters, body, held, k = [], [], 0, 0
            for letter, line in p.said(starts[key], back(p.rows, end), last):
                letters.append(letter)
                if line is not None:
                    body.append("\n" + line)
                    held += len(line) + 1
                if held >= FLUSH or len(letters) >= FLUSH:
                    yield chunk(k, letters, body)
                    letters, body, held, k = [], [], 0, k + 1
            yield chunk(k, letters, body)

    return run


def _hashed(ids: pa.DataType):
    """Results from sorted chunks, one conversation after another."""

    @tidy
    def run(batches):
        now, digest, letters, totals, begun = None, None, None, None, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], ids), *(pa.array([t], pa.int64()) for t in totals), pa.array(["".join(letters)], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", *(f.split()[0] for f in RESULT.split(", "))])

        for batch in batches:
            for conv, text, body, sums in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5)), strict=True):
                if now != (conv,):
                    if now:
                        yield row()
                    now, digest, letters, totals, begun = (conv,), hashlib.sha256(), [], sums, False
                letters.append(text)
                digest.update(body if begun else body[1:])
                begun |= bool(body)
        if now:
            yield row()

    return run


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation of damaged ``df``.

    Null roles and texts are one space; null turns come first and make no gaps;
    rows of one turn go by role, then text. A null conv_id is a conversation of
    its own. A conversation that the damage leaves no row has zeros, an empty
    audit and the hash of nothing. Texts of any length are taken whole. An
    empty table gives no rows; other columns of ``df`` don't matter.
    """
    return repaired(damaged(df, conv, turn, role, text), df.schema[conv].dataType.simpleString(), parts)


def repaired(rows: DataFrame, kind: str, parts: int | None = None) -> DataFrame:
    """As ``repair``, of rows (conv, turn, role, text, gone) that are taken as they are; ``kind`` is the type of conv."""
    spark = rows.sparkSession
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("conv", F.col("conv").cast("string")), "string"
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    rows = marked(rows.withColumn("turn", F.col("turn").cast("long")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    ranges = [*order[:2], F.substring("role", 1, 16).asc(), F.substring("text", 1, 32).asc()]
    dealt = rows.select("conv", "turn", "role", "text", "gone", "fault").repartitionByRange(parts or width(spark), *ranges).sortWithinPartitions(*order)
    dealt = keep(dealt, dealt=True)  # its partitions stay as they are for the passes that follow
    short = dealt.select("conv", "turn", F.substring("role", 1, 1).alias("role"), F.lit(None).cast("string").alias("text"), "gone", "fault")
    cut = _joined(short.mapInArrow(_borders, BORDER).collect())
    whole = dealt.mapInArrow(_whole(ids, cut), f"conv_id {kind}, {RESULT}")
    if not cut:
        return whole
    states = {(r["part"], r["conv"]): r["states"] for r in short.mapInArrow(_end_states(cut), "part int, conv string, place int, states array<int>").collect()}
    starts, state = {}, 0
    for key in sorted(cut, key=lambda k: k[0]):
        state = 0 if cut[key][1] == 0 else state
        starts[key], state = state, states[key][state]
    chunks = dealt.mapInArrow(_chunks(ids, cut, starts), f"conv_id {kind}, place int, k long, letters string, body binary, totals array<long>")
    in_order = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "place", "k")
    return whole.unionByName(in_order.mapInArrow(_hashed(ids), f"conv_id {kind}, {RESULT}"))


def query(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
