"""Conversation structure repair by a time-major tensor DP.

A conversation should read s?(ua)+ by the initials of its roles, or be empty.
`repair` finds the cheapest edits that make it so:

* K, keep a row: 0.  R, set its role to user or assistant: 3.  Either costs 3
  more where the row is truncated; neither is open to blank or duplicate rows.
* D, delete a row: 4.  I, insert an empty user or assistant row anywhere: 3.

Four states tell what the pattern still allows: nothing read, after s, after u,
after a.  Conversations are bucketed by length and laid out time-major (turn,
conversation, state); one step per turn updates all conversations' state costs
from the last turn to the first and stores them.  The edits are then traced
forward, again all conversations a step: of the edits that reach the stored cost
the ASCII-least is taken, which makes the whole audit the least, since a letter
fixes the state that follows.

In Spark: faults of a row are column expressions.  A row is a duplicate unless it
is the first of its role and text; the first ones are an aggregation, whose
results are sorted in as marker rows, so that no join or window meets a common
text.  One shuffle brings each conversation's rows in order, first without their
texts (the costs need none) and then with them, so that a task streams a
conversation of any length: it holds a byte or two a row and its audit, not its
texts.  A long one is cut into pieces, solved side by side from each end state
(the costs are a min-plus product of the pieces) and traced from each state.
A conversation's digest runs over its whole text in order; so a conversation
goes through one task, as a stream.

Defined results: rows are ordered by turn (nulls first), then role, then md5 of
the text; a null role or text is one space; a role without a first character, or
with another one than s, u, a, cannot be kept; null conversation ids are one
conversation; repeated rows are duplicates; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = ("user", "assistant")
#: states: 0 nothing read, 1 after s, 2 after u, 3 after a; 4 stands for none
KEEP_TO = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: where an inserted or re-roled row leads: to u, but from u to a
NEXT = np.array([2, 2, 3, 2])
FAR = 1 << 40
#: costs of the end: insert what the pattern lacks
ENDS = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
TAIL = ("", "II", "I", "")
#: a row's code: initial (0 s, 1 u, 2 a, 3 other), 4 if it has to go, 8 if truncated; PAD stands past the end
PAD = 255
#: rows solved together, and rows from which a conversation is cut into pieces of PIECE rows
TOGETHER, LONG, PIECE = 8192, 4096, 256


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32 of `conv_id:turn`: lost, emptied, cut, repeated and re-roled rows."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    return out.where("kind <> 0").withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _row_code(role: Column, text: Column) -> Column:
    """The code of a row but for duplicates: initial, blank, truncated."""
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return (code + F.when(blank, 4).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 8).otherwise(0)).cast("int")


def ordered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The stream of a task: of each conversation of ids its head, then markers of first rows and the rows' codes in order, then the rows in the same order."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.col("text").cast("binary"))).withColumn("code", _row_code(F.col("role"), F.col("text")))
    first = rows.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("at"))
    none = F.lit(None)
    part = lambda df, phase, turn, role, key, kind, text, code: df.select(
        "conv_id", F.lit(phase).alias("phase"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), key.cast("string").alias("key"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), code.cast("int").alias("code")
    )
    col = F.col
    heads = part(ids.select("conv_id").groupBy("conv_id").agg(F.lit(0)), 0, none, none, none, 0, none, none)
    marks = part(first, 1, col("at.turn"), col("role"), col("key"), 0, none, none)
    codes = part(rows, 1, col("turn"), col("role"), col("key"), 1, none, col("code"))
    texts = part(rows, 2, col("turn"), col("role"), col("key"), 1, col("text"), none)
    every = heads.unionAll(marks).unionAll(codes).unionAll(texts).repartition("conv_id")
    return every.sortWithinPartitions("conv_id", "phase", "turn", "role", "key", "kind").select("conv_id", "phase", "turn", F.when(col("phase") == 2, col("role")).alias("role"), "kind", "text", "code")


def _closed(v: np.ndarray) -> np.ndarray:
    """State costs (..., 4) with insertions before the next row."""
    v[..., 2] = np.minimum(v[..., 2], v[..., 3] + INSERT)
    v[..., [0, 1, 3]] = np.minimum(v[..., [0, 1, 3]], v[..., 2:3] + INSERT)
    return v


def _options(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (conversations, 4) of deleting, keeping and re-roling a row of each conversation, by the state before it."""
    wide = np.concatenate([after, np.full((len(after), 1), FAR)], axis=1)
    gone = (code & 4 > 0)[:, None]
    more = np.where(code & 8 > 0, TRUNCATED, 0)[:, None]
    keep = np.where(gone, FAR, np.take_along_axis(wide, KEEP_TO[code & 3], axis=1) + more)
    rerole = np.where(gone, FAR, after[:, NEXT] + REROLE + more)
    return after + DELETE, keep, rerole


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs (turns + 1, conversations, 4) to the end, from codes (turns, conversations) and costs at the end."""
    costs = np.empty((len(codes) + 1, *ends.shape), np.int64)
    costs[-1] = ends
    for t in range(len(codes) - 1, -1, -1):
        new = _closed(np.minimum.reduce(_options(codes[t], costs[t + 1])))
        costs[t] = np.where((codes[t] == PAD)[:, None], costs[t + 1], new)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, which: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The ASCII-least cheapest edits of every walk until its rows are used up, and the states then.

    Walk i starts in state[i] and reads the column which[i] of codes and costs.
    """
    n, steps = len(state), []
    length = (codes != PAD).sum(axis=0)[which]
    t, state, live = np.zeros(n, np.int64), state.copy(), np.flatnonzero(length > 0)
    while len(live):
        at, s, c = t[live], state[live], which[live]
        row, after, now = codes[at, c], costs[at + 1, c], costs[at, c, s]
        delete, keep, rerole = (x[np.arange(len(live)), s] for x in _options(row, after))
        insert = costs[at, c, NEXT[s]] + INSERT
        letter = np.select([delete == now, insert == now, keep == now], [68, 73, 75], 82)
        steps.append(np.zeros(n, np.uint8))
        steps[-1][live] = letter
        state[live] = np.select([letter == 68, letter == 75], [s, KEEP_TO[row & 3, s]], NEXT[s])
        t[live] += letter != 73
        live = live[t[live] < length[live]]
    if not steps:
        return [b""] * n, state
    letters = np.ascontiguousarray(np.stack(steps).T)
    return [x[x > 0].tobytes() for x in letters], state


def solve(many: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and audit of each conversation, given its rows' codes; buckets by length."""
    out: list = [(0, "")] * len(many)
    buckets: dict[int, list[int]] = {}
    for i, codes in enumerate(many):
        buckets.setdefault(len(codes).bit_length(), []).append(i)
    for bits, own in buckets.items():
        codes = np.full((1 << bits, len(own)), PAD, np.uint8)
        for c, i in enumerate(own):
            codes[: len(many[i]), c] = many[i]
        costs = backward(codes, np.tile(ENDS, (len(own), 1)))
        audits, state = trace(codes, costs, np.zeros(len(own), np.int64), np.arange(len(own)))
        for c, i in enumerate(own):
            out[i] = (int(costs[0, c, 0]), audits[c].decode() + TAIL[state[c]])
    return out


def solve_long(codes: np.ndarray, piece: int = PIECE) -> tuple[int, str]:
    """As solve, for one long conversation: pieces side by side, of all costs only those at pieces' ends are kept."""
    span = piece * piece
    starts = range(0, len(codes), span)
    cut = lambda low: np.concatenate([codes[low : low + span], np.full(-len(codes[low : low + span]) % piece, PAD, np.uint8)]).reshape(-1, piece).T
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    held, end = {}, ENDS
    for low in reversed(starts):
        block = cut(low)
        ways = backward(np.repeat(block, 4, axis=1), np.tile(unit, (block.shape[1], 1)))[0].reshape(-1, 4, 4)
        ends = np.empty((block.shape[1], 4), np.int64)
        for p in range(block.shape[1] - 1, -1, -1):
            ends[p] = end
            end = (ways[p] + end[:, None]).min(axis=0)
        held[low] = ends
    audit, state = [], 0
    for low in starts:
        block = cut(low)
        costs = backward(block, held.pop(low))
        p = np.repeat(np.arange(block.shape[1]), 4)
        audits, exits = trace(block, costs, np.tile(np.arange(4), block.shape[1]), p)
        for i in range(block.shape[1]):
            audit.append(audits[4 * i + state])
            state = int(exits[4 * i + state])
    return int(end[0]), b"".join(audit).decode() + TAIL[state]


class _Conversation:
    """One conversation as it streams by: first its codes, then its rows."""

    def __init__(self, conv):
        self.conv, self.parts, self.rows = conv, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.n = 0
        self.low = self.high = self.initial = None
        self.marked = False
        self.cost, self.audit = 0, ""
        self.at, self.state, self.place, self.hash = 0, 0, 0, hashlib.sha256()

    def see(self, kind: np.ndarray, code: np.ndarray, turn: pa.Array) -> None:
        """Markers and codes in order; a row right after its marker is the first of its kind."""
        before = np.concatenate([[0 if self.marked else 1], kind[:-1]])
        self.marked = kind[-1] == 0
        row = kind == 1
        code, first = code[row].astype(np.uint8), before[row] == 0
        if not len(code):
            return
        blank = code & 4 > 0
        duplicate = ~blank & ~first
        self.blank += int(blank.sum())
        self.duplicate += int(duplicate.sum())
        self.truncated += int((~duplicate & (code & 8 > 0)).sum())
        initial = code & 3
        pairs = np.concatenate([[] if self.initial is None else [self.initial], initial]).astype(np.int64)
        self.illegal += int((~np.isin(pairs[:-1] * 4 + pairs[1:], (1, 6, 9))).sum())
        self.initial = int(initial[-1])
        told = turn.filter(pa.array(row)).drop_null().to_numpy(zero_copy_only=False)
        if len(told):
            self.turns += 1 + int((told[1:] != told[:-1]).sum()) - (self.high is not None and told[0] == self.high)
            self.low = int(told[0]) if self.low is None else self.low
            self.high = int(told[-1])
        self.n += len(code)
        self.parts.append(np.where(duplicate, (code | 4) & ~np.uint8(8), code))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def codes(self) -> np.ndarray:
        codes = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint8)
        self.parts = []
        return codes

    def insertions(self):
        """The lines to insert here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = int(NEXT[self.state])
            yield self._line(ROLES[self.state - 2], "")

    def read(self, role: str, text: str):
        """The repaired lines that a row leads to."""
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(KEEP_TO["sua".index(role[0]), self.state])
            yield self._line(role, text)
        elif letter == "R":
            self.state = int(NEXT[self.state])
            yield self._line(ROLES[self.state - 2], text)

    def _line(self, role: str, text: str):
        self.hash.update((("\n" if self.place else "") + role + ":" + text).encode("utf-8", "replace"))
        self.place += 1
        return self.conv, self.place - 1, role, text


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _stream(batches, lines: bool):
    """Lists of results: summaries, or the lines of the repaired conversations."""
    out: list[tuple] = []
    waiting: list[_Conversation] = []
    load = 0
    now: _Conversation | None = None

    def close(c: _Conversation) -> None:
        rest = list(c.insertions())
        if lines:
            out.extend(rest)
        else:
            out.append((c.conv, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, c.hash.hexdigest()))

    def say(c: _Conversation, roles, texts) -> None:
        for role, text in zip(roles, texts, strict=True):
            said = c.read(role, text)
            out.extend(said) if lines else [None for _ in said]

    def flush() -> None:
        for c, (c.cost, c.audit) in zip(waiting, solve([c.codes() for c in waiting]), strict=True):
            for roles, texts in c.rows:
                say(c, roles.to_pylist(), texts.to_pylist())
            close(c)
        waiting.clear()

    for batch in batches:
        conv, phase, turn, role, kind, text, code = batch.columns
        runs = pc.run_end_encode(conv)
        low = 0
        for high, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            phases = phase.slice(low, high - low).to_numpy()
            a, b = low + np.searchsorted(phases, [1, 2])
            if phases[0] == 0:
                if now is not None:
                    if now.n > LONG:
                        close(now)
                    else:
                        waiting.append(now)
                        load += now.n
                    if load >= TOGETHER:
                        flush()
                        load = 0
                now = _Conversation(name)
            if b > a:
                now.see(kind.slice(a, b - a).to_numpy(), pc.fill_null(code.slice(a, b - a), 0).to_numpy(zero_copy_only=False), turn.slice(a, b - a))
            if high > b:
                if now.n > LONG and not now.audit:
                    now.cost, now.audit = solve_long(now.codes())
                if now.audit:
                    say(now, role.slice(b, high - b).to_pylist(), text.slice(b, high - b).to_pylist())
                else:
                    now.rows.append((role.slice(b, high - b), text.slice(b, high - b)))
            low = high
            if len(out) >= TOGETHER:
                yield out
                out = []
    if now is not None:
        if now.n > LONG:
            close(now)
        else:
            waiting.append(now)
    flush()
    yield out


def _run(rows: DataFrame, ids: DataFrame | None, lines: bool, fields: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    stream = ordered(rows, rows if ids is None else ids)
    schema = f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, {fields}"
    conv = to_arrow_type(stream.schema["conv_id"].dataType)
    kinds = [conv, *((pa.int64(), pa.string(), pa.string()) if lines else (*[pa.int64()] * 6, pa.string(), pa.string()))]
    names = ["conv_id", *(("place", "role", "text") if lines else SUMMARY)]

    def run(batches):
        for found in _stream(batches, lines):
            columns = zip(*found, strict=True) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return stream.mapInArrow(run, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ids (else of rows)."""
    return _run(rows, ids, False, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the rows of the repaired conversations, in order of place."""
    return _run(rows, None, True, "place long, role string, text string")
