"""Repair of the turn structure of conversations, cheapest edits first, by prefix-doubling path ranking.

A conversation's rows have to give the role initials ``(s?(ua)+)?``: a system
turn or none, then user and assistant in turn, or nothing at all.  Edits are D
(delete), I (insert an empty turn), K (keep) and R (give another role).

Nodes are (rows taken, state of the pattern).  A pass from the end finds each
node's least cost and its optimal arcs, those that lie on a cheapest repair.
Among them the edits whose initials read least in ASCII are wanted.  Nodes are
ranked by the next 1, 2, 4, ... letters of their best path: the rank for 2L
letters is the rank of (rank for L, rank for L of the node L letters on), and
that node's pointer is followed twice.  The ranks pick the arc at each node, and
the doubled pointers spell the path.

Rows reach a task sorted by conversation, which is streamed: of its texts no
more than ``HELD`` bytes stay in memory, the rest lies in a file of the task's
own until the repair is known, as a digest has to read them in order.  Of a long
conversation a byte of facts per row stays, and ``SPAN`` rows are ranked at a
time, from the end on.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.session import text_batches

#: States of the pattern: nothing yet, after s, after u, after a.  The first and the last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted turn, or a turn of a new role, leads to.
ONWARD = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Letters by rank; 0 is the end of the path.
LETTERS = " DIKR"
END, D, I, K, R = range(5)

#: Facts of a row in one byte: role initial (0 other, 1 s, 2 u, 3 a), and flags.
MUST_GO, IS_TRUNCATED = 4, 8

HELD = 8 << 20
#: Rows ranked at a time; short conversations are ranked together up to as many.
SPAN = 1 << 15

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _kept(state: int, role: int) -> int | None:
    """The state after a kept turn, if the pattern allows it."""
    if role == 1:
        return SYSTEM if state == START else None
    if role == 2:
        return USER if state != USER else None
    return ASSISTANT if role == 3 and state == USER else None


def _inserts(cost: list[int]) -> list[int]:
    """Costs from each state with inserted turns before what ``cost`` holds for the bare states; two inserts change nothing."""
    c = list(cost)
    for _ in range(2):
        c = [min(c[s], INSERT + c[ONWARD[s]]) for s in range(4)]
    return c


_FAR = 1 << 40


@lru_cache(maxsize=None)
def _step(after: tuple[int, ...], fact: int) -> tuple[tuple[int, ...], int, tuple[tuple[tuple[int, int, int], ...], ...]]:
    """From the costs after a row to those before it: their form less the least, the least, and each state's optimal arcs (letter, rows taken, state)."""
    stay = [DELETE] * 4
    arcs: list[list[tuple[int, int, int, int]]] = []
    for s in range(4):
        own = [(DELETE + after[s], D, 1, s)]
        if not fact & MUST_GO:
            more = TRUNCATED if fact & IS_TRUNCATED else 0
            to = _kept(s, fact & 3)
            if to is not None:
                own.append((KEEP + more + after[to], K, 1, to))
            own.append((REROLE + more + after[ONWARD[s]], R, 1, ONWARD[s]))
        stay[s] = min(a[0] for a in own)
        arcs.append(own)
    cost = _inserts(stay)
    for s in range(4):
        arcs[s].append((INSERT + cost[ONWARD[s]], I, 0, ONWARD[s]))
    best = tuple(tuple(a[1:] for a in arcs[s] if a[0] == cost[s]) for s in range(4))
    low = min(cost)
    return tuple(c - low for c in cost), low, best


def _end() -> tuple[tuple[int, ...], tuple[tuple[tuple[int, int, int], ...], ...]]:
    cost = _inserts([0, _FAR, _FAR, 0])
    return tuple(cost), tuple(() if s in (START, ASSISTANT) else ((I, 0, ONWARD[s]),) for s in range(4))


@lru_cache(maxsize=None)
def _arc_table(arcs: tuple[tuple[tuple[int, int, int], ...], ...]) -> np.ndarray:
    """(state, arc, [letter, how far on among nodes]); unused arcs have a letter beyond all."""
    out = np.zeros((4, 4, 2), np.int64)
    out[:, :, 0] = len(LETTERS)
    for s, own in enumerate(arcs):
        for k, (letter, rows, to) in enumerate(own):
            out[s, k] = letter, 4 * rows + to - s
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks, from 0 and without gaps, of rows of keys."""
    code = keys[0]
    for k in keys[1:]:
        code = code * (int(k.max(initial=0)) + 1) + k
    return np.unique(code, return_inverse=True)[1].reshape(-1)


def _ranked_arcs(arcs: np.ndarray, ends: np.ndarray, tail: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(letters, doubled pointers, ranks) of all nodes.

    arcs: (node, arc, [letter, offset]).  ends: nodes where paths leave, each
    with its rank in ``tail``.  The least letter among a node's arcs settles its
    arc unless two have it; then the rank of where they lead does, round by
    round, as both are ranked by as many letters.
    """
    node = np.arange(len(arcs))
    target = np.clip(node[:, None] + arcs[:, :, 1], 0, len(arcs) - 1)
    first = arcs[:, :, 0].min(axis=1)
    first[ends] = 0
    # Letters of arcs come first, so that of all ends only the ranks differ.
    base = int(tail.max(initial=0)) + 1
    rank = first * base
    rank[ends] = tail
    rank = _dense(rank)
    pointers: list[np.ndarray] = []
    reach = 1
    while True:
        key = arcs[:, :, 0] * (int(rank.max(initial=0)) + 1) + rank[target]
        at = key.argmin(axis=1)
        onward = np.where(first > 0, target[node, at], node)
        if not pointers:
            pointers.append(onward)
        else:
            # The same arcs as before, unless a tie was settled by longer ranks.
            pointers = [onward]
            for _ in range(reach.bit_length() - 1):
                pointers.append(pointers[-1][pointers[-1]])
        if reach >= longest:
            return first, pointers, rank
        # Of an end only its own rank counts, however long the path.
        rank = _dense(rank, np.where(first > 0, rank[pointers[-1]] + 1, 0))
        reach *= 2


def _spell(start: int, letters: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """Nodes of the path from start on, up to where it leaves, put together from pointers of falling powers of two."""
    path = np.array([start])
    for p in reversed(pointers):
        path = np.stack([path, p[path]], axis=1).reshape(-1)
    end = letters[path] == 0
    return path[: int(end.argmax())] if end.any() else path


def repair_many(facts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(cost, letters) of each conversation, given a byte of facts per row; see the module."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(facts)
    at = 0
    while at < len(facts):
        n, many = len(facts[at]), at + 1
        while many < len(facts) and n + len(facts[many]) <= SPAN:
            n, many = n + len(facts[many]), many + 1
        if n > SPAN:
            out[at] = _repair_long(facts[at])
        else:
            out[at:many] = _repair_together(facts[at:many])
        at = many
    return out


def _backward(facts: np.ndarray, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, list]:
    """Costs before the first row, what was taken off them, and each row's optimal arcs."""
    arcs, total = [None] * len(facts), 0
    for k in range(len(facts) - 1, -1, -1):
        after, low, arcs[k] = _step(after, int(facts[k]))
        total += low
    return after, total, arcs


def _repair_together(facts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    last, at_end = _end()
    tables, costs, starts, ends, tails = [], [], [], [], []
    for f in facts:
        before, total, arcs = _backward(f, last)
        costs.append(before[START] + total)
        starts.append(4 * len(tables))
        tables += [_arc_table(a) for a in arcs]
        ends += [4 * len(tables) + START, 4 * len(tables) + ASSISTANT]
        tables.append(_arc_table(at_end))
    tails = np.zeros(len(ends), np.int64)
    # A row takes an insert or two beside its own edit at most.
    longest = 3 * max(map(len, facts), default=0) + 3
    letters, pointers, _ = _ranked_arcs(np.concatenate(tables), np.array(ends), tails, longest)
    return [(c, letters[_spell(s, letters, pointers)]) for c, s in zip(costs, starts, strict=True)]


def _repair_long(facts: np.ndarray) -> tuple[int, np.ndarray]:
    """The same for one conversation of any length, a span at a time: costs and ranks pass from the end to the front, the path from the front to the end."""
    last, at_end = _end()
    spans = [(a, min(a + SPAN, len(facts))) for a in range(0, len(facts), SPAN)]
    state, total, known = last, 0, {}
    # Ranks of the four nodes behind the last row: an end has nothing to come, others an insert or two.
    tail = np.array([0, 2, 1, 0])
    for a, b in reversed(spans):
        known[a] = state, tail
        state, low, arcs = _backward(facts[a:b], state)
        total += low
        _, _, rank = _span_ranks(arcs, tail)
        tail = _dense(rank[:4])
    cost, node, out = state[START] + total, START, []
    for a, b in spans:
        after, tail = known[a]
        letters, pointers, _ = _span_ranks(_backward(facts[a:b], after)[2], tail)
        path = _spell(node, letters, pointers)
        out.append(letters[path])
        node = int(pointers[0][path[-1]]) - 4 * (b - a)
    # What is inserted behind the last row.
    while node in (SYSTEM, USER):
        out.append(np.array([I]))
        node = ONWARD[node]
    return cost, np.concatenate(out)


def _span_ranks(arcs: list, tail: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    n = len(arcs)
    tables = np.concatenate([*map(_arc_table, arcs), np.zeros((4, 4, 2), np.int64)])
    return _ranked_arcs(tables, 4 * n + np.arange(4), tail, 3 * n + 3)


def repaired(rows: Iterator[tuple[str, str]], letters: np.ndarray) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; takes no more rows than there are edits of rows."""
    state = START
    for x in letters:
        if x == I:
            state = ONWARD[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if x == D:
            continue
        state = ONWARD[state] if x == R else _kept(state, "_sua".find(role[:1]) if role else 0)
        yield (ROLE[state] if x == R else role), text


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy): rows damaged by crc32 of ``conv:turn`` modulo 20; a null counts as one blank.

    Classes: 0 drops the row (copy is null then, so that its conversation is not
    forgotten), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4
    makes its role user.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = df.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("_class"),
    )
    kind = F.col("_class")
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("copy", F.explode(copies))
    rows = rows.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind == 0, "").otherwise(F.col("text")))
    return rows.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role"))).drop("_class")


def faults(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate and truncated, a row's first fault in that order, and initial (0 other, 1 s, 2 u, 3 a) to rows (conv_id, turn, role, text, copy).

    A row is a duplicate if its conversation has its role and text before it; so
    equal rows are numbered where they meet, by the text, not by conversation.
    """
    space = r"[\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{space}*\z")
    here = F.col("copy").isNotNull()
    again: Column = F.row_number().over(Window.partitionBy("conv_id", "role", "text", here).orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when(F.length("role") > 0, initial).otherwise(0)
    d = rows.withColumn("blank", blank).withColumn("duplicate", again & ~F.col("blank"))
    return d.withColumn("truncated", cut & ~F.col("blank") & ~F.col("duplicate")).withColumn("initial", initial)


class _Open:
    """A conversation while its rows come in."""

    def __init__(self, conv: int | None):
        self.conv, self.facts, self.roles, self.turns, self.counts = conv, bytearray(), [], [0, None, None], [0, 0, 0]
        self.sizes: list[int] = []
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, turn: int | None, role: str, text: str, fact: int, fault: int) -> None:
        self.facts.append(fact)
        if fault:
            self.counts[fault - 1] += 1
        if turn is not None:
            if turn != self.turns[2]:
                self.turns[0] += 1
            self.turns[1] = turn if self.turns[1] is None else self.turns[1]
            self.turns[2] = turn
        for x in (role.encode(), text.encode()):
            self.file.write(len(x).to_bytes(8, "little"))
            self.file.write(x)

    def rows(self) -> Iterator[tuple[str, str]]:
        self.file.seek(0)
        while head := self.file.read(8):
            role = self.file.read(int.from_bytes(head, "little")).decode()
            yield role, self.file.read(int.from_bytes(self.file.read(8), "little")).decode()


def _illegal(initials: np.ndarray) -> int:
    """Neighbours that are not su, ua or au."""
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2)))).sum())


def _close(many: list[_Open]) -> pa.RecordBatch:
    out = []
    facts = [np.frombuffer(bytes(c.facts), np.uint8) for c in many]
    for c, f, (cost, letters) in zip(many, facts, repair_many(facts), strict=True):
        digest, between = hashlib.sha256(), b""
        for role, text in repaired(c.rows(), letters):
            digest.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
        c.file.close()
        n, low, high = c.turns
        audit = np.frombuffer(LETTERS.encode(), np.uint8)[letters].tobytes().decode()
        out.append((c.conv, high - low + 1 - n if n else 0, *c.counts, _illegal(f & 3), cost, audit, digest.hexdigest()))
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[_Open] = []
    rows = size = 0
    now: _Open | None = None
    for b in batches:
        conv, turn, role, text, fact, fault = (c.to_pylist() for c in b.columns)
        for k in range(b.num_rows):
            if now is None or conv[k] != now.conv:
                if rows >= SPAN or size >= HELD or len(done) >= 4096:
                    yield _close(done)
                    done, rows, size = [], 0, 0
                now = _Open(conv[k])
                done.append(now)
            if fact[k] is not None:
                now.add(turn[k], role[k], text[k], fact[k], fault[k])
                rows, size = rows + 1, size + len(text[k])
    if done:
        yield _close(done)


def repair_conversations(df: DataFrame) -> DataFrame:
    """A row for each conv_id of a damaged table (see ``damaged``): its faults, the least cost, the edits and a digest of what they make.

    A conversation of which no row is left has zeros and an empty audit.  A null
    conv_id is a conversation of its own; rows of one turn stand in the order of
    role and text; equal rows are each other's duplicates; an empty table gives
    none.  A digest and an audit follow one conversation from its first row to
    its last, so one task streams it, whatever its length.
    """
    text_batches(df.sparkSession, 4000, 16)
    fault = F.when(F.col("blank"), 1).when(F.col("duplicate"), 2).when(F.col("truncated"), 3).otherwise(0)
    flags = F.when(F.col("blank") | F.col("duplicate"), MUST_GO).when(F.col("truncated"), IS_TRUNCATED).otherwise(0)
    fact = F.when(F.col("copy").isNotNull(), F.col("initial") + flags)
    rows = faults(damaged(df)).select("conv_id", "turn", "role", "text", "copy", fact.alias("fact"), fault.alias("fault"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")
    return ordered.select("conv_id", "turn", "role", "text", "fact", "fault").mapInArrow(_stream, RESULT)
