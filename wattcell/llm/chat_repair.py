"""Cheapest repair of the role order of conversations, by block tables (the method of the Four Russians).

A turn is one of ten symbols: what must go (blank or duplicate), or a role class with a mark for a truncated text, or
nothing (padding). A repaired conversation is read by an automaton of four states: nothing yet, after an
opening system turn, after a user turn, after an answer. The costs of having reached each state are a vector of four
numbers; less its smallest number it is one of a hundred or so normal vectors. For every normal vector and every block of
``BLOCK`` symbols a table, made from the one-symbol rule, holds the next normal vector and the cost that
was taken off. So costs take one lookup a block.

The edits are traced in two steps, since the ASCII-least of equally cheap edit strings cannot be chosen
from the end (insertions make strings of unequal length). Blocks are expanded backward from the last: from the stored
vector at a block's start its rows are run again, and the states on some cheapest path are marked. Then the
edits are read forward, the least letter first that stays on marked states at no extra cost.

Spark brings the turns of a conversation into order twice. The first time only marks travel (role initial, fault,
number of copies): a task reads a conversation as it streams by, keeps one byte a turn, and returns the report with
the edits. The second time the texts follow the report of their conversation, and the edits turn the stream into the
hash of the repaired conversation, one turn in memory at a time. Duplicates are found before, by the smallest turn of
every (conversation, role, digest of the text), aggregated ahead of the shuffle, so that a conversation of any size is
neither collected nor compared with itself. Its edits are one string of the result and so pass through one task, as
does its hash, which has no parallel form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.session import materialize

BLOCK = 4
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ANSWER = range(4)
FAR = 1 << 30
#: Symbols: 0 to 3 whole turns with initial s, u, a or another, 4 to 7 the same truncated, 8 to be deleted, 9 nothing.
GONE, NOTHING = 8, 9
SYMBOLS = 10
#: Where the automaton goes from (state, initial).
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ANSWER, (ANSWER, 1): USER}
#: The only role that may be inserted or given in a state.
NEEDS = {START: 1, SYSTEM: 1, USER: 2, ANSWER: 1}
ACCEPTED = (START, ANSWER)


def steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn: letter, cost, state after it; sorted by letter."""
    if symbol == NOTHING:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED if symbol >= 4 else 0
        initial = symbol % 4
        if (state, initial) in NEXT:
            out.append(("K", extra, NEXT[state, initial]))
        out.append(("R", REROLE + extra, NEXT[state, NEEDS[state]]))
    return out


def closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The vector when turns may be inserted as well."""
    out = list(costs)
    for _ in range(3):
        for state, role in NEEDS.items():
            after = NEXT[state, role]
            out[after] = min(out[after], out[state] + INSERT)
    return tuple(out)


def after(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    out = [FAR] * 4
    for state, cost in enumerate(costs):
        for _, price, target in steps(symbol, state):
            out[target] = min(out[target], cost + price)
    out = list(closed(tuple(out)))
    # An answered state does all that these two do, at 2 more at most: dearer ones lie on no cheapest path.
    for state in (START, SYSTEM):
        if out[state] > out[ANSWER] + 8:
            out[state] = FAR
    return tuple(out)


FIRST = closed((0, FAR, FAR, FAR))


def _normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(FAR if c >= FAR else c - low for c in costs), low


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Normal vectors (the first is the start), and per (vector, block number) the next vector and the cost."""
    vectors, place = [FIRST], {FIRST: 0}
    moves: list[list[tuple[int, int]]] = []
    for vector in vectors:
        if len(vectors) > 10_000:
            raise ValueError("normal vectors do not close")
        row = []
        for symbol in range(SYMBOLS):
            new, low = _normal(after(vector, symbol))
            if new not in place:
                place[new] = len(vectors)
                vectors.append(new)
            row.append((place[new], low))
        moves.append(row)
    one = np.array(moves, np.int32)
    target = np.arange(len(vectors), dtype=np.int32)[:, None]
    price = np.zeros_like(target)
    for _ in range(BLOCK):
        price = (price[:, :, None] + one[target, :, 1]).reshape(len(vectors), -1)
        target = one[target, :, 0].reshape(len(vectors), -1)
    return vectors, target, price


def block_numbers(symbols: bytes) -> np.ndarray:
    padded = np.frombuffer(symbols + bytes([NOTHING]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
    return padded @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).astype(np.int16)


def repair(symbols: bytes) -> tuple[int, str]:
    """Cost and edit letters of the cheapest repair, ties by the ASCII-least string; some five bytes of memory a turn."""
    vectors, target, price = tables()
    numbers, at, cost = block_numbers(symbols), 0, 0
    starts = np.empty(len(numbers), np.int16)
    for k, number in enumerate(numbers):
        starts[k] = at
        cost += int(price[at, number])
        at = int(target[at, number])
    ends = vectors[at]
    low = min(ends[s] for s in ACCEPTED)
    alive = _marked(ends, frozenset(s for s in ACCEPTED if ends[s] == low))
    last = _choices(ends, alive, {})
    marked = [alive] * len(numbers)
    for k in reversed(range(len(numbers))):
        marked[k] = alive
        alive, _ = _expanded(int(starts[k]), symbols[k * BLOCK : (k + 1) * BLOCK], alive)
    letters, state = bytearray(), START
    for k in range(len(numbers) + 1):
        block = _expanded(int(starts[k]), symbols[k * BLOCK : (k + 1) * BLOCK], marked[k])[1] if k < len(numbers) else (last,)
        for plan in block:
            while state in plan:
                letter, state = plan[state]
                letters += letter.encode()
                if letter != "I":
                    break
    return cost + low, letters.decode()


@lru_cache(maxsize=1 << 16)
def _expanded(start: int, block: bytes, alive: frozenset[int]) -> tuple[frozenset[int], tuple[dict, ...]]:
    """The marked states before a block, given those after it, and the edits of each of its turns."""
    run = [tables()[0][start]]
    for symbol in block:
        run.append(after(run[-1], symbol))
    plans = []
    for i in reversed(range(len(block))):
        edits: dict[int, list[tuple[str, int]]] = {}
        for state in range(4):
            for letter, paid, goal in steps(block[i], state):
                if goal in alive and run[i][state] < FAR and run[i][state] + paid == run[i + 1][goal]:
                    edits.setdefault(state, []).append((letter, goal))
        alive = _marked(run[i], frozenset(edits))
        plans.append(_choices(run[i], alive, edits))
    return alive, tuple(reversed(plans))


def _marked(costs: tuple[int, ...], alive: frozenset[int]) -> frozenset[int]:
    """The states on a cheapest path, with those that reach one by insertions."""
    for _ in range(3):
        alive = alive | {s for s, role in NEEDS.items() if NEXT[s, role] in alive and costs[s] + INSERT == costs[NEXT[s, role]]}
    return alive


def _choices(costs: tuple[int, ...], alive: frozenset[int], edits: dict[int, list[tuple[str, int]]]) -> dict[int, tuple[str, int]]:
    """The ASCII-least edit from every marked state before a turn."""
    plan = {}
    for state in alive:
        options = list(edits.get(state, []))
        goal = NEXT[state, NEEDS[state]]
        if (edits or state not in ACCEPTED) and goal in alive and costs[state] + INSERT == costs[goal]:
            options.append(("I", goal))
        if options:
            plan[state] = min(options)
    return plan


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
INITIALS = ("s", "u", "a")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = {USER: "user", ANSWER: "assistant"}
SPACE = " \t\n\x0b\f\r"


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row for every conversation.

    Turns count in the order of their number (whole, nulls first), then role, then MD5 of the text. Each has at most
    one fault, the first that fits: blank (nothing but space), duplicate (its role and text stood earlier), truncated
    (its last character but space is none of ``.!?``). ``gaps`` are the numbers that lack between the first and the last
    turn, ``illegal`` the neighbours whose role initials are not su, ua or au. ``audit`` are the initials of the
    cheapest edits (Keep, Rerole, Delete, Insert) that leave ``(s?(ua)+)?``, the ASCII-least of equal cost.

    ``copies`` says how often a row counts, 0 for a row that is not there: a conversation of such rows only has zeros,
    no audit, and the hash of nothing. Null roles and texts are one space, so such texts are blank, and such
    roles are neither s, u nor a, as are empty ones. Rows with a null conversation form one conversation. Repeated rows
    are duplicates. Other columns play no part; no rows give no rows.
    """
    blank_for = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank_for).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), blank_for).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    reports = _reports(_marks(rows))
    report = F.struct(*[c for c in reports.columns if c != "conv"])
    texts = rows.where("copies > 0").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast(reports.select(report).schema[0].dataType).alias("report"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
    heads = reports.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"),
        report.alias("report"),
    )
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    conv_type = rows.schema["conv"].dataType.simpleString()
    found = both.select("conv", "kind", "role", "text", "report").mapInArrow(_hashed, f"conv {conv_type}, {REPORT}, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv_col)


def _marks(rows: DataFrame) -> DataFrame:
    """Equal turns as one row: ``conv, turn, role, digest, n, blank, whole, first`` (``first``: no earlier turn is equal)."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    marks = rows.select("conv", "turn", "role", "digest", "copies", (trimmed == "").alias("blank"), F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("whole"))
    counted = marks.groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("whole").alias("whole"))
    counted = materialize(counted, "turns")
    firsts = counted.where("n > 0").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    joined = counted.alias("c").join(
        firsts.alias("f"), F.expr("c.conv <=> f.conv AND c.role = f.role AND c.digest = f.digest AND struct(c.turn) = f.least"), "left"
    )
    return joined.select("c.*", F.col("f.least").isNotNull().alias("first"))


def _reports(marks: DataFrame) -> DataFrame:
    initial = F.substring("role", 1, 1)
    ordered = marks.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    ordered = ordered.select("conv", "turn", initial.alias("initial"), "n", "blank", "whole", "first")
    conv_type = marks.schema["conv"].dataType.simpleString()
    return materialize(ordered.mapInArrow(_audited, f"conv {conv_type}, {REPORT}"), "reports")


class _Audit:
    """Report of a conversation whose turns come in order."""

    def __init__(self, conv: pa.Array):
        self.conv, self.symbols = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, initial: str, n: int, blank: bool, whole: bool, first: bool) -> None:
        if n == 0:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.numbers = turn, self.numbers + 1
        self.illegal += n - 1 + (self.before is not None and (self.before, initial) not in LEGAL)
        self.before = initial
        if blank:
            self.blank += n
            self.symbols += bytes([GONE]) * n
            return
        self.duplicate += n - first
        if first:
            self.truncated += not whole
            self.symbols.append((INITIALS.index(initial) if initial in INITIALS else 3) + (0 if whole else 4))
        self.symbols += bytes([GONE]) * (n - first)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *repair(bytes(self.symbols))


def _batch(convs: list[pa.Array], found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(convs), *map(pa.array, zip(*found))], names=names)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *[c.split()[0] for c in REPORT.split(", ")]]
    now = None
    for batch in batches:
        convs, done = batch.column("conv"), []
        for i, (conv, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if now is None or conv != now.conv[0].as_py():
                if now is not None:
                    done.append(now)
                now = _Audit(convs.slice(i, 1))
            now.add(*row)
        if done:
            yield _batch([a.conv for a in done], [a.report() for a in done], names)
    if now is not None:
        yield _batch([now.conv], [now.report()], names)


class _Rebuilt:
    """Hash of a repaired conversation, made from its edits and the turns in order."""

    def __init__(self, conv: pa.Array, report: dict):
        self.conv, self.report, self.edits = conv, report, iter(report["audit"])
        self.hash, self.state, self.any = sha256(), START, False

    def put(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any, self.state = True, state

    def insertions(self) -> str | None:
        """Makes the insertions that come next, and returns the edit after them."""
        for letter in self.edits:
            if letter != "I":
                return letter
            state = NEXT[self.state, NEEDS[self.state]]
            self.put(ROLES[state], "", state)
        return None

    def add(self, role: str, text: str) -> None:
        letter = self.insertions()
        if letter == "K":
            self.put(role, text, NEXT[self.state, INITIALS.index(role[0])])
        elif letter == "R":
            state = NEXT[self.state, NEEDS[self.state]]
            self.put(ROLES[state], text, state)

    def row(self) -> tuple:
        self.insertions()
        return *self.report.values(), self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *[c.split()[0] for c in REPORT.split(", ")], "repaired_sha256"]
    now = None
    for batch in batches:
        convs, kinds, done = batch.column("conv"), batch.column("kind").to_pylist(), []
        roles, texts, reports = batch.column("role"), batch.column("text"), batch.column("report")
        for i, kind in enumerate(kinds):
            if kind == 0:
                if now is not None:
                    done.append(now)
                now = _Rebuilt(convs.slice(i, 1), reports[i].as_py())
            else:
                now.add(roles[i].as_py(), texts[i].as_py())
        if done:
            yield _batch([r.conv for r in done], [r.row() for r in done], names)
    if now is not None:
        yield _batch([now.conv], [now.row()], names)
