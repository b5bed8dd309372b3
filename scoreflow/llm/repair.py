"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation is sound if its roles are empty or an optional system turn and then pairs of user and
assistant. Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2), Insert an empty
user or assistant turn (5); a row that is blank or repeats an earlier one must go, and a truncated row
that stays costs 5 more. Which edit is legal depends on the last role alone, so there are four states:
nothing yet, system, user, assistant. Of all cheapest edits the one whose initials come first in ASCII
is taken.

The cost vector of a row border has, for each state, the least cost and the place of its edits among
those of the other states in ASCII order; that order is all that ties need, as no state's edits are
the start of another's. Forward and backward vectors meet in the middle of a run of rows, the crossing
with the least sum, then the least order, is taken, and both halves are solved alike. Memory is linear
in the run, and vectors are looked up: only few differ once their least cost is subtracted.

On Spark: conversations are cut in blocks of ``BLOCK`` rows. One block is solved in its task. Blocks of
longer conversations give 4 x 4 matrices (cost and order from each entry state), whose products are
associative; ``scan.borders`` decides the states at all block borders, and every block is solved on its
own between them. Repeats are found by an aggregate over hashes, not by a task for each conversation.

Null conv_id, role and text count as one space (a null text is blank); null turns come first. Rows of
the same turn are ordered by role, then text; rows alike in all are repeats of the first. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.llm.common import ranked
from scoreflow.llm.scan import borders

BLOCK = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the role that an inserted or renamed turn gets
NAMES = ("", "system", "user", "assistant")
ENDS = (NOTHING, ASSISTANT)
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FAR = 1 << 40
BLANK, REPEAT, TRUNCATED = 1, 2, 3
Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs, and the places of the states in order


def kind_of(initial: str, fault: int) -> int:
    """What decides the edits of a row: 0 must go; else role and whether it is cut off."""
    return 0 if fault in (BLANK, REPEAT) else 1 + 2 * max(0, " sua".find(initial)) + (fault == TRUNCATED)


def steps(kind: int, state: int) -> list[tuple[int, str, int]]:
    """(state after the row, initials, cost) of all edits of a row, after inserted turns or none."""
    out, word, cost = [], "", 0
    for _ in range(3):
        out.append((state, word + "D", cost + DELETE))
        if kind:
            role, cut = (kind - 1) // 2, CUT_OFF * ((kind - 1) % 2)
            if role == NEXT[state] or (role == SYSTEM and state == NOTHING):
                out.append((role, word + "K", cost + KEEP + cut))
            out.append((NEXT[state], word + "R", cost + RENAME + cut))
        state, word, cost = NEXT[state], word + "I", cost + INSERT
    return out


STEPS = [[steps(kind, state) for state in range(4)] for kind in range(9)]
# Inserted turns after the last row: (state, initials, cost).
TAILS = [[(s, "", 0), (NEXT[s], "I", INSERT), (NEXT[NEXT[s]], "II", 2 * INSERT)] for s in range(4)]


def start(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in range(4)), (0, 1, 2, 3)


def _least(costs: Sequence[int]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low if c < FAR else FAR for c in costs), low


def _order(costs: list[int], keys: list) -> Vector:
    """A vector whose states are in the order of their keys; states out of reach come last."""
    place = sorted(range(4), key=lambda s: (costs[s] >= FAR, keys[s] if costs[s] < FAR else (), s))
    return tuple(min(c, FAR) for c in costs), tuple(place.index(s) for s in range(4))


@lru_cache(maxsize=1 << 16)
def forward(vector: Vector, kind: int) -> tuple[Vector, int]:
    """The vector after a row, less its least cost, and that cost."""
    costs, order = vector
    best: list = [(FAR, (9, ""))] * 4
    for s in range(4):
        if costs[s] < FAR:
            for t, word, cost in STEPS[kind][s]:
                best[t] = min(best[t], (costs[s] + cost, (order[s], word)))
    out, places = _order([c for c, _ in best], [k for _, k in best])
    least, low = _least(out)
    return (least, places), low


@lru_cache(maxsize=1 << 16)
def backward(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """Least costs from the border before a row to the end, less the least of them."""
    return _least([min((costs[t] + c for t, _, c in STEPS[kind][s]), default=FAR) for s in range(4)])


def solve(kinds: Sequence[int], entry: int, leave: int) -> list[str]:
    """The initials for each row: cheapest from ``entry`` to ``leave``, then least in ASCII."""
    out = [""] * len(kinds)
    todo = [(0, len(kinds), entry, leave)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            out[lo] = min((cost, word) for t, word, cost in STEPS[kinds[lo]][a] if t == b)[1]
            continue
        if hi == lo:
            continue
        mid = (lo + hi) // 2
        vector, back = start(a), start(b)[0]
        for k in kinds[lo:mid]:
            vector = forward(vector, k)[0]
        for k in reversed(kinds[mid:hi]):
            back = backward(back, k)[0]
        cross = min(range(4), key=lambda s: (vector[0][s] + back[s], vector[1][s]))
        todo += [(lo, mid, a, cross), (mid, hi, cross, b)]
    return out


def matrix(kinds: Sequence[int]) -> list[Vector]:
    """For each entry state the vector after the rows, costs in full."""
    out = []
    for s in range(4):
        vector, total = start(s), 0
        for k in kinds:
            vector, low = forward(vector, k)
            total += low
        out.append((tuple(c + total if c < FAR else FAR for c in vector[0]), vector[1]))
    return out


def applied(vector: Vector, m: list[Vector]) -> tuple[Vector, tuple[int, ...]]:
    """The vector after a block, and the entry state that each exit state comes from."""
    best: list = [(FAR, (9, 9), 0)] * 4
    for s in range(4):
        if vector[0][s] < FAR:
            for t in range(4):
                if m[s][0][t] < FAR:
                    best[t] = min(best[t], (vector[0][s] + m[s][0][t], (vector[1][s], m[s][1][t]), s))
    return _order([b[0] for b in best], [b[1] for b in best]), tuple(b[2] for b in best)


def times(a: list[Vector], b: list[Vector]) -> list[Vector]:
    """The product of two matrices; it is associative."""
    return [applied(row, b)[0] for row in a]


def chosen(vector: Vector) -> tuple[int, str, int]:
    """Exit state, inserted turns and cost of the best sound end."""
    found = []
    for s in range(4):
        if vector[0][s] < FAR:
            found += [(vector[0][s] + cost, vector[1][s], word, s) for t, word, cost in TAILS[s] if t in ENDS]
    cost, _, word, s = min(found)
    return s, word, cost


def _product(matrices: Sequence[bytes]) -> bytes:
    out = pickle.loads(matrices[0])
    for m in matrices[1:]:
        out = times(out, pickle.loads(m))
    return pickle.dumps(out)


def _ends(whole: bytes) -> tuple[bytes, bytes]:
    return bytes([NOTHING]), bytes([chosen(applied(start(NOTHING), pickle.loads(whole))[0])[0]])


def _route(matrices: Sequence[bytes], entry: bytes, leave: bytes) -> list[bytes]:
    vector, sources = start(entry[0]), []
    for m in matrices:
        vector, source = applied(vector, pickle.loads(m))
        sources.append(source)
    states = [leave[0]]
    for source in reversed(sources):
        states.append(source[states[-1]])
    return [bytes([s]) for s in reversed(states)]


EDITS = ("conv_id long, block long, place long, turn long, edit string, was string, role string, text string, "
         "fault int, cost long")
ARROW_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()),
    ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("cost", pa.int64())])
ROWS_AT_ONCE = 1024


class Run:
    """The rows of one (conversation, block), from rows, marks of repeats and a row of states."""

    def __init__(self, conv: int | None, block: int):
        self.conv, self.block = conv, block
        self.rows: list[list] = []  # rank, turn, role, text, fault
        self.repeats: set[int] = set()
        self.state: int | None = None

    def add(self, rank: int, turn: int | None, role: str | None, text: str | None, fault: int, state: int | None) -> None:
        if state is not None:
            self.state = state
        elif fault == REPEAT:
            self.repeats.add(rank)
        else:
            self.rows.append([rank, turn, role, text, fault])

    def kinds(self) -> list[int]:
        for row in self.rows:
            if row[4] != BLANK and row[0] in self.repeats:
                row[4] = REPEAT
        return [kind_of((row[2] or "")[:1], row[4]) for row in self.rows]

    def edits(self) -> Iterator[tuple]:
        """All edits in order, the turns inserted at the end of the conversation last."""
        kinds = self.kinds()
        if self.state is None:
            state, last = NOTHING, True
            leave = chosen(applied(start(NOTHING), matrix(kinds))[0])[0]
        else:
            state, leave, last = self.state >> 3, self.state >> 1 & 3, self.state & 1
        place = 0
        for (_, turn, role, text, fault), kind, word in zip(self.rows, kinds, solve(kinds, state, leave)):
            cut = CUT_OFF * (kind > 0 and (kind - 1) % 2)
            for letter in word:
                if letter == "I":
                    state = NEXT[state]
                    made = (None, "I", None, NAMES[state], "", None, INSERT)
                elif letter == "D":
                    made = (turn, "D", role, role, text, fault, DELETE)
                elif letter == "K":
                    state = (kind - 1) // 2
                    made = (turn, "K", role, role, text, fault, KEEP + cut)
                else:
                    state = NEXT[state]
                    made = (turn, "R", role, NAMES[state], text, fault, RENAME + cut)
                yield self.conv, self.block, place, *made
                place += 1
        for _ in next(word for t, word, _ in TAILS[state] if t in ENDS) if last else "":
            state = NEXT[state]
            yield self.conv, self.block, place, None, "I", None, NAMES[state], "", None, INSERT
            place += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    run = None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "block", "rank", "turn", "role", "fault", "state")]
        for (conv, block, rank, turn, role, fault, state), text in zip(zip(*columns), batch["text"]):
            if run is None or (run.conv, run.block) != (conv, block):
                if run:
                    yield run
                run = Run(conv, block)
            run.add(rank, turn, role, text.as_py(), fault, state)
    if run:
        yield run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_EDITS.types)], schema=ARROW_EDITS)

    for run in _runs(batches):
        for edit in run.edits():
            rows.append(edit)
            if len(rows) >= ROWS_AT_ONCE:
                yield made()
                rows.clear()
    if rows:
        yield made()


def _block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([run.conv], pa.int64()), pa.array([run.block], pa.int64()), pa.array([pickle.dumps(matrix(run.kinds()))], pa.binary())],
            names=["uid", "chunk", "matrix"])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after damage: the crc32 of ``conv_id:turn`` drops, empties, cuts off, repeats or renames."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(F.encode(named, "utf-8")) % 20).alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(again).alias("again")).drop("again")


def _parts(turns: DataFrame, block: int) -> DataFrame:
    """Rows in order with their faults, and marks of the rows that repeat an earlier one."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = ranked(rows, ["conv_id"], ["turn", "role", "text"]).withColumn("block", F.expr(f"rank div {block}"))
    end = F.regexp_extract("text", r"([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*\z", 1)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    said = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = rows.select("conv_id", "size", "block", "rank", said.alias("said"))
    first = narrow.groupBy("conv_id", "said").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows"))
    first = first.where("rows > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    marks = narrow.join(first, narrow["conv_id"].eqNullSafe(first["c"]) & (narrow["said"] == first["s"]) & (F.col("rank") > F.col("first")))
    none = F.lit(None).cast("int").alias("state")
    return rows.select("conv_id", "size", "block", "rank", "turn", "role", "text", fault.alias("fault"), none).unionAll(
        marks.select("conv_id", "size", "block", "rank", F.lit(None).cast("long"), F.lit(None).cast("string"),
                     F.lit(None).cast("string"), F.lit(REPEAT), none))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "rank")


def repair(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All edits in order, one row each; conversations of one block, and longer ones, apart.

    ``edit`` is K, R, D or I; ``role, text`` what the row says after it, ``was`` the role before,
    ``fault`` 0, 1 blank, 2 repeat, 3 truncated. ``block, place`` order the edits of a conversation. The
    repaired conversation is what is not deleted. Edits of a short conversation lie together in order.
    """
    parts = checkpointed(_parts(turns, block))
    short = _together(parts.where(F.col("size") <= block)).mapInArrow(_solved, EDITS)
    long = parts.where(F.col("size") > block)
    if long.isEmpty():
        return short, long.sparkSession.createDataFrame([], EDITS)
    found = _together(long.withColumn("text", F.lit(None).cast("string"))).mapInArrow(
        _block_matrices, "uid long, chunk long, matrix binary")
    # A conversation without a name is one conversation; joins need a name.
    named = checkpointed(found.withColumn("uid", F.coalesce(F.col("uid").cast("string"), F.lit("-"))))
    states = borders(named, _product, _ends, _route)
    most = named.groupBy("uid").agg(F.max("chunk").alias("most"))
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("int")
    state = number("entry") * 8 + number("leave") * 2 + (F.col("chunk") == F.col("most")).cast("int")
    states = states.join(most, "uid").select(
        F.col("uid").try_cast("long"), F.lit(0).cast("long"), F.col("chunk"), F.lit(-1).cast("long"), F.lit(None).cast("long"),
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), state)
    return short, _together(long.unionAll(states)).mapInArrow(_solved, EDITS)


DIGESTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
COUNTS = DIGESTS.split(", ")[1:7]


class Digest:
    """Counts, audit and digest of one conversation, from its edits in order."""

    def __init__(self, conv: int | None):
        self.conv, self.first, self.last, self.turns = conv, None, None, 0
        self.faults, self.illegal, self.cost, self.before = [0] * 4, 0, 0, None
        self.audit, self.sha, self.said = [], hashlib.sha256(), False

    def add(self, turn: int | None, edit: str, was: str | None, role: str, text: str, fault: int | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if fault is not None:
            self.faults[fault] += 1
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if self.before is not None:
                self.illegal += self.before[:1] + was[:1] not in ("su", "ua", "au")
            self.before = was
        if edit != "D":
            self.sha.update(f"{chr(10) if self.said else ''}{role}:{text}".encode())
            self.said = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    here, rows = None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "edit", "was", "role", "text", "fault", "cost")]
        for conv, *edit in zip(*columns):
            if here is None or here.conv != conv:
                if here:
                    rows.append(here.row())
                here = Digest(conv)
            here.add(*edit)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows = []
    if here:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(here.row(), kinds)], names=names)


def digests(short: DataFrame, long: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: counts, cost, audit and digest of the repaired text.

    The digest is one of a whole conversation, so a long one is streamed through one task.
    """
    sorted_ = long.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    return short.mapInArrow(_digest, DIGESTS).unionAll(sorted_.mapInArrow(_digest, DIGESTS))
