"""Chat formatting by columnar byte assembly, and the reader that inverts it.

A turn is header + escaped text + footer. Control strings inside texts get a backslash in front,
backslashes are doubled, so a reader finds every turn again. For a slice of turns, the lengths of
all segments give their offsets in one output buffer; headers and contents are scattered into it
with numpy index arrays, and the buffer becomes the Arrow column without further copies.

A conversation is one output row. Only a conversation beyond ``PIECE_BYTES`` spans several
(``piece`` 0, 1, ...), so that memory stays bounded; their texts concatenated are the conversation.
``mask`` lists [start, end) in code points of the piece: the texts of assistant turns.

Turns are ordered by turn, role, text (nulls first). Null role and null text count as empty. Rows
with null conversation form one conversation. Every role is kept; unknown ones carry their name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
TOKEN = re.compile(r"\\(.)|(" + "|".join(re.escape(c) for c in CONTROLS) + ")", re.S)
PIECE_BYTES = 4 << 20
PIECES = "conv_id long, piece int, n_turns long, formatted string, mask array<struct<start:long,end:long>>"
MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()),
                 ("formatted", pa.string()), ("mask", MASK)])


def escape(text: str) -> str:
    """Backslashes doubled, control strings preceded by one."""
    return CONTROL.sub(r"\\\g<0>", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _frame(role: str) -> tuple[str, str]:
    return TURNS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")


def assemble(roles: list[str], contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns in one buffer; starts of turns (one more), lengths of headers."""
    contents = contents.cast(pa.large_string())
    offsets = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset:][:len(contents) + 1]
    data = np.frombuffer(contents.buffers()[2] or b"", np.uint8)
    frames = {r: tuple(x.encode() for x in _frame(r)) for r in set(roles)}
    heads = [frames[r][0] for r in roles]
    tails = [frames[r][1] for r in roles]
    sizes = np.empty((len(roles), 3), np.int64)
    sizes[:, 0] = [len(h) for h in heads]
    sizes[:, 1] = np.diff(offsets)
    sizes[:, 2] = [len(t) for t in tails]
    places = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(int(places[-1]), np.uint8)

    def scatter(part: int, source: np.ndarray, starts: np.ndarray) -> None:
        n = sizes[:, part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(places[part:-1:3], n) + step] = source[np.repeat(starts, n) + step]

    for part, pieces in ((0, heads), (2, tails)):
        ends = np.cumsum(sizes[:, part])
        scatter(part, np.frombuffer(b"".join(pieces), np.uint8), ends - sizes[:, part])
    scatter(1, data, offsets[:-1])
    return out, np.append(places[:-1:3], places[-1]), sizes[:, 0]


def _escaped(column: pa.Array) -> pa.Array:
    """Texts with control strings escaped; null as ''."""
    return pa.array([escape(t) if "\\" in t or CONTROL.search(t) else t
                     for t in (v.as_py() or "" for v in column)], pa.large_string())


def _pieces(conv: list, piece: list, roles: list[str], texts: pa.Array) -> pa.RecordBatch:
    """One output row for each run of equal (conversation, piece)."""
    out, starts, heads = assemble(roles, texts)
    runs = [i for i in range(len(conv)) if not i or (conv[i], piece[i]) != (conv[i - 1], piece[i - 1])]
    edges = np.append(starts[runs], starts[-1])
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    ends = np.diff(starts) - [len(_frame(r)[1].encode()) for r in roles] + starts[:-1]
    masks, at = [], [*runs, len(conv)]
    for first, last in zip(at, at[1:]):
        base = chars[starts[first]]
        masks.append([{"start": int(chars[starts[i] + heads[i]] - base), "end": int(chars[ends[i]] - base)}
                      for i in range(first, last) if roles[i] == "assistant"])
    formatted = pa.Array.from_buffers(pa.large_string(), len(runs),
                                      [None, pa.py_buffer(edges), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays(
        [pa.array([conv[i] for i in runs], pa.int64()), pa.array([piece[i] for i in runs], pa.int32()),
         pa.array(np.diff(at), pa.int64()), formatted.cast(pa.string()), pa.array(masks, MASK)],
        schema=OUT)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted; whole conversations leave, large ones in pieces."""
    conv, piece, roles, waiting = [], [], [], []  # of turns not yet given out
    held = 0
    here, number, size = object(), 0, 0

    def flush(upto: int) -> pa.RecordBatch:
        nonlocal conv, piece, roles, waiting, held
        made = _pieces(conv[:upto], piece[:upto], roles[:upto], pa.array(waiting[:upto], pa.large_string()))
        conv, piece, roles, waiting = conv[upto:], piece[upto:], roles[upto:], waiting[upto:]
        held = sum(map(len, waiting))
        return made

    for batch in batches:
        ids = batch.column(0).to_pylist()
        names = [r or "" for r in batch.column(2).to_pylist()]
        for c, role, text in zip(ids, names, _escaped(batch.column(3))):
            text = text.as_py()
            new = c != here
            if new:
                here, number, size = c, 0, 0
            elif size > PIECE_BYTES:
                new, number, size = True, number + 1, 0
            if new and held > PIECE_BYTES:
                yield flush(len(conv))
            size += len(text)
            held += len(text)
            conv.append(c)
            piece.append(number)
            roles.append(role)
            waiting.append(text)
    if conv:
        yield flush(len(conv))


def format_chats(turns: DataFrame) -> DataFrame:
    """Columns ``conv_id, piece, n_turns, formatted, mask``; input ``conv_id, turn, role, text``.

    One shuffle by conversation, sorted inside partitions, streamed: no group is held in memory.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, PIECES)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of every turn of a formatted text."""
    names = {head: role for role, (head, _) in TURNS.items()}
    role, start = "", 0
    for m in TOKEN.finditer(formatted):
        control = m[2]
        if control is None:
            continue
        if control in names:
            role, start = names[control], m.end()
        elif control == "[ROLE]":
            start = m.end()
        elif control == "[/ROLE]":
            role, start = unescape(formatted[start:m.start()]), m.end()
        else:
            yield role, unescape(formatted[start:m.start()])


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")
DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                           ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, state = object(), None

    def done() -> list:
        return [here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for batch in batches:
        rows = []
        for c, formatted, mask in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
            if c != here:
                if state:
                    rows.append(done())
                here, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = formatted.as_py()
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in mask.as_py():
                said = unescape(text[span["start"]:span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), DIGEST_SCHEMA.types)],
                                             schema=DIGEST_SCHEMA)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), DIGEST_SCHEMA.types)],
                                         schema=DIGEST_SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the output of ``format_chats`` where its pieces lie in order."""
    return formatted.mapInArrow(_digest, DIGESTS)
