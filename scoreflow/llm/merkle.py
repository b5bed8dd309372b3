"""Merkle manifest of a table: a tree of SHA-256 midstates.

Every row is a leaf. Leaves of a group ascend by key; ``fan`` consecutive nodes become their hash until
one is left, the subroot; the subroots, by group, give the root in the same way. A lone last node is
hashed alone. Inputs of a hash are digests as hexadecimal text, concatenated.

A digest as text is 64 bytes, one block of SHA-256, so the state of the hash between two children is
eight words and nothing else. Each parent retains the state before each child slot. Folding a leaf up
the tree resumes, at each parent, the state of its slot with the replaced child and the siblings on
its right; what lies on the left is in the state already. The hash over a proof (all siblings,
bottom up) is resumed the same way, so 32 bytes carry it from stage to stage.

On Spark: ranks in a group come from a range sort and counts per partition. ``CHUNK`` consecutive
nodes form one sub-tree, built and folded inside a task; the roots of the chunks are the nodes of the
next tree, so a table of N rows takes log(N) / log(CHUNK) rounds. Tasks hold one chunk. Nothing of the
tree reaches the driver.

Rows with null group form a group of their own, first in order. Null keys come first; rows of equal
key are ordered by leaf, so repeated rows have results that differ in nothing but the proof. Empty
tables give no rows. Only the named columns are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.llm.common import ranked

CHUNK = 4096
LANES = 1 << 14
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** 3 <= x else (lo, mid - 1)
    return lo


# The first 32 bits after the point of square roots and cube roots of primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 64 bytes) each; all hashes of an array in lock step."""
    n = len(state)
    if n > LANES:
        return np.concatenate([compress(state[i:i + LANES], block[i:i + LANES]) for i in range(0, n, LANES)])
    w = np.empty((64, n), np.uint32)
    w[:16] = np.ascontiguousarray(block).view(">u4").reshape(n, 16).T
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w[t] = (w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = columns = [np.ascontiguousarray(x) for x in state.T]
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(columns, (a, b, c, d, e, f, g, h))], axis=1)


def as_text(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as hexadecimal text (n, 64)."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, ::2], out[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return out


def begun(n: int) -> np.ndarray:
    """``n`` states before any input."""
    return np.tile(START, (n, 1))


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of states that have taken so many whole blocks each."""
    pad = np.zeros((len(state), 64), np.uint8)
    pad[:, 0] = 0x80
    pad[:, 56:] = (np.asarray(blocks, np.int64) * 512).astype(">u8").view(np.uint8).reshape(-1, 8)
    return compress(state, pad).astype(">u4").view(np.uint8).reshape(-1, 32)


class Tree:
    """A tree over the digests (n, 32) of consecutive nodes, with the states before all child slots."""

    def __init__(self, digests: np.ndarray, fan: int, levels: int | None = None):
        """``levels`` to build; None: until one node is left."""
        self.fan, self.nodes, self.states = fan, [digests], []
        while len(self.nodes) <= levels if levels is not None else len(self.nodes[-1]) > 1:
            below = self.nodes[-1]
            state = begun(-(-len(below) // fan))
            before = np.empty((fan, *state.shape), np.uint32)
            for slot in range(fan):
                before[slot] = state
                child = below[slot::fan]
                state[:len(child)] = compress(state[:len(child)], as_text(child))
            self.states.append(before)
            self.nodes.append(finished(state, self.sizes(len(below))))

    def sizes(self, n: int) -> np.ndarray:
        """Children of each parent of ``n`` nodes."""
        return np.minimum(self.fan, n - self.fan * np.arange(-(-n // self.fan)))

    def fold(self, values: np.ndarray) -> np.ndarray:
        """The root that results from each leaf's value in its place, the siblings as they are."""
        at = np.arange(len(values))
        for below, before in zip(self.nodes, self.states):
            up, slot = at // self.fan, at % self.fan
            values = resumed(before[slot, up], values, slot, self.sizes(len(below))[up], self.runs(below)[up])
            at = up
        return values

    def runs(self, below: np.ndarray) -> np.ndarray:
        """The children of every parent (parents, fan, 32); zeros where there is none."""
        out = np.zeros((-(-len(below) // self.fan) * self.fan, 32), np.uint8)
        out[:len(below)] = below
        return out.reshape(-1, self.fan, 32)

    def proofs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf the state of the hash over all its siblings, and their number."""
        at = np.arange(len(self.nodes[0]))
        state, taken = begun(len(at)), np.zeros(len(at), np.int64)
        for below in self.nodes[:-1]:
            up, slot = at // self.fan, at % self.fan
            state, taken = added(state, taken, slot, self.sizes(len(below))[up], self.runs(below)[up])
            at = up
        return state, taken

    def path(self, leaf: int) -> list[dict]:
        """Level by level what folding needs: the state before the slot, the slot, all children."""
        out = []
        for below, before in zip(self.nodes, self.states):
            up, slot = divmod(leaf, self.fan)
            run = below[up * self.fan:(up + 1) * self.fan]
            out.append({"state": before[slot, up].tobytes(), "slot": slot, "run": run.tobytes()})
            leaf = up
        return out


def resumed(state: np.ndarray, values: np.ndarray, slot: np.ndarray, size: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Parents' digests: the state before the slot resumed with the value, then the right siblings."""
    state = compress(state, as_text(values))
    for j in range(1, run.shape[1]):
        right = np.flatnonzero((slot < j) & (j < size))
        if len(right):
            state[right] = compress(state[right], as_text(run[right, j]))
    return finished(state, size)


def added(state: np.ndarray, taken: np.ndarray, slot: np.ndarray, size: np.ndarray,
          run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash over a proof, resumed with the siblings of one level, left to right."""
    for j in range(run.shape[1]):
        other = np.flatnonzero((slot != j) & (j < size))
        if len(other):
            state[other] = compress(state[other], as_text(run[other, j]))
            taken[other] += 1
    return state, taken


def _digests(column: pa.Array) -> np.ndarray:
    """A column of 32-byte values as an array (n, 32)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.array([r.tobytes() for r in data], pa.binary())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one chunk after the other; rows arrive sorted, ``at`` is the place in the chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch["at"].to_numpy() == 0).tolist()
        edges = [0, *starts, batch.num_rows]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


PATH = "array<struct<state:binary,slot:int,run:binary>>"
ARROW_PATH = pa.list_(pa.struct([("state", pa.binary()), ("slot", pa.int32()), ("run", pa.binary())]))


def _levels(chunk: int, fan: int) -> int:
    levels, size = 0, 1
    while size < chunk:
        levels, size = levels + 1, size * fan
    if size != chunk:
        raise ValueError("a chunk must be a power of the fan")
    return levels


def _leaf_batches(fan: int, chunk: int):
    """Leaves of a chunk: folded claims and proofs up to the chunk's root; then a row with the root."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(rows):
            n = part.num_rows
            tree = Tree(_digests(part["leaf"]), fan, None if part["size"][0].as_py() <= chunk else _levels(chunk, fan))
            state, taken = tree.proofs()
            named = part.select(["key", "grp", "chunk", "size", "leaf"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*named.columns, _binary(tree.fold(_digests(part["claim"]))), _binary(state.astype("<u4")),
                 pa.array(taken), pa.nulls(n, pa.binary())], names=OUT)
            one = named.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, t) if c in ("key", "leaf") else one[c] for c, t in zip(one.schema.names, one.schema.types)],
                 *[pa.nulls(1, pa.binary())] * 2, pa.nulls(1, pa.int64()), _binary(tree.nodes[-1])], names=OUT)
    return batches


OUT = ["key", "grp", "chunk", "size", "leaf", "folded", "state", "taken", "root"]


def _node_batches(fan: int, chunk: int):
    """Nodes of a chunk with their paths to the chunk's root, and that root."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(rows):
            tree = Tree(_digests(part["digest"]), fan, None if part["size"][0].as_py() <= chunk else _levels(chunk, fan))
            paths = pa.array([tree.path(i) for i in range(part.num_rows)], ARROW_PATH)
            named = part.select(["grp", "rank", "chunk", "size"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*named.columns, paths, _binary(np.repeat(tree.nodes[-1], part.num_rows, 0))],
                                             names=["grp", "rank", "chunk", "size", "path", "root"])
    return batches


def _in_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    rows = rows.withColumn("chunk", F.expr(f"rank div {chunk}")).withColumn("at", F.col("rank") % chunk)
    return rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "at")


def _paths(nodes: DataFrame, fan: int, chunk: int) -> DataFrame:
    """Columns ``grp, rank, path, top``: the way of each node (``grp, rank, size, digest``) to its group's top."""
    kind = nodes.schema["grp"].dataType.simpleString()
    most = nodes.agg(F.max("size")).first()[0] or 0
    made = checkpointed(_in_chunks(nodes, chunk).mapInArrow(
        _node_batches(fan, chunk), f"grp {kind}, rank long, chunk long, size long, path {PATH}, root binary"))
    if most <= chunk:
        return made.select("grp", "rank", "path", F.col("root").alias("top"))
    above = _paths(made.where(F.col("rank") % chunk == 0).select(
        "grp", F.col("chunk").alias("rank"), F.ceil(F.col("size") / chunk).alias("size"), F.col("root").alias("digest")),
        fan, chunk).select(F.col("grp").alias("g"), F.col("rank").alias("chunk"), F.col("path").alias("more"), "top")
    both = made.join(above, (made["chunk"] == above["chunk"]) & made["grp"].eqNullSafe(above["g"]))
    return both.select("grp", "rank", F.concat("path", "more").alias("path"), "top")


def _finish(fan: int):
    """Claims and proofs of leaves, resumed from the chunk's root along its path to the root."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            if not n:
                continue
            values, state = _digests(batch["folded"]).copy(), np.frombuffer(
                b"".join(batch["state"].to_pylist()), "<u4").reshape(n, 8).astype(np.uint32)
            taken = batch["taken"].to_numpy().copy()
            # Rows of a chunk lie together and share a path.
            chunk, nulls = batch["chunk"].to_numpy(), np.array(batch["grp"].is_valid())
            names = batch["grp"].dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.append(True, (chunk[1:] != chunk[:-1]) | (names[1:] != names[:-1]) | (nulls[1:] != nulls[:-1]))
            of = np.cumsum(new) - 1
            paths = [batch["path"][int(i)].as_py() for i in np.flatnonzero(new)]
            length = np.array([len(p) for p in paths])
            for level in range(length.max(initial=0)):
                steps = [p[level] if level < len(p) else None for p in paths]
                at = np.flatnonzero(length[of] > level)
                group = of[at]
                before, run = np.zeros((len(paths), 8), np.uint32), np.zeros((len(paths), fan, 32), np.uint8)
                slot, size = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
                for i, step in enumerate(steps):
                    if step:
                        children = np.frombuffer(step["run"], np.uint8).reshape(-1, 32)
                        run[i, :len(children)], size[i], slot[i] = children, len(children), step["slot"]
                        before[i] = np.frombuffer(step["state"], np.uint32)
                values[at] = resumed(before[group], values[at], slot[group], size[group], run[group])
                state[at], taken[at] = added(state[at], taken[at], slot[group], size[group], run[group])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["grp"], batch["leaf"], batch["subroot"], batch["root"],
                 _binary(finished(state, taken)), _binary(values)],
                names=["key", "grp", "leaf", "subroot", "root", "proof", "folded"])
    return batches


def field(name: str, more: int = 0) -> Column:
    """A value in a leaf: UTF-8 byte count, colon, value; ``-`` for null."""
    value = F.col(name) + more if more else F.col(name)
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.concat(*fields), "utf-8"), 256))


def manifest(leaves: DataFrame, fan: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Columns ``key, grp, leaf, subroot, root, proof, folded`` for every leaf, as lowercase hex.

    ``leaves`` has ``key, grp, leaf, claim``; the claim is the leaf that is folded, with the siblings
    as they are: the proof holds for it if ``folded`` equals ``root``.
    """
    _levels(chunk, fan)
    rows = ranked(checkpointed(leaves.select("key", "grp", "leaf", "claim")), ["grp"], ["key", "leaf", "claim"])
    key, grp = (rows.schema[c].dataType.simpleString() for c in ("key", "grp"))
    made = checkpointed(_in_chunks(rows, chunk).mapInArrow(_leaf_batches(fan, chunk), (
        f"key {key}, grp {grp}, chunk long, size long, leaf binary, folded binary, state binary, taken long, root binary")))
    tops = _paths(made.where("root is not null").select(
        "grp", F.col("chunk").alias("rank"), F.ceil(F.col("size") / chunk).alias("size"), F.col("root").alias("digest")),
        fan, chunk)
    tops = checkpointed(tops)
    roots = ranked(tops.where("rank = 0").select(F.lit(0).alias("one"), "grp", F.col("top").alias("digest")),
                   ["one"], ["grp"])
    above = _paths(roots.select(F.col("one").alias("grp"), "rank", "size", "digest"), fan, chunk)
    above = above.select(F.col("rank").alias("r"), F.col("path").alias("more"), F.col("top").alias("whole"))
    above = roots.select(F.col("grp").alias("g"), F.col("rank").alias("r")).join(above, "r").drop("r")
    tops = tops.join(above, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("grp").alias("g"), F.col("rank").alias("part"), F.concat("path", "more").alias("path"),
        F.col("top").alias("subroot"), F.col("whole").alias("root"))
    rows = made.where("root is null").drop("root")
    rows = rows.join(tops, (rows["chunk"] == tops["part"]) & rows["grp"].eqNullSafe(tops["g"]))
    done = rows.mapInArrow(_finish(fan), (f"key {key}, grp {grp}, leaf binary, subroot binary, root binary, "
                                          "proof binary, folded binary"))
    text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof", "folded")]
    return done.select("key", "grp", *text)
