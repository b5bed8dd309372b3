"""Exact pairs above a cosine by dual traversal of cover trees.

On the unit sphere a cosine of c is a distance of sqrt(2 - 2c). The top of the tree is a nested net
of pivots (farthest-first, so every prefix is a net and radii halve along it); each vector belongs
to the cell of its nearest pivot. Cells are cut into blocks of bounded size, and each block gets
its own lower tree: nested levels with halving radii, every node's centre a member, every member
within the node's radius. A pair of cells, then of nodes, is dropped when the distance of the
centres exceeds the threshold by more than both covering radii, and taken whole when it stays below
it by both; what remains is compared exactly in doubles.

Equal vectors are one entry with a count. A task returns, for each entry it linked, the number of
links and one forest edge, never the list of pairs. Block pairs are joined on cell keys; the cell
pairs follow from the pivots, whose number has a fixed bound. Where the data have no structure the
bounds prune nothing between blocks, and the work is that of an exact join.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do rows
with a null key. Shorter vectors count as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.llm.common import Forest, expand, vectors
from scoreflow.llm.components import components

BLOCK_ROWS = 4096
SAMPLE, MOST_PIVOTS = 2048, 512
SLACK = 1e-7
TILE = 1024
PAIRS_AT_ONCE = 1 << 18


def _pack(width: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            places, found = vectors(batch.column(1))
            cells: list[bytes | None] = [None] * batch.num_rows
            for i, v in zip(places, found):
                top = np.abs(v).max(initial=0)
                if top > 0:
                    v = v / top  # no overflow in squares
                    cells[i] = np.pad(v / np.sqrt(v @ v), (0, width - len(v))).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["id", "v"])
    return batches


def _matrix(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first traversal: every prefix covers the sample best, distances halve along it."""
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(number, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _cells(centres: np.ndarray):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                d = _distances(_matrix(batch["v"]), centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["n"], batch["v"], pa.array(cell.astype(np.int32)),
                     pa.array(d[np.arange(len(d)), cell])], names=["id", "n", "v", "cell", "away"])
    return batches


def build(x: np.ndarray, finest: float) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a block: rows in depth-first order, and for each row the highest level it leads.

    A row that leads a level is the centre of a node there and, as levels are nested, of one node
    on every level below. The node of level l that a row leads reaches up to the next row that leads
    level l or higher. Level 0 is the root; radii halve from level to level down to ``finest``.
    """
    order, lead = np.arange(len(x)), np.zeros(len(x), np.int64)
    if not len(x):
        return order, lead
    radius = float(_distances(x[:1], x).max())
    lead[:] = 1 << 20
    lead[0] = 0
    level = 0
    while radius > finest:
        level, radius = level + 1, radius / 2
        starts = np.flatnonzero(lead < level)
        for lo, hi in zip(starts, np.append(starts[1:], len(x))):
            if hi - lo < 2:
                continue
            rows = order[lo:hi]
            centres, at = [0], np.full(hi - lo, -1)
            at[0] = 0
            for first in range(1, hi - lo, TILE):
                part = np.arange(first, min(first + TILE, hi - lo))
                d = _distances(x[rows[part]], x[rows[centres]])
                near = d.argmin(1)
                covered = d[np.arange(len(part)), near] <= radius
                at[part[covered]] = near[covered]
                part = part[~covered]
                if len(part):
                    inner = _distances(x[rows[part]], x[rows[part]]) <= radius
                    free = np.ones(len(part), bool)
                    for i in range(len(part)):
                        if free[i]:
                            mine = inner[i] & free
                            at[part[mine]] = len(centres)
                            centres.append(int(part[i]))
                            free &= ~mine
            # Members by node, the centre first (it is the first member by construction).
            by = np.argsort(at, kind="stable")
            order[lo:hi] = rows[by]
            old = lead[lo:hi].copy()
            lead[lo:hi] = np.where(np.append(True, np.diff(at[by]) > 0), level, 1 << 20)
            lead[lo] = old[0]
    return order, np.minimum(lead, level + 1)


def _build_batches(finest: float):
    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order, lead = build(_matrix(table["v"]), finest)
        table = table.take(pa.array(order))
        yield pa.RecordBatch.from_arrays(
            [table["block"].combine_chunks(), pa.array(np.arange(len(order), dtype=np.int32)),
             pa.array(lead.astype(np.int32)), *[table[c].combine_chunks() for c in ("id", "n", "v")]],
            names=["block", "pos", "lead", "id", "n", "v"])

    return lambda rows: (out for table in _runs(rows, "block") for out in made(table))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if held and held[0][key][0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Tree:
    """Levels of a built block: starts of nodes, covering radii, members' counts."""

    def __init__(self, x: np.ndarray, lead: np.ndarray, n: np.ndarray):
        self.x, self.n = x, n
        self.starts, self.radius, self.weight = [], [], []
        for level in range(int(lead.max()) + 1 if len(lead) else 0):
            starts = np.flatnonzero(lead <= level)
            centre = np.repeat(starts, np.diff(np.append(starts, len(x))))
            away = np.linalg.norm(x - x[centre], axis=1)
            self.starts.append(starts)
            self.radius.append(np.maximum.reduceat(away, starts))
            self.weight.append(np.add.reduceat(n, starts))
        if not self.starts or len(self.starts[-1]) < len(x):
            self.starts.append(np.arange(len(x)))
            self.radius.append(np.zeros(len(x)))
            self.weight.append(n)

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.x))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, on the next level (the last level repeats)."""
        below = self.starts[min(level + 1, len(self.starts) - 1)]
        lo = np.searchsorted(below, self.starts[min(level, len(self.starts) - 1)][node])
        hi = np.searchsorted(below, self.ends(min(level, len(self.starts) - 1))[node])
        return lo, hi - lo


def dual(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of ``a`` and ``b``, and the roots of all rows (``a`` first, then ``b``).

    With ``a is b`` the links of a row with itself do not count.
    """
    reach = np.sqrt(2 - 2 * cosine)
    same = a is b
    links = [np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)]
    forest = Forest(len(a.x) + (0 if same else len(b.x)))
    shift = 0 if same else len(a.x)
    deepest = max(len(a.starts), len(b.starts)) - 1
    work = [(0, np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))]
    if not len(a.x) or not len(b.x):
        return links[0][:-1], links[1][:-1], forest.roots()

    def at(tree: Tree, level: int) -> int:
        return min(level, len(tree.starts) - 1)

    def judge(level: int, i: np.ndarray, j: np.ndarray, d: np.ndarray):
        """Take whole pairs, drop far ones; the rest goes on or is compared exactly."""
        la, lb = at(a, level), at(b, level)
        wide = a.radius[la][i] + b.radius[lb][j]
        whole = d + wide <= reach - SLACK
        rest = ~whole & (d - wide <= reach + SLACK)
        take(la, lb, i[whole], j[whole])
        i, j = i[rest], j[rest]
        if level < deepest:
            return i, j
        ri, rj = a.starts[la][i], b.starts[lb][j]
        if same:
            ri, rj = ri[ri != rj], rj[ri != rj]
        near = np.einsum("ij,ij->i", a.x[ri], b.x[rj]) >= cosine
        count(links[0], ri[near], ri[near] + 1, b.n[rj[near]])
        if not same:
            count(links[1], rj[near], rj[near] + 1, a.n[ri[near]])
        forest.link(ri[near], rj[near] + shift)
        return None

    def count(out: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> None:
        np.add.at(out, lo, n)  # sums of differences: a running total gives the counts
        np.subtract.at(out, hi, n)

    def take(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        lo, hi, lo2, hi2 = a.starts[la][i], a.ends(la)[i], b.starts[lb][j], b.ends(lb)[j]
        count(links[0], lo, hi, b.weight[lb][j])
        if same:  # no row counts itself
            own, _ = expand(lo[lo == lo2], (hi - lo)[lo == lo2], lo[lo == lo2], np.ones_like(lo[lo == lo2]))
            count(links[0], own, own + 1, -a.n[own])
        else:
            count(links[1], lo2, hi2, a.weight[la][i])
        forest.link(lo, lo2 + shift)
        nodes = np.unique(np.concatenate([np.stack([lo, hi], 1), np.stack([lo2, hi2], 1) + shift]), axis=0)
        n = nodes[:, 1] - nodes[:, 0]
        first = np.repeat(nodes[:, 0], n)
        # Members of a node that is taken whole with another are linked through that other.
        forest.link(first, first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))

    while work:
        level, lo, n, lo2, n2 = work.pop()
        size = n * n2
        if len(size) > 1 and size.sum() > PAIRS_AT_ONCE:
            half = max(1, int(np.searchsorted(np.cumsum(size), size.sum() // 2)))
            work += [(level, lo[half:], n[half:], lo2[half:], n2[half:]),
                     (level, lo[:half], n[:half], lo2[:half], n2[:half])]
            continue
        la, lb = at(a, level), at(b, level)
        if len(size) == 1 and size[0] > TILE:
            for s in range(0, int(n[0]), TILE):
                rows = np.arange(lo[0] + s, min(lo[0] + s + TILE, lo[0] + n[0]))
                columns = np.arange(lo2[0], lo2[0] + n2[0])
                d = _distances(a.x[a.starts[la][rows]], b.x[b.starts[lb][columns]])
                wide = a.radius[la][rows][:, None] + b.radius[lb][columns][None, :]
                i, j = np.nonzero(d - wide <= reach + SLACK)
                for part in range(0, len(i), PAIRS_AT_ONCE):
                    pi, pj = i[part:part + PAIRS_AT_ONCE], j[part:part + PAIRS_AT_ONCE]
                    more = judge(level, rows[pi], columns[pj], d[pi, pj])
                    if more is not None and len(more[0]):
                        work.append((level + 1, *a.children(level, more[0]), *b.children(level, more[1])))
            continue
        i, j = expand(lo, n, lo2, n2)
        gap = a.x[a.starts[la][i]] - b.x[b.starts[lb][j]]
        more = judge(level, i, j, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        if more is not None and len(more[0]):
            work.append((level + 1, *a.children(level, more[0]), *b.children(level, more[1])))
    return np.cumsum(links[0])[:-1], np.cumsum(links[1])[:-1], forest.roots()


def _dual_batches(cosine: float):
    def joined(table: pa.Table) -> pa.RecordBatch:
        side = table["side"].to_numpy()
        ids = table["id"].to_numpy()
        cut = int(np.searchsorted(side, 2)) if side[0] else len(side)
        x, lead, n = _matrix(table["v"]), table["lead"].to_numpy(), table["n"].to_numpy()
        a = Tree(x[:cut], lead[:cut], n[:cut])
        b = a if not side[0] else Tree(x[cut:], lead[cut:], n[cut:])
        left, right, root = dual(a, b, cosine)
        count = left if a is b else np.concatenate([left, right])
        found = count > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(count[found]),
                                           pa.array(ids[root[found]])], names=["id", "n", "root"])

    return lambda rows: (joined(table) for table in _runs(rows, "task"))


def near_pairs(table: DataFrame, cosine: float = 0.95, key: str = "vec_id",
               vector: str = "embedding") -> DataFrame:
    """One row per row of ``table``: ``vec_id, n_links, component_id, kept``."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine must lie between 0 and 1")
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"))
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    packed = checkpointed(rows.mapInArrow(_pack(width), "id long, v binary"))
    valid = packed.where("id is not null and v is not null")
    entries = valid.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    entries = checkpointed(entries.select("id", "n", "v"))
    total = entries.count()
    reach = float(np.sqrt(2 - 2 * cosine))
    if total:
        sample = entries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        sample = np.stack([np.frombuffer(r["v"], "<f8") for r in sample])
        centres = pivots(sample, min(MOST_PIVOTS, -(-total // BLOCK_ROWS)))
        celled = entries.mapInArrow(_cells(centres), "id long, n long, v binary, cell int, away double")
        stats = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")).collect()
        radius = {r["cell"]: r["radius"] for r in stats}  # one row for each pivot at most
        gaps = _distances(centres, centres)
        cuts = {r["cell"]: -(-r["rows"] // BLOCK_ROWS) for r in stats}
        spark = table.sparkSession
        counts = spark.createDataFrame(list(cuts.items()), "cell int, cuts int")
        number = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("cuts"))
        blocks = (celled.join(F.broadcast(counts), "cell").select(number.alias("block"), "id", "n", "v")
                  .repartition("block").sortWithinPartitions("block"))
        kind = "block long, pos int, lead int, id long, n long, v binary"
        built = checkpointed(blocks.mapInArrow(_build_batches(reach / 4), kind))
        cells = [(i, j) for i in cuts for j in cuts
                 if i <= j and gaps[i, j] - radius[i] - radius[j] <= reach + SLACK]
        pairs = (spark.createDataFrame(cells, "a int, b int")
                 .join(F.broadcast(counts.select(F.col("cell").alias("a"), F.col("cuts").alias("na"))), "a")
                 .join(F.broadcast(counts.select(F.col("cell").alias("b"), F.col("cuts").alias("nb"))), "b")
                 .withColumn("i", F.explode(F.expr("sequence(0, na - 1)")))
                 .withColumn("j", F.explode(F.expr("sequence(0, nb - 1)")))
                 .where("a < b or i <= j")
                 .select((F.col("a").cast("long") * (1 << 32) + F.col("i")).alias("first"),
                         (F.col("b").cast("long") * (1 << 32) + F.col("j")).alias("second")))
        task = F.xxhash64("first", "second").alias("task")
        own = F.col("first") == F.col("second")
        sides = (pairs.select(task, F.col("first").alias("block"), F.when(own, 0).otherwise(1).alias("side"))
                 .unionAll(pairs.where(~own).select(task, F.col("second").alias("block"), F.lit(2).alias("side"))))
        work = (built.join(sides, "block").select("task", "side", "pos", "lead", "id", "n", "v")
                .repartition("task").sortWithinPartitions("task", "side", "pos"))
        found = checkpointed(work.mapInArrow(_dual_batches(cosine), "id long, n long, root long"))
    else:
        found = table.sparkSession.createDataFrame([], "id long, n long, root long")
    sums = found.groupBy("id").agg(F.sum("n").alias("linked"))
    named = components(found, "id", "root").withColumnRenamed("node", "id")
    known = (entries.join(sums, "id", "left").join(named, "id", "left")
             .select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "id").alias("component")))
    keyed = packed.withColumn("v", F.when(F.col("id").isNotNull(), F.col("v")))
    return keyed.join(known, "v", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
