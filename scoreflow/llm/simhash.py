"""SimHash near-duplicates: a binary trie of fingerprints is joined with itself.

A fingerprint bit is 1 if it is set in over half the shingle hashes. Two trie nodes are visited
together, each level adds one bit to their difference, and a pair of nodes is dropped as soon as
the difference exceeds the error budget. The join is distributed by rotation: the bits are cut in
blocks, and for each block the documents that agree on it form one shard, whose trie is traversed
from the pair (root, root). With more blocks than the budget this loses no pair (pigeonhole);
with fewer, each block finds a pair with a known probability.

Equal fingerprints are one entry, so copies cost nothing. Large shards are cut into pairs of
sub-tries, which become tasks of their own. A traversal keeps a union-find: pairs of nodes whose
members are linked already are skipped, so a group of thousands of near copies gives a spanning
forest and not all its pairs. Components are exact for the links found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import Forest, expand, texts
from scoreflow.llm.components import components
from scoreflow.functions.core import checkpointed

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SHINGLES_AT_ONCE = 1 << 15
LEAF = 24  # node pairs up to LEAF x LEAF entries are compared directly
PAIRS_AT_ONCE = 1 << 20
SHARD_ROWS = 20_000
MOST_CUTS = 8
MIX = ((0xBF58476D1CE4E5B9, 31), (0x94D049BB133111EB, 29), (0x9E3779B97F4A7C15, 32))


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in groups; A-Z lower-cased, split at blanks."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not found:
        return
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.append(0, ends[:-1])
    last = max(len(found) - words, 0)
    starts, ends = starts[:last + 1].tolist(), (ends[min(words, len(found)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE])
        yield np.array([digest(line[a:b], SEED) for a, b in part], dtype=np.uint64)


def fingerprint_of(hashes: Iterable[np.ndarray], size: int = 1) -> np.ndarray:
    """The fingerprint of hashes given in groups."""
    total, n = np.zeros(64 * size, np.int64), 0
    for h in hashes:
        columns = [h]
        for i in range(1, size):
            factor, shift = MIX[(i - 1) % len(MIX)]
            x = (columns[-1] ^ (columns[-1] >> np.uint64(shift))) * np.uint64(factor)
            columns.append(x ^ (x >> np.uint64(30)))
        data = np.stack(columns, axis=1).astype(">u8").view(np.uint8)
        total += np.unpackbits(data, axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * total > n)


def fingerprint(text: str, words: int, size: int = 1) -> np.ndarray:
    """``size`` words of 64 bits; the first is by the hashes as they are, the others by mixed hashes."""
    return fingerprint_of(shingle_hashes(text, words), size)


def _print_batches(words: int, size: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints = [fingerprint(t, words, size).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())],
                                             names=["key", "fp"])
    return batches


def fingerprints(docs: DataFrame, words: int = 4, size: int = 1, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Columns ``key, fp`` (8 * size bytes, highest bit first) for every row; null text is empty."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_print_batches(words, size), f"key {kind}, fp binary")


def blocks_for(bits: int, number: int) -> list[tuple[int, int]]:
    """(start, length) of ``number`` blocks that cover all bits."""
    edges = [bits * i // number for i in range(number + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shards(blocks: list[tuple[int, int]]):
    """Each entry once for each block: the shard it names, and the bits that follow the block."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(np.stack([np.frombuffer(v.as_py(), np.uint8) for v in batch["fp"]]), axis=1)
            for b, (start, length) in enumerate(blocks):
                turned = np.roll(bits, -start, axis=1)
                value = turned[:, :length] @ (1 << np.arange(length, dtype=np.int64)[::-1])
                rest = turned[:, length:length + MOST_CUTS] @ (1 << np.arange(MOST_CUTS, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value * len(blocks) + b), pa.array(rest), batch["key"], batch["fp"]],
                    names=["shard", "rest", "key", "fp"])
    return batches


def trie_join(prints: np.ndarray, group: np.ndarray, side: np.ndarray,
              budgets: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of all pairs within the last budget: places of both ends, differing bits.

    Entries are sorted by (group, side, print). A group of side 0 is joined with itself, in other
    groups side 1 with side 2. The trie is traversed for one budget after the other, so links
    within a smaller budget come first in the forest.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    forest = Forest(len(prints))
    for budget in budgets:
        _traverse(prints, group, side, budget, forest, found)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *[f[k] for f in found]]) for k in range(3))


def _traverse(prints: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int,
              forest: Forest, found: list) -> None:
    """One traversal of all pairs of nodes within the budget."""
    n = len(prints)
    bits = np.unpackbits(prints, axis=1)
    depth = bits.shape[1]
    words = np.ascontiguousarray(prints).view(">u8").astype(np.uint64)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    last = np.append(first[1:], n) if n else first
    twos = np.concatenate([[0], np.cumsum(side == 2)])
    cut = last - (twos[last] - twos[first])
    own = side[first] == 0
    pairs = np.stack([first, cut, np.where(own, first, cut), last, np.zeros_like(first)], axis=1)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    stack = [(0, pairs)]
    below: dict[int, np.ndarray] = {}
    stale, changes, root = True, None, None
    while stack:
        level, todo = stack.pop()
        if len(todo) > 4096:
            stack += [(level, todo[4096:]), (level, todo[:4096])]
            continue
        if stale:
            root = forest.roots()
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            stale = False
        a, b, c, d, diff = todo.T
        done = (root[a] == root[c]) & (changes[a] == changes[b - 1]) & (changes[c] == changes[d - 1])
        todo = todo[~done]
        a, b, c, d, diff = todo.T
        small = ((b - a) * (d - c) <= LEAF * LEAF) | (level == depth)
        leaf = todo[small]
        while len(leaf):
            size = np.cumsum((leaf[:, 1] - leaf[:, 0]) * (leaf[:, 3] - leaf[:, 2]))
            upto = max(1, int(np.searchsorted(size, PAIRS_AT_ONCE, "right")))
            part, leaf = leaf[:upto], leaf[upto:]
            i, j = expand(part[:, 0], part[:, 1] - part[:, 0], part[:, 2], part[:, 3] - part[:, 2])
            i, j = i[i != j], j[i != j]
            far = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64)
            near = far <= budget
            i, j, far = i[near], j[near], far[near]
            used = forest.link_nearest(i, j, far)
            found.append((i[used], j[used], far[used]))
            stale = True
        todo = todo[~small]
        if not len(todo):
            continue
        if level not in below:
            below = {level: np.concatenate([[0], np.cumsum(bits[:, level], dtype=np.int64)])}
        a, b, c, d, diff = todo.T
        up = below[level]
        m, o = b - (up[b] - up[a]), d - (up[d] - up[c])
        same = (a == c) & (b == d)
        children = np.concatenate([
            np.stack([a, m, c, o, diff], 1), np.stack([m, b, o, d, diff], 1),
            np.stack([a, m, o, d, diff + 1], 1), np.stack([m, b, c, o, diff + 1], 1)[~same]])
        children = children[(children[:, 4] <= budget) & (children[:, 0] < children[:, 1])
                            & (children[:, 2] < children[:, 3])]
        stack.append((level + 1, children[np.argsort(children[:, 4], kind="stable")]))


def _join_batches(budgets: Sequence[int]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def joined(upto: pa.Table) -> pa.RecordBatch:
            group = upto["task"].to_numpy()
            side = upto["side"].to_numpy()
            width = len(upto["fp"][0].as_py())
            fp = np.frombuffer(b"".join(upto["fp"].to_pylist()), np.uint8).reshape(-1, width)
            number = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
            i, j, far = trie_join(fp, number, side, budgets)
            key = upto["key"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j]), pa.array(far)],
                                              names=["a", "b", "bits"])

        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 4 * SHARD_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            task = table["task"].to_numpy()
            cut = int(np.searchsorted(task, task[-1]))
            if cut:
                yield joined(table.slice(0, cut))
                table = table.slice(cut)
            held, size = table.to_batches(), table.num_rows
        if held:
            yield joined(pa.Table.from_batches(held).combine_chunks())
    return batches


def links(prints: DataFrame, budgets: Sequence[int], blocks: list[tuple[int, int]]) -> DataFrame:
    """Columns ``a, b, bits``: forests that connect entries within the last budget that share a block.

    ``prints`` has ``key`` (long) and distinct ``fp``. Shards beyond SHARD_ROWS are cut by their
    next bits into pairs of sub-tries within the budget, one task each.
    """
    shards = prints.mapInArrow(_shards(blocks), "shard long, rest long, key long, fp binary")
    count = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
    cuts = F.least(F.lit(MOST_CUTS), F.ceil(F.log2(F.col("n") / SHARD_ROWS)).cast("int"))
    rows = shards.join(count.select("shard", cuts.alias("cuts")), "shard", "left")
    rows = rows.select("shard", "key", "fp", F.expr(f"int(shiftright(rest, {MOST_CUTS} - coalesce(cuts, 0)))").alias("sub"),
                       F.expr("sequence(0, shiftleft(1, coalesce(cuts, 0)) - 1)").alias("others"))
    rows = rows.withColumn("other", F.explode(F.filter(
        "others", lambda o: F.bit_count(o.bitwiseXOR(F.col("sub"))) <= budgets[-1])))
    side = F.when(F.col("sub") == F.col("other"), 0).when(F.col("sub") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("shard", F.least("sub", "other"), F.greatest("sub", "other")).alias("task"),
                       side.alias("side"), "fp", "key")
    rows = rows.repartition("task").sortWithinPartitions("task", "side", "fp")
    return rows.mapInArrow(_join_batches(budgets), "a long, b long, bits long")


def classes(docs_prints: DataFrame, budget: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """Columns ``key, fp, component``: for every row the smallest key reachable through links.

    Each distinct fingerprint is one entry, named by a number of its own, so keys may be null, repeated
    or of any size. Rows without a key link like others; a class whose rows all lack one has a null
    component. An empty table gives no rows.
    """
    docs_prints = docs_prints.select(F.col("key").cast("long").alias("key"), "fp")
    docs_prints = checkpointed(docs_prints)
    number = F.when(F.octet_length("fp") == 8, F.conv(F.hex("fp"), 16, -10).cast("long")).otherwise(F.xxhash64("fp"))
    same = checkpointed(docs_prints.groupBy("fp").agg(F.min("key").alias("least")).withColumn("entry", number))
    found = components(links(same.select(F.col("entry").alias("key"), "fp"), [budget], blocks), "a", "b")
    found = found.select(F.col("node").alias("entry"), F.col("component").alias("head"))
    linked = checkpointed(same.join(found, "entry").select("fp", "least", "head"))
    least = linked.groupBy("head").agg(F.min("least").alias("component"))
    linked = linked.join(least, "head").select("fp", "component", F.lit(True).alias("linked"))
    named = same.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component"))
    return docs_prints.join(named, "fp").select("key", "fp", "component")
