"""Near duplicates: rows whose sets of word shingles have a Jaccard similarity of ``least`` or more.

The join is exact up to the 64-bit hashes that name shingles and sets. Equal sets are one entry, so
copies cost nothing. Shingles are ordered: those that are common last, by their counts, all others
first, by hash. Two sets of that similarity share a shingle among the first ``n - ceil(least n) + 1``
of each (prefix filter), whatever the order; with this one, passages that many texts share propose no
pairs, unless a text has little else. Shingles are counted in 2^21 cells of their hashes; common are
the cells that stand out from the mean by six deviations, so the list is bounded and is broadcast. The
place of the first shared shingle in both orders bounds the overlap of the whole sets (what comes
before it is not shared), and the pairs that the bound leaves are first compared by sketches, bit
maps that bound the overlap from above, and then by their whole sets. Only such verified pairs are links.

The first links come from the trie join of ``simhash``: sets have fingerprints, a trie of them is joined with
itself under the error budget ``BUDGET``, and its forest, with a star for each group of equal fingerprints, is
verified like all pairs. The prefix join then finds what is still apart.

Crowded shingles, those that more than ``CROWD`` entries share, are not left to all their pairs: in a
round each of their entries is compared with a few others (``TRIES``) that its shingles name as
centres, other ones in each round, so a group of thousands of near copies is linked by rounds of
linear work. Rounds end when one links little or when the pairs still apart are few. The last round takes
every pair that shares a prefix shingle and is still apart, so no similar pair stays unseen; what it
costs is quadratic only for families of texts that share prefix shingles and are not similar.

Null text is empty; empty texts are equal. Rows with null key have no class. An empty table has none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed, packed
from scoreflow.llm.common import parts_of, texts
from scoreflow.llm.components import components
from scoreflow.llm.simhash import blocks_for, fingerprint_of, shingle_hashes
from scoreflow.llm.simhash import links as trie_links

CELL_BITS, BLOCK_BITS = 21, 15  # cells that count shingles, and those of one block of counts
SHINGLES_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 256
PAIRS_OF_TASK = 1 << 13
ROWS_AT_ONCE = 512
MARKS = 1 << 20  # a broadcast table of marks has at most so many rows
BUDGET = 4  # bits in which fingerprints that the trie join links differ at most
PRINTS_AT_ONCE = 1 << 15  # shingles whose bits are added up at once; four times the prints of a task
CROWD, CENTRES, TRIES, TURNS, FEW = 32, 8, 8, 6, 20


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def mark(name: str) -> Column:
    """One of MARKS cells of a key."""
    return F.pmod(F.xxhash64(name), F.lit(MARKS)).cast("int")


def entry_of(made: np.ndarray) -> int:
    """The name of a set, a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(made.tobytes())).astype(np.int64))


class Hot:
    """The cells of common shingles: sorted cells and their counts."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.counts = cells[order], counts[order]

    def counted(self, made: np.ndarray) -> np.ndarray:
        """Counts of shingles; 0 for all that are not common."""
        if not len(self.cells):
            return np.zeros(len(made), np.int64)
        cell = (made >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.counts[at], 0)


def prefix_of(made: np.ndarray, hot: Hot, least: Fraction) -> np.ndarray:
    """The shingles of a set that a similar set must share one of; the same order for every set."""
    n = len(made)
    rare = np.lexsort((made, hot.counted(made)))
    return made[rare[:n + 1 + (-least.numerator * n) // least.denominator]]


def _looked(words: int):
    """Name of each row's set; at the end of a task, its shingles counted in cells, a row for each block."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "entry", "block", "counts"]
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        held: list[np.ndarray] = []
        size, kind = 0, None
        for batch in parts_of(rows, ROWS_AT_ONCE):
            kind = batch.schema.field("key").type
            entries = []
            for t in texts(batch["text"]):
                made = shingle_set(t, words)
                entries.append(entry_of(made))
                held.append((made >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                size += len(made)
                if size > SHINGLES_AT_ONCE:
                    cells += np.bincount(np.concatenate(held), minlength=1 << CELL_BITS).astype(np.uint32)
                    held, size = [], 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["key"], batch["digest"], pa.array(entries, pa.int64()),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if kind is not None:
            cells += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=1 << CELL_BITS).astype(np.uint32)
            # Counts of one task are mostly below 256: the four bytes of all counts lie apart, which packs well.
            parts = [zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), 1) for x in cells.reshape(-1, 1 << BLOCK_BITS)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
                                              pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=names)
    return batches


def _hot_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each block whose counts stand out, from the counts of all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in rows:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"]):
            found = np.ascontiguousarray(np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            sums[block] = sums.get(block, 0) + found.astype(np.int64)
    for block, found in sums.items():
        mean = found.mean()
        at = np.flatnonzero(found > mean + 6 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + at), pa.array(found[at])], names=["cell", "count"])


def sketch(made: np.ndarray) -> bytes:
    """Bits that the upper bits of the shingles name, four or more for each shingle; a power of two."""
    k = max(3, (4 * len(made)).bit_length())
    bits = np.zeros(1 << k, np.uint8)
    bits[made >> np.uint64(64 - k)] = 1
    return np.packbits(bits).tobytes()


def may_be_alike(x: bytes, y: bytes, n: int, m: int, least: Fraction) -> bool:
    """False only if sets with these sketches can't be similar: each differing bit is a shingle of one alone."""
    p, q = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(p) != len(q):  # the longer sketch with one bit less
        longer = np.unpackbits(p if len(p) > len(q) else q).reshape(-1, 2).any(axis=1)
        p, q = (np.packbits(longer), q) if len(p) > len(q) else (p, np.packbits(longer))
    apart = int(np.bitwise_count(p ^ q).sum())
    both = (n + m - apart) // 2
    return both * least.denominator >= least.numerator * (n + m - both)


def _near(least: Fraction):
    """Pairs whose sketches leave room for similarity."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(rows, 8 * PAIRS_AT_ONCE):
            keep = [may_be_alike(x.as_py(), y.as_py(), n, m, least) for x, y, n, m in zip(
                batch["x"], batch["y"], batch["n"].to_pylist(), batch["m"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return batches


def _in_common(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings, those whose shingle the row before or after has too."""
    held: pa.RecordBatch | None = None  # the last row so far, not yet given out
    before: int | None = None  # the shingle of the row before it
    for batch in rows:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        at = batch["shingle"].to_numpy()
        same = at[1:] == at[:-1]
        keep = np.append(same, False) | np.append(at[0] == before, same)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        held = batch.slice(batch.num_rows - 1)
        before = int(at[-2]) if len(at) > 1 else before
    if held is not None and held["shingle"][0].as_py() == before:
        yield held


def _prefixes(words: int, hot: Hot, least: Fraction):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(rows, ROWS_AT_ONCE):
            entries, sizes, found, sketches, prints = [], [], [], [], []
            for t in texts(batch["text"]):
                made = shingle_set(t, words)
                entries.append(entry_of(made))
                sizes.append(len(made))
                sketches.append(sketch(made))
                prints.append(fingerprint_of(made[i:i + PRINTS_AT_ONCE] for i in range(0, len(made), PRINTS_AT_ONCE)).tobytes())
                found.append(prefix_of(made, hot, least).view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(sizes, pa.int32()), lists,
                                              pa.array(sketches, pa.binary()), pa.array(prints, pa.binary())],
                                             names=["entry", "n", "prefix", "sketch", "fp"])
    return batches


def _sets(words: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(rows, ROWS_AT_ONCE):
            made = [shingle_set(t, words) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([entry_of(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())],
                names=["entry", "set"])
    return batches


def _alike(least: Fraction):
    """Pairs whose sets have a Jaccard similarity of ``least`` or more."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(rows, PAIRS_AT_ONCE):
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * least.denominator >= least.numerator * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return batches


def _sizes_fit(least: Fraction, n: str, m: str) -> Column:
    """Sets of these sizes can be similar."""
    return F.least(n, m) * least.denominator >= F.greatest(n, m) * least.numerator


def _can_reach(least: Fraction, n: str, i: str, m: str, j: str) -> Column:
    """Sets of ``n, m`` shingles can be similar if the first that they share is at ``i`` and ``j``."""
    p, q = least.numerator, least.denominator
    return F.expr(f"least({n} - {i}, {m} - {j}) * {p + q}L >= {p}L * ({n} + {m})")


def _by_trie(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of entries whose fingerprints differ in BUDGET bits or fewer: enough to connect all of them."""
    heads, _ = packed(prints.groupBy("fp").agg(F.min("entry").alias("key")), PRINTS_AT_ONCE >> 2)
    equal = prints.join(heads, "fp").where("entry <> key").select(F.col("key").alias("a"), F.col("entry").alias("b"))
    near = trie_links(heads.select("key", "fp"), [BUDGET], blocks_for(64, BUDGET + 1)).select("a", "b")
    return equal.unionAll(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _labelled(postings: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Postings with the class ``c`` of their entry, without shingles whose entries are all in one."""
    if classes is None:
        return postings.withColumn("c", F.col("entry"))
    rows = postings.join(classes.withColumnRenamed("node", "entry"), "entry", "left").select(
        "shingle", "entry", "n", "i", F.coalesce("component", "entry").alias("c"))
    split = rows.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return rows.join(split.select("shingle"), "shingle", "left_semi")


def _stars(postings: DataFrame, least: Fraction, turn: int) -> DataFrame:
    """Pairs ``a, b`` of entries apart: each entry with a few centres of its shingles, by hashes."""
    # The centres of a shingle are entries that come first by different hashes; every other one is of
    # those with the smallest share of rarer shingles, as what is altered least is similar to most.
    rarer = [F.expr("int(50L * i div n)"), F.lit(0)]
    centres = postings.groupBy("shingle").agg(F.array(*[
        F.min_by(F.struct("entry", "n", "i", "c"), F.struct(rarer[k % 2], F.xxhash64("shingle", "entry", F.lit(turn * CENTRES + k))))
        for k in range(CENTRES)]).alias("centres"))
    one = F.col("centres")[F.pmod(F.xxhash64("entry", "shingle", F.lit(turn)), F.lit(CENTRES)).cast("int")]
    named = postings.join(centres, "shingle").select("entry", "n", "i", "c", one.alias("x"))
    named = named.where((F.col("entry") != F.col("x.entry")) & (F.col("c") != F.col("x.c"))).select(
        "entry", F.col("x.entry").alias("b"), "n", "i", F.col("x.n").alias("m"), F.col("x.i").alias("j"))
    named = named.where(_sizes_fit(least, "n", "m") & _can_reach(least, "n", "i", "m", "j"))
    tries = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b"))), 1, TRIES)
    return named.groupBy("entry").agg(tries.alias("tries")).select(
        F.col("entry").alias("a"), F.explode("tries.b").alias("b"))


def _few_apart(postings: DataFrame) -> bool:
    """Whether comparing all pairs still apart is work in proportion to the postings."""
    sizes = postings.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.groupBy("shingle").agg(F.sum("rows").alias("n"), F.max("rows").alias("top")).agg(
        F.sum("n").alias("rows"), F.sum(F.expr("double(n) * (n - top)")).alias("pairs")).first()
    return (found["pairs"] or 0) <= CROWD * (found["rows"] or 0)


def _all_apart(postings: DataFrame, least: Fraction) -> DataFrame:
    """All pairs ``a, b`` of entries apart that share a prefix shingle early enough."""
    sizes = postings.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.groupBy("shingle").agg(F.max_by("c", "rows").alias("top"))
    # The largest class of a shingle stands on one side only, so its own pairs aren't looked at.
    left = postings.join(most, "shingle").where("c <> top")
    right = postings.select("shingle", F.col("entry").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
    pairs = left.withColumnRenamed("entry", "a").join(right, "shingle").where(
        (F.col("c") != F.col("d")) & ((F.col("d") == F.col("top")) | (F.col("a") < F.col("b")))
        & _sizes_fit(least, "n", "m") & _can_reach(least, "n", "i", "m", "j"))
    # A pair may stand in either order at different shingles.
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _of(table: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of a table of entries whose marks say that they may be among ``ends``; the others aren't shuffled."""
    marks = ends.select(mark("entry").alias("mark")).distinct()
    return table.withColumn("mark", mark("entry")).join(F.broadcast(marks), "mark", "left_semi").drop("mark")


def _ends(pairs: DataFrame) -> DataFrame:
    return packed(pairs.select(F.col("a").alias("entry")).unionAll(pairs.select("b")).distinct())[0]


def _possible(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs that their sketches leave."""
    some = _of(sketches, _ends(pairs))
    x = some.select(F.col("entry").alias("a"), "n", F.col("sketch").alias("x"))
    y = some.select(F.col("entry").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return packed(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_near(least), "a long, b long"), PAIRS_OF_TASK)[0]


def _verified(pairs: DataFrame, sketches: DataFrame, rows: DataFrame, named: DataFrame, words: int, least: Fraction) -> tuple[DataFrame, int]:
    """The pairs whose whole sets are similar, and their number; sets are made of the rows whose marks say they may be needed."""
    pairs = _possible(pairs, sketches, least)
    ends = _ends(pairs)
    marks = _of(named, ends).join(ends, "entry").groupBy("entry").agg(F.min("key").alias("key")).select(mark("key").alias("mark")).distinct()
    texts_of = rows.withColumn("mark", mark("key")).join(F.broadcast(marks), "mark", "left_semi").select("text")
    sets = _of(texts_of.mapInArrow(_sets(words), "entry long, set binary"), ends).join(ends, "entry", "left_semi")
    sets = checkpointed(sets.groupBy("entry").agg(F.min("set").alias("set")))
    both = pairs.join(sets.select(F.col("entry").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("entry").alias("b"), F.col("set").alias("y")), "b")
    return packed(both.select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long"), PAIRS_OF_TASK)


def digest(text: str) -> Column:
    """What names a row together with its key."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def classes(docs: DataFrame, words: int, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key, digest, rows, component``: classes of similar rows among those with a key.

    One row for each key and digest; ``rows`` counts the rows that share both.

    Rows are named by key and md5 of the text, so rows that share a key but not a text are rows of
    their own. Similarity is that of the whole texts; null text is empty, and empty texts are equal.
    """
    part = Fraction(str(least))
    rows = docs.where(docs[key].isNotNull()).select(
        docs[key].alias("key"), digest(text).alias("digest"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    seen = checkpointed(rows.mapInArrow(_looked(words), f"key {kind}, digest string, entry long, block int, counts binary"))
    named = seen.where("block is null").groupBy("key", "digest", "entry").agg(F.count(F.lit(1)).alias("rows"))
    common = seen.where("block is not null").select("block", "counts").repartition("block").mapInArrow(
        _hot_batches, "cell long, count long").toArrow()
    hot = Hot(common["cell"].to_numpy(), common["count"].to_numpy())
    prefixes = checkpointed(rows.select("text").mapInArrow(
        _prefixes(words, hot, part), "entry long, n int, prefix array<long>, sketch binary, fp binary").dropDuplicates(["entry"]))
    postings = prefixes.select("entry", "n", F.posexplode("prefix").alias("i", "shingle"))
    postings = checkpointed(postings.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_in_common, postings.schema))
    sketches = prefixes.select("entry", "n", "sketch")
    links, found, total = None, None, 0

    def linked(pairs: DataFrame) -> int:
        """Verifies pairs and joins the classes that they link; the number of links."""
        nonlocal links, found, total
        alike, made = _verified(pairs, sketches, rows, named, words, part)
        if made:
            total += made
            links = alike if links is None else links.unionAll(alike)
            found = checkpointed(components(links, "a", "b"))
        return made

    pairs, number = packed(_by_trie(prefixes.select("entry", "fp")), PAIRS_OF_TASK)
    if number:
        linked(pairs)
    crowd = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWD)
    crowded = checkpointed(postings.join(crowd.select("shingle"), "shingle", "left_semi"))
    for turn in range(0 if crowded.isEmpty() else TURNS):
        apart = checkpointed(_labelled(crowded, found))
        if _few_apart(apart):
            break
        made = linked(packed(_stars(apart, part, turn), PAIRS_OF_TASK)[0])
        if made * FEW <= total:  # what is still apart is little, and left to the last round
            break
    pairs, number = packed(_all_apart(checkpointed(_labelled(postings, found)), part), PAIRS_OF_TASK)
    if number:
        linked(pairs)
    if found is None:
        return named.select("key", "digest", "rows", F.col("entry").alias("component"))
    return named.join(found.withColumnRenamed("node", "entry"), "entry", "left").select(
        "key", "digest", "rows", F.coalesce("component", "entry").alias("component"))
