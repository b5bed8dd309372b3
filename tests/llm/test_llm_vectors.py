"""Near pairs, top-k, SimHash, mixing, quality, urls and the pipeline against plain versions."""

import random
import sys

import numpy as np
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F

from scoreflow.llm import covertree, mixing, quality, reputation, simhash, topk
from scoreflow.llm.common import Forest
from scoreflow.llm.components import components
from scoreflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name], connect(SF)) == ""


def reach(n, links):
    """Smallest member reachable from each of 0..n-1."""
    best = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    best = reach(141, links)
    assert got == {i: best[i] for i in {x for p in links if p[0] != p[1] for x in p}}


# Near pairs -----------------------------------------------------------------------------------
def some_vectors(seed, width, n=240):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width))
    for i in range(n // 3):
        rows[n // 3 + i] = rows[i % 7] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.2]) * np.linalg.norm(rows[i % 7]) / np.sqrt(width)
    out = [r.tolist() for r in rows]
    out[5] = out[6] = out[7] = [2.0 * x for x in out[5]]
    out += [None, [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [None] + [1.0] * (width - 1), [],
            [1e200] * width, [1e200] * width]
    return out


def plain_links(rows, cosine):
    unit = {}
    for i, r in enumerate(rows):
        if r and all(x is not None and np.isfinite(x) for x in r) and any(r):
            v = np.array(r) / max(abs(x) for x in r)
            unit[i] = v / np.linalg.norm(v)
    return [(i, j) for i in unit for j in unit if i < j and unit[i] @ unit[j] >= cosine]


@pytest.mark.parametrize("width, block", [(3, 40), (24, 64), (24, 4096)])
def test_near_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block)
    rows = some_vectors(width, width)
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    got = {r["vec_id"]: r for r in covertree.near_pairs(table, 0.95).collect()}
    links = plain_links(rows, 0.95)
    best = reach(len(rows), links)
    assert len(got) == len(rows) and links
    for i in range(len(rows)):
        n = sum(i in p for p in links)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, best[i], best[i] == i)


def test_near_pairs_tree_invariants():
    x = np.random.default_rng(0).normal(size=(500, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, lead = covertree.build(x, 0.05)
    assert sorted(order) == list(range(500)) and lead[0] == 0
    tree = covertree.Tree(x[order], lead, np.ones(500, np.int64))
    for level, (starts, radius) in enumerate(zip(tree.starts, tree.radius)):
        if level and level < len(tree.starts) - 1:
            assert radius.max() <= tree.radius[0].max() / 2 ** level + 1e-7
            assert set(tree.starts[level - 1]) <= set(starts)


def test_near_pairs_edge_tables(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.near_pairs(table).collect()] == [(1, 0, 1, True)]
    assert covertree.near_pairs(table.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 2 + [(None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(covertree.near_pairs(twice).collect(), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


# Top-k ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(900, 40)) * scale).tolist()
    rows[40:50] = [rows[40]] * 10  # ties
    rows += [None, [float("nan")] * 40, [None] * 40]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table).collect())
    x = np.floor(64 * np.array(rows[:900])).astype(np.int64)
    want = []
    for q in range(0, 900, 20):
        score = (x @ x[q]).tolist()
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:20]
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(order)]
    assert got == want


def test_top_k_edge_tables(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(few.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark):
    """Sums beyond 2^53 and partial sums beyond 2^63 are whole; what no long holds is an error."""
    rng = np.random.default_rng(9)
    rows = [(rng.integers(-2 ** 18, 2 ** 18, 48) * 2.0).tolist() for _ in range(300)]
    rows[7:9] = [rows[0]] * 2
    # Two parts beyond 2^63 that cancel.
    rows += [[2.0 ** 27] * 24 + [-2.0 ** 27] * 24, [2.0 ** 27] * 47 + [-2.0 ** 27]]
    rows[20] = [2.0 ** 27] * 24 + [2.0 ** 27 - 1] * 24
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    small = table.where("vec_id <> 301")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(small).collect())
    whole = [[int(64 * v) for v in r] for r in rows]
    want = []
    for q in range(0, 301, 20):
        score = [sum(a * b for a, b in zip(whole[q], w)) for w in whole[:301]]
        order = sorted((i for i in range(301) if i != q), key=lambda i: (-score[i], i))[:20]
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(order)]
    assert got == want
    large = spark.createDataFrame([(0, [2.0 ** 56]), (1, [2.0 ** 56])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit 64 bits"):
        topk.top_k(large).collect()
    with pytest.raises(Exception, match="fit 64 bits"):
        topk.top_k(large.withColumn("embedding", F.array(F.lit(2.0 ** 60)))).collect()


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0]), (2, [4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"] // 4096) for r in topk.top_k(table, k=9).orderBy("rank").collect()]
    assert got == [(1, 2, 8), (2, 2, 6), (3, 2, 4), (4, 2, 3), (5, 1, 2), (6, 1, 1)]


def test_bounds_save_products():
    rng = np.random.default_rng(2)
    rows = np.floor(64 * np.concatenate([rng.normal(size=(4000, 64)) * np.linspace(2, 0.01, 64)])).astype(np.int64)
    best = topk.Best(np.arange(10), 5)
    made = topk.search(rows[:10], best, np.arange(500), rows[:500])
    more = topk.search(rows[:10], best, np.arange(500, 4000), rows[500:])
    assert made == 10 * 500 * 64 and more < 10 * 3500 * 64 * 0.8


# SimHash --------------------------------------------------------------------------------------
def plain_print(text, words=4):
    low = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    found = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", low) if w]
    parts = [found[i:i + words] for i in range(len(found) - words + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", None, "One", "one two  three\tFOUR", "a b c d e f ÀÉ b c d e f ", "a b c d " * 40, "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit(1))
    got = {r["key"]: int(r["fp"].hex(), 16) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_print(t or "") for i, t in enumerate(texts)}
    assert got[0] == 0 and len(simhash.fingerprint("a b c d e", 5, 4)) == 32


def near_prints(seed, n=700, bits=64):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n // 4, bits))
    rows = base[rng.integers(0, len(base), n)]
    flips = rng.random((n, bits)) < rng.choice([0.0, 0.02, 0.05], n)[:, None]
    return np.unique(np.packbits(rows ^ flips, axis=1), axis=0)


@pytest.mark.parametrize("bits, budget", [(64, 4), (256, 30)])
def test_trie_join(bits, budget):
    prints = near_prints(1, bits=bits)
    n = len(prints)
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2)
    want = reach(n, [(i, j) for i, j in zip(*np.nonzero(far <= budget)) if i < j])
    zero = np.zeros(n, np.int64)
    for budgets in ([budget], [budget // 2, budget]):
        i, j, d = simhash.trie_join(prints, zero, zero, budgets)
        assert reach(n, list(zip(i, j))) == want and len(i) == n - len(set(want))
        assert (d == far[i, j]).all() and d.max() <= budget
    side = np.where(np.arange(n) < n // 2, 1, 2)
    cross = reach(n, [(i, j) for i, j in zip(*np.nonzero(far <= budget)) if i < n // 2 <= j])
    i, j, _ = simhash.trie_join(prints, zero, side, [budget])
    assert reach(n, list(zip(i, j))) == cross


@pytest.mark.parametrize("rows", [20_000, 9])
def test_links_lose_no_pair(spark, monkeypatch, rows):
    """Also where all shards are cut into pairs of sub-tries."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    prints = near_prints(2)
    prints[:400, :4] = prints[0, :4]  # hot shards
    prints = np.unique(prints, axis=0)
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2)
    want = reach(len(prints), [(i, j) for i, j in zip(*np.nonzero(far <= 4)) if i < j])
    table = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "key long, fp binary")
    got = reach(len(prints), [(r["a"], r["b"]) for r in simhash.links(table, [4], simhash.blocks_for(64, 5)).collect()])
    assert got == want


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {d: plain_print(t) for d, t in docs}
    ids = sorted(prints)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4]
    best = reach(len(ids), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", ids[best[i]]) for i, d in enumerate(ids)}


def test_simhash_edge_rows(spark):
    big, text = (1 << 62) + 1, "one two three four five six seven eight nine"
    rows = [(None, text), (big, text), (big + 2, text + " x" * 2000), (7, None), (9, ""), (None, ""), (7, "   "), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("fp"), F.lit(2).alias("key"), F.lit(3).alias("entry"))
    blocks = simhash.blocks_for(64, 5)
    got = simhash.classes(simhash.fingerprints(docs), 4, blocks).collect()
    assert sorted((r["key"] is None, r["key"] or 0, r["component"]) for r in got) == [
        (False, 7, 7), (False, 7, 7), (False, 9, 7), (False, 9, 7), (False, big, big), (False, big + 2, big + 2), (True, 0, 7), (True, 0, big)]
    assert simhash.classes(simhash.fingerprints(docs.limit(0)), 4, blocks).count() == 0
    # A null key within the budget of two others that it alone links.
    prints = [(1, 0), (None, 0b1111), (big, 0b11111111), (None, 1 << 60), (None, 3 << 60)]
    table = spark.createDataFrame([(k, bytearray(p.to_bytes(8, "big"))) for k, p in prints], "key long, fp binary")
    assert sorted((int.from_bytes(r["fp"], "big"), r["key"], r["component"]) for r in simhash.classes(table, 4, blocks).collect()) == [
        (0, 1, 1), (15, None, 1), (255, big, 1), (1 << 60, None, 1), (3 << 60, None, 1)]


def test_forest():
    forest = Forest(6)
    forest.link(np.array([5, 4, 4]), np.array([4, 3, 0]))
    assert forest.roots().tolist() == [0, 1, 2, 0, 0, 0] and forest.find(5) == 0
    used = Forest(4).link_nearest(np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([5, 3, 4, 9]))
    assert sorted(used.tolist()) == [1, 2, 3]


# Mixing ---------------------------------------------------------------------------------------
def plain_turns(share, blocks):
    """Slot of every block of a period, found slot by slot."""
    total, done, t, out = sum(share.values()), dict.fromkeys(share, 0), 0, {}
    while any(done[s] < min(blocks[s], share[s]) for s in share):
        ready = [(-(-(k + 1) * total // share[s]), s) for s, k in sorted(done.items())
                 if k < min(blocks[s], share[s]) and k * total // share[s] <= t]
        if ready:
            s = min(ready)[1]
            out[s, done[s]] = t
            done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_keeps_every_source_within_one_block(seed):
    rng = random.Random(seed)
    share = mixing.exact_shares({f"s{i}": round(rng.random() ** 3 + 1e-3, 3) for i in range(rng.randint(1, 12))})
    names, made = mixing.turns_of(share, dict.fromkeys(share, 10 ** 9))
    total, got = sum(share.values()), dict.fromkeys(share, 0)
    assert made[:, 2].tolist() == list(range(total))
    for i, k, t in made.tolist():
        assert k == got[names[i]]
        got[names[i]] += 1
        assert all(abs(got[x] * total - share[x] * (t + 1)) < total for x in share)
    assert got == share
    few = {s: rng.randint(1, 9) for s in share}
    names, made = mixing.turns_of(share, few)
    assert {(names[i], k): t for i, k, t in made.tolist()} == plain_turns(share, few)


def test_mix_against_plain_ranks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), f"t{i}") for i in range(900)]
    rows += rows[:3] + [(None, "a", None), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit(1))
    weights = {"a": 1.0, "b": 2.0, None: 1.0}
    got = mixing.mix(docs, weights, block_rows=8)
    assert got.count() == 905
    share = {"n": 1, "sa": 1, "sb": 2}
    slots = plain_turns(share, share)
    by = {}
    for r in got.select("row.doc_id", "row.source", "block", "slot", "place").collect():
        by.setdefault(r["source"], []).append(r)
    for source, mine in by.items():
        s = "n" if source is None else "s" + source
        mine.sort(key=lambda r: (r["slot"], r["place"]))
        for i, r in enumerate(mine):
            k = i // 8
            assert (r["block"], r["slot"], r["place"]) == (k, k // share[s] * 4 + slots[s, k % share[s]], i % 8)
    assert mixing.mixed(docs, weights=weights).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.exact_shares({"a": 0.0})


@pytest.mark.parametrize("light", [1e-9, 1e-30])
def test_long_periods_cost_what_their_blocks_cost(spark, light):
    docs = spark.range(6_500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "a").otherwise("b").alias("source"), F.lit("").alias("text"))
    got = mixing.mix(docs, {"a": light, "b": 1.0}).select("row.source", "block", "slot").distinct().collect()
    assert sorted(r["slot"] for r in got) == list(range(103)) and len(got) == 103
    assert mixing.exact_shares({"a": 1e-6, "b": 0.999999}) == {"a": 1, "b": 999_999}


def test_query_to_targets(spark):
    import hashlib
    from collections import defaultdict

    from scoreflow.llm.queries import TARGETS
    by = defaultdict(list)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()
    for d, s in docs:
        by[s].append((hashlib.md5(f"{d}|7".encode()).hexdigest(), d))
    share = mixing.exact_shares({"s" + s: TARGETS.get(s, 1.0) for s in by})
    blocks = {"s" + s: -(-len(x) // 8) for s, x in by.items()}
    slots, period, want = plain_turns(share, blocks), sum(share.values()), {}
    for s, x in by.items():
        for i, (_, d) in enumerate(sorted(x)):
            turn, k = divmod(i // 8, share["s" + s])
            want[d] = (s, i // 8, turn * period + slots["s" + s, k], i % 8)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_mix_sources_to_targets"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len({x[1] for x in want.values()}) > 3


def test_mix_of_unequal_weights_stays_within_one_block(spark):
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("").alias("text"))
    got = mixing.mix(docs, {"a": 1.0, "b": 2.0}, block_rows=1).select("row.source", "slot").where("source = 'a'")
    assert all(r["slot"] // 3 == i for i, r in enumerate(got.orderBy("slot").collect()))


# Quality --------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    got = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    row = got.join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.95 and 0 <= row[1] and row[2] <= 1


def test_normal_equations_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    stats = quality.statistics(docs)
    rows = stats.join(docs.select(F.col("doc_id").alias("key"), F.col("quality").alias("y")), "key")
    model = quality.fit(rows)
    x, y = (np.array(c) for c in zip(*((r["x"], r["y"]) for r in rows.select("x", "y").collect())))
    z = quality._fourier(model, x)
    penalty = quality.RIDGE * len(y) * np.diag(np.append(np.full(quality.FOURIER, 1 / quality.FOURIER), 0))
    want = np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.cells) > 0).all()


def test_pooling():
    cells, levels = quality.pooled(np.array([0., 1, 2, 3]), np.array([2, 2, 2, 2]), np.array([0, 2, 0, 2]))
    assert cells.tolist() == [0, 1, 2, 3] and levels.tolist() == [0, 0.5, 0.5, 1]


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 50000)], "doc_id long, text string").withColumn("x", F.lit(1))
    stats = quality.statistics(docs)
    none = quality.fit(stats.withColumn("y", F.lit(None).cast("int")))
    assert [r["score"] for r in quality.scored(stats, none).collect()] == [0.5] * 4
    one = quality.fit(stats.withColumn("y", F.lit(1)))
    assert quality.kept(docs, one).count() == 4 and quality.kept(docs, one).columns == docs.columns
    assert quality.kept(docs.limit(0), one).count() == 0


# Urls -----------------------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "http://net", "x://net/", "https://b.example.com?q=://c.net/",
            "http://example.net/enx", "http://fr.ORG/fr/", "http://xorg/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"))
    none = spark.createDataFrame([], "url string, good int")
    got = {r["page_id"]: r for r in reputation.filter_urls(pages, none, rules).collect()}
    part = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"])
    assert [part(i) for i in range(3)] == [("", "", None)] * 3
    assert part(3) == ("a.example.net", "/en/x", "example.net/en/") and got[3]["verdict"] == "allow"
    assert part(4) == ("net", "", None) and part(5) == ("net", "/", "net/") and got[5]["verdict"] == "block"
    assert part(6) == ("b.example.com", "", None) and part(7) == ("example.net", "/enx", "net/")
    assert part(8) == ("fr.org", "/fr/", "org/fr/") and part(9) == ("xorg", "/fr/", None)
    assert reputation.filter_urls(pages.limit(0), none, rules).count() == 0


def test_one_host_with_most_pages_and_other_suffixes(spark):
    pages = spark.createDataFrame([(i % 40, f"http://{'big.a.nom.xx' if i % 4 else f'h{i % 8}.b.nom.xx'}/{i}") for i in range(800)],
                                  "page_id long, url string")
    seen = spark.createDataFrame([("http://big.a.nom.xx/", 1)] * 50 + [("http://h0.b.nom.xx/", 0)] * 50, "url string, good int")
    got = reputation.filter_urls(pages, seen, (), suffixes=("nom.xx",))
    assert got.count() == 800
    found = {(r["host"], r["verdict"], r["bound"]) for r in got.select("host", "verdict", "bound").distinct().collect()}
    assert {(h, v) for h, v, _ in found} == {("big.a.nom.xx", "allow"), ("h0.b.nom.xx", "block"), ("h4.b.nom.xx", "block")}
    suffix, domain = reputation.suffix_patterns(("nom.xx",))
    part = lambda host: [__import__("re").search(p, host).group(1) for p in (suffix, domain)]
    assert part("big.a.nom.xx") == ["nom.xx", "a.nom.xx"] and part("b.xx") == ["xx", "b.xx"] and part("xx") == ["xx", "xx"]


def test_reputation_shrinks(spark):
    seen = [("good.a.com", 1)] * 200 + [("bad.a.com", 0)] * 200 + [("new.a.com", 0)] + [("x.b.com", 1)] * 300 + [("y.b.com", 1)] * 2
    outcomes = spark.createDataFrame(seen + [("z.b.com", None)], "host string, good int")
    got = {r["host"]: r for r in reputation.host_reputation(outcomes.select("host").distinct(), outcomes).collect()}
    assert got["good.a.com"]["bound"] > 0.9 and got["y.b.com"]["bound"] > got["new.a.com"]["bound"]
    assert got["bad.a.com"]["mean"] < 0.1 and 0 < got["new.a.com"]["mean"] < got["z.b.com"]["mean"]
    assert all(r["bound"] < r["mean"] for r in got.values())


# Pipeline -------------------------------------------------------------------------------------
def plain_jaccard(a, b, k=5):
    part = lambda t: {tuple(t.lower().split()[i:i + k]) for i in range(max(1, len(t.split()) - k + 1))}
    return len(part(a) & part(b)) / len(part(a) | part(b))


def test_near_dedup_stage(spark):
    import corpus_pipeline

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        for change in (1, 2, 9):  # nine changes leave a similarity below 0.8
            near = list(words)
            for _ in range(change):
                near[rng.randrange(200)] = word()
            texts.append(" ".join(near))
    order = list(range(len(texts)))
    rows = [(i, t) for i, t in zip(order, texts)] + [(500, texts[0]), (501, None), (502, ""), (503, ""), (0, texts[0]), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("copy", F.lit(1))
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    kept = sorted(r["doc_id"] for r in got.where("doc_id is not null").collect())
    assert got.columns == docs.columns
    assert max(plain_jaccard(texts[i], texts[i + 3]) for i in range(0, 240, 4)) < 0.8
    assert kept == [*sorted([*range(0, 240, 4), *range(3, 240, 4)]), 501] and got.where("doc_id is null").count() == 1
    assert plain_jaccard(texts[0], texts[2]) > 0.8
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), SF).count() == 0


def kept_texts(spark, texts):
    """Places of the texts that the near-duplicate stage keeps."""
    import corpus_pipeline

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())


def body(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def test_near_dedup_keeps_texts_with_common_repeats(spark):
    """A filler that makes up most of a text, and a line repeated often, make no two texts alike."""
    rng = random.Random(1)
    filler = ["x"] * 500  # one shingle, counted 496 times
    line = body(rng, 20)
    texts = [" ".join(body(rng, 100) + filler) for _ in range(4)]
    texts += [" ".join(body(rng, 400) + line * 30) for _ in range(4)]
    assert max(plain_jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]) < 0.2
    assert kept_texts(spark, texts) == list(range(8))


def test_near_dedup_finds_a_pair_in_a_family(spark):
    """Template texts below 0.8 to each other, and one pair above: only verified links speak for it."""
    rng = random.Random(3)
    shared = body(rng, 240)
    texts = [" ".join(shared + body(rng, 40)) for _ in range(150)]
    own = texts[70].split()[240:]
    texts.append(" ".join(shared + own[:10] + body(rng, 30)))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for j in range(151) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert near == [(70, 150)] and plain_jaccard(texts[0], texts[1]) > 0.7
    assert kept_texts(spark, texts) == list(range(150))


def test_near_dedup_is_exact(spark):
    """Short texts, repeats and pairs just around 0.8, against all pairs compared one by one."""
    rng = random.Random(5)
    texts = []
    for i in range(40):
        short = body(rng, 8)
        texts += [" ".join(short), " ".join(short + ["more"])]  # 4 and 5 shingles
    for repeats in (10, 100):
        long, line = body(rng, 404), body(rng, 24)
        texts += [" ".join(long), " ".join(long + line * repeats)]
    for i in range(60):
        words = body(rng, 200)
        texts.append(" ".join(words))
        for _ in range(3):
            part = list(words)
            for at in rng.sample(range(200), rng.choice((3, 4, 5, 6))):
                part[at] = "changed"
            texts.append(" ".join(part[:rng.randrange(170, 201)]))
    texts += ["", "a", "a a a a a a a", "A"]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up = [up[i] if u == up[j] else u for u in up] if up[i] < up[j] else [up[j] if u == up[i] else u for u in up]
    want = [i for i, u in enumerate(up) if i == u]
    assert 50 < len(texts) - len(want) < len(texts) - 60
    assert kept_texts(spark, texts) == want


def test_near_dedup_names_rows_by_key_and_text(spark):
    """Rows that share a doc_id are judged one by one."""
    import corpus_pipeline

    rng = random.Random(6)
    a, b, c = (" ".join(body(rng, 50)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (None, a)], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (3, c), (None, a)], key=str)


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = docs.join(labels, "doc_id").join(kept.select("doc_id").withColumn("k", F.lit(1)), "doc_id", "left")
    good = both.agg(F.avg(((F.col("quality") == 1) == F.col("k").isNotNull()).cast("int"))).first()[0]
    assert good > 0.9
    out = corpus_pipeline.run(spark, SF)
    rows = out.orderBy("mixture_file", "mixture_row").collect()
    assert 0 < len(rows) < docs.count() and all(r["ids"] for r in rows)
    assert len({(r["mixture_file"], r["mixture_row"]) for r in rows}) == len(rows)
    first = [r["doc_id"] for r in rows[:64]]
    sources = {r["source"] for r in docs.where(F.col("doc_id").isin(first)).collect()}
    assert len(sources) <= 10
    assert "corpus_pipeline" in sys.modules


def test_sketches_and_common_postings_lose_nothing():
    from fractions import Fraction

    import pyarrow as pa

    from scoreflow.llm import nearsets
    rng, least = np.random.default_rng(4), Fraction(4, 5)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64) * np.uint64(2)
        other = np.unique(np.where(rng.random(len(base)) < rng.random() * 0.3, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base))
        base, other = np.unique(base), other[:max(1, int(len(other) * rng.choice([1, 0.9, 0.5])))]
        both = len(np.intersect1d(base, other))
        if both * 5 >= 4 * (len(base) + len(other) - both):
            assert nearsets.may_be_alike(nearsets.sketch(base), nearsets.sketch(other), len(base), len(other), least)
    assert not nearsets.may_be_alike(nearsets.sketch(base), nearsets.sketch(base + np.uint64(1 << 50)), len(base), len(base), least)
    for size in (1, 2, 7):
        at = np.sort(rng.integers(0, 40, 60))
        batches = [pa.RecordBatch.from_arrays([pa.array(at[i:i + size])], names=["shingle"]) for i in range(0, 60, size)]
        got = [x for b in nearsets._in_common(iter(batches)) for x in b["shingle"].to_pylist()]
        assert got == [x for x in at.tolist() if (at == x).sum() > 1]


def united(n, pairs):
    """The smallest member of each of n members' class."""
    up = list(range(n))
    for i, j in pairs:
        a, b = sorted((up[i], up[j]))
        up = [a if u == b else u for u in up]
    return up


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links of one task are joined in it; those of many tasks are joined by rounds, with the same classes."""
    module = sys.modules["scoreflow.llm.components"]
    rng, calls, plain = random.Random(8), [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: calls.append(1) or plain(df))
    pairs = [(k, k + 1) for k in range(0, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    links = spark.createDataFrame(pairs, "a long, b long")
    up = united(400, pairs)
    want = {k: up[k] for k in sorted({k for p in pairs if p[0] != p[1] for k in p})}
    assert {r[0]: r[1] for r in components(links, "a", "b").collect()} == want and len(calls) == 1
    monkeypatch.setattr(module, "LINKS_AT_ONCE", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r[0]: r[1] for r in components(links, "a", "b").collect()} == want and len(calls) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert components(links.where("a = b"), "a", "b").count() == 0


def test_trie_join_gives_the_first_links_of_near_dedup(spark, monkeypatch):
    """The stage joins fingerprints of all sets by the trie; its pairs connect what is within the budget, no more."""
    from scoreflow.llm import nearsets

    rng = random.Random(9)
    words = body(rng, 300)
    texts = [" ".join(body(rng, 40)) for _ in range(20)]
    for _ in range(60):
        part = list(words)
        for at in rng.sample(range(300), rng.choice((1, 2, 9, 30))):
            part[at] = "changed"
        texts.append(" ".join(part))
    sets = [nearsets.shingle_set(t, 5) for t in texts]
    prints = [int.from_bytes(nearsets.fingerprint_of([s]).tobytes(), "big") for s in sets]
    prints[1], prints[2] = prints[0], prints[0]  # equal ones become a star
    near = [(i, j) for j in range(80) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= nearsets.BUDGET]
    made = spark.createDataFrame([(k, p.to_bytes(8, "big")) for k, p in enumerate(prints)], "entry long, fp binary")
    pairs = [tuple(r) for r in nearsets._by_trie(made).collect()]
    assert set(pairs) <= set(near) and united(80, pairs) == united(80, near) and len(near) > 100
    calls, plain = [], nearsets.trie_links
    monkeypatch.setattr(nearsets, "trie_links", lambda prints, *a: calls.append(prints.count()) or plain(prints, *a))
    alike = [(i, j) for j in range(80) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert kept_texts(spark, texts) == [k for k, u in enumerate(united(80, alike)) if k == u]
    assert calls == [len({nearsets.fingerprint_of([s]).tobytes() for s in sets})]
