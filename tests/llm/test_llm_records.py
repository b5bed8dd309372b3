"""Conversation repair, archives and the Merkle manifest against plain versions."""

import gzip
import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreflow.llm import merkle, repair, scan, warc
from scoreflow.llm.common import ranked
from scoreflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def clash():
    return [F.lit(1).alias("rank"), F.lit("x").alias("size"), F.lit("k").alias("key"), F.lit("g").alias("grp")]



def test_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(6)]), i) for i in range(300)]
    got = ranked(spark.createDataFrame(rows, "g string, o int, i int"), ["g"], ["o", "i"]).collect()
    by = defaultdict(list)
    for g, o, i in rows:
        by[g].append((o is not None, o or 0, i))
    assert {r["i"]: (r["rank"], r["size"]) for r in got} == {
        i: (at, len(x)) for x in by.values() for at, (_, _, i) in enumerate(sorted(x))}


# Conversations --------------------------------------------------------------------------------
def plain_repair(rows):
    """Cheapest edits of (role, text, must go, truncated) rows, by all paths kept with their audits."""
    after = {"0": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, said) in list(best.items()):
                for t in after[s].replace("s", ""):
                    new = (cost + 5, audit + "I", said + ((names[t], ""),))
                    if t not in best or new < best[t]:
                        best[t] = new
        return best

    best = {"0": (0, "", ())}
    for role, text, go, cut in rows:
        new = {}
        for s, (cost, audit, said) in inserted(dict(best)).items():
            ways = [(s, cost + 2, audit + "D", said)]
            if not go:
                ways += [(t, cost + 1 + 5 * cut, audit + "R", said + ((names[t], text),)) for t in after[s] if t != "s"]
                ways += [(t, cost + 5 * cut, audit + "K", said + ((role, text),)) for t in after[s] if role[:1] == t]
            for t, *way in ways:
                if t not in new or tuple(way) < new[t]:
                    new[t] = tuple(way)
        best = new
    best = inserted(best)
    return min(best[s] for s in "0a" if s in best)


ROLES = ("system", "user", "assistant", "tool", " ")
TEXTS = ("Yes.", "No!", "so it", "", " \t", "Why? ", "a ")


def random_rows(rng, n):
    return [(rng.choice(ROLES), rng.choice(TEXTS) + rng.choice(["", str(rng.randrange(60)) + "."])) for _ in range(n)]


def plain_conversation(rows):
    """Everything op11 returns of (turn, role, text) rows in order, but for the conversation."""
    seen, faults, kinds = set(), [0, 0, 0], []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not ends else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        kinds.append((role, text, fault in (0, 1), fault == 2))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = plain_repair(kinds)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha)


@pytest.mark.parametrize("block", [3, 1000])
def test_repair_against_all_paths(spark, block, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 2)
    rng = random.Random(block)
    convs = {c: [(i // 2 * rng.choice([1, 3]) if rng.random() < 0.9 else None, *x) for i, x in enumerate(random_rows(rng, n))]
             for c, n in ((None, 40), (1, 1), (2, 90), *((c, rng.randrange(1, 14)) for c in range(3, 80)))}
    rows = [(c, *x) for c, part in convs.items() for x in part]
    rng.shuffle(rows)
    got = repair.digests(*repair.repair(spark.createDataFrame(rows, TURNS).select("*", *clash()), block)).collect()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert {r[0]: tuple(r)[1:] for r in got} == {c: plain_conversation(sorted(x, key=order)) for c, x in convs.items()}


def test_matrices_are_associative_and_route_like_one_block():
    rng = random.Random(5)
    for _ in range(60):
        kinds = [rng.randrange(9) for _ in range(rng.randrange(4, 30))]
        cut = sorted(rng.sample(range(len(kinds) + 1), 3))
        parts = [repair.matrix(kinds[a:b]) for a, b in zip([0, *cut], [*cut, len(kinds)])]
        a, b, c, d = parts
        first = repair.applied(repair.start(0), repair.matrix(kinds))[0]
        for whole in (repair.times(repair.times(repair.times(a, b), c), d), repair.times(a, repair.times(b, repair.times(c, d)))):
            assert repair.applied(repair.start(0), whole)[0] == first


def test_repair_edge_tables(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "", "x" * 100_000 + "."),
                                   (3, None, "user", "Hi."), (3, 0, "assistant", "Yes."), (3, 0, "assistant", "Yes.")], TURNS)
    got = {r[0]: tuple(r)[1:] for r in repair.digests(*repair.repair(turns)).collect()}
    assert got[None][1:7] == (1, 0, 0, 0, 2, "D") and got[1][1:7] == (2, 0, 0, 1, 4, "DD")
    assert got[2][1:7] == (0, 0, 0, 0, 2, "D") and got[3][:7] == (0, 0, 1, 0, 1, 2, "KKD")
    assert repair.digests(*repair.repair(turns.limit(0))).count() == 0
    assert repair.damaged(turns.limit(0)).count() == 0


def test_damage_keeps_to_its_rule(spark):
    import zlib
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for c, t, role, text in rows:
        what = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "A b c")], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got[c, t] == want.get(what, [(role, text)])


# Archives -------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string"


def some_pages():
    long, other = "é" * 700, "y" * 999
    rows = [(i, f"http://h/{i % 7}\n%0A", f"<p>{i}</p>" * (i % 400)) for i in range(300)]
    rows += [(1000 + i, "http://copies/", long) for i in range(50)] + [(2000 + i, None, other) for i in range(5)]
    return [*rows, (None, "u", long), (None, None, None), (5, "twice", "t" * 2000), (5, "twice", "t" * 2000), (3, "x", "")]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archive"


def test_archives_round_trip(spark, folder, tmp_path):
    rows = some_pages()
    pages = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("shard"), F.lit("s").alias("digest"), *clash())
    manifest = warc.write(warc.records(pages), folder, shard_bytes=40_000, file_bytes=3_000)
    files = {r["name"]: r for r in manifest.collect()}
    assert len(files) > 10 and len({r["shard"] for r in files.values()}) > 3
    assert sum(r["records"] for r in files.values()) == len(rows)
    assert not (tmp_path / "archive" / "_temporary").exists()
    for name, r in files.items():
        data = (tmp_path / "archive" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["bytes"], r["sha256"])
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r["records"] + 1
    found = warc.read(manifest, folder)
    got = found.collect()
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "", (r[2] or "").encode()) for r in rows)
    bodies = {(r["key"], r["url"]): r["payload"] for r in got if r["type"] == "response"}
    last = {h: max(k for k, _, x in rows if x == h and k is not None) for _, _, h in rows if h and len(h.encode()) >= 1000}
    want = sorted((k is None, k or 0, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()),
                   last[h] if k is not None and h in last and k < last[h] else None) for k, _, h in rows)
    order = lambda x: (*x[:4], x[4] or 0)
    done = sorted(((r["key"] is None, r["key"] or 0, r["digest"], r["bytes"], r["refers_to"]) for r in warc.resolved(found).collect()), key=order)
    assert done == sorted(want, key=order)
    assert all((n, k, u, bodies[None if n else k, u]) for n, k, u, _ in texts if (None if n else k, u) in bodies)
    # Records lie in order of their keys over shards and files.
    keys = [r["key"] for r in sorted(got, key=lambda r: (r["name"], r["offset"]))]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_archives_are_the_same_however_spark_deals_the_rows(spark, tmp_path):
    seen = []
    for i, n in enumerate((1, 7)):
        folder = f"file://{tmp_path}/{i}"
        pages = spark.createDataFrame(some_pages(), PAGES).repartition(n, F.rand(i))
        manifest = warc.write(warc.records(pages), folder, shard_bytes=40_000, file_bytes=3_000)
        seen.append({r["name"]: r["sha256"] for r in manifest.collect()})
    assert seen[0] == seen[1]


def test_archive_commit_can_be_repeated_and_damage_is_found(spark, folder, tmp_path):
    manifest = warc.write(warc.records(spark.createDataFrame(some_pages(), PAGES)), folder)
    batch = manifest.select("*", F.concat(F.lit("_temporary/"), "name").alias("temporary")).toArrow().to_batches()[0]
    assert list(warc._commit_batches(folder)(iter([batch])))  # moved already
    name = manifest.first()["name"]
    path = tmp_path / "archive" / name
    path.write_bytes(path.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut off|Error"):
        warc.read(manifest, folder).collect()
    path.unlink()
    with pytest.raises(FileNotFoundError):
        list(warc._commit_batches(folder)(iter([batch])))


def test_empty_archives(spark, folder):
    manifest = warc.write(warc.records(spark.createDataFrame([], PAGES)), folder)
    assert manifest.count() == 0 and warc.resolved(warc.read(manifest, folder)).count() == 0


# Merkle manifest ------------------------------------------------------------------------------
def plain_tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i:i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
    return levels


def plain_fold(levels, at, value, fan):
    proof = []
    for below in levels[:-1]:
        first = at // fan * fan
        run = below[first:first + fan]
        proof += run[:at - first] + run[at - first + 1:]
        value = hashlib.sha256("".join([*run[:at - first], value, *run[at - first + 1:]]).encode()).hexdigest()
        at //= fan
    return value, proof


def test_midstates_are_those_of_sha256():
    rng = random.Random(2)
    for blocks in (0, 1, 2, 5):
        text = "".join(rng.choice("0123456789abcdef") for _ in range(64 * blocks)).encode()
        state = merkle.begun(1)
        for i in range(blocks):
            state = merkle.compress(state, np.frombuffer(text, np.uint8)[64 * i:64 * i + 64].reshape(1, 64))
        assert merkle.finished(state, np.array([blocks])).tobytes() == hashlib.sha256(text).digest()


@pytest.mark.parametrize("fan, chunk", [(2, 4), (2, 4096), (3, 9), (4, 4)])
def test_manifest_against_a_plain_tree(spark, fan, chunk):
    rng = random.Random(fan)
    sha = lambda x: hashlib.sha256(str(x).encode())
    groups = {None: 23, "a": 64, "é": 1, "b": 65, "z": 7, "y": 5}
    rows, plain = [], {}
    for g, n in groups.items():
        keys = [None, *range(n - 1)]
        leaves = [sha((g, k)) for k in keys]
        claims = [sha((g, k, "other")) if rng.random() < 0.3 else x for k, x in zip(keys, leaves)]
        rows += [(k, g, x.digest(), c.digest()) for k, x, c in zip(keys, leaves, claims)]
        plain[g] = ([x.hexdigest() for x in leaves], [c.hexdigest() for c in claims], keys)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree(plain[g][0], fan) for g in groups}
    top = plain_tree([trees[g][-1][0] for g in order], fan)
    want = {}
    for g, (leaves, claims, keys) in plain.items():
        for i, k in enumerate(keys):
            value, proof = plain_fold(trees[g], i, claims[i], fan)
            value, more = plain_fold(top, order.index(g), value, fan)
            want[g, k] = (leaves[i], trees[g][-1][0], top[-1][0], sha("".join(proof + more)).hexdigest(), value)
    rng.shuffle(rows)
    leaves = spark.createDataFrame(rows, "key long, grp string, leaf binary, claim binary").select("*", F.lit(9).alias("rank"))
    got = {(r["grp"], r["key"]): tuple(r)[2:] for r in merkle.manifest(leaves, fan, chunk).collect()}
    assert got == want


def test_manifest_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "wörd " * 50_000)], "doc_id long, text string")
    leaf = merkle.leaf([merkle.field("doc_id"), merkle.field("text")])
    leaves = docs.select(F.col("doc_id").alias("key"), F.lit("g").alias("grp"), leaf.alias("leaf"), leaf.alias("claim"))
    rows = merkle.manifest(leaves).collect()
    assert len(rows) == 4 and all(r["folded"] == r["root"] for r in rows) and len({r["root"] for r in rows}) == 1
    assert {r["leaf"] for r in rows if r["key"] == 1} == {hashlib.sha256(b"1:1-").hexdigest()}
    assert {r["leaf"] for r in rows if r["key"] is None} == {hashlib.sha256(b"-0:").hexdigest()}
    one = merkle.manifest(leaves.where("key = 2")).first()
    assert one["leaf"] == one["root"] == one["folded"] and one["proof"] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(leaves.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(leaves, 3, 10)


def test_tampering_is_seen(spark):
    rows = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    import zlib
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in rows) and len(rows) == 200
    assert {len(list(x)) for _, x in itertools.groupby(sorted(r["root"] for r in rows))} == {200}
