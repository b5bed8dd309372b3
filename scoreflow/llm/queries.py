"""The registered queries of the ten operators, and SQL where SQL can say the same.

Each query applies its operator to its whole table and derives the columns it has to return.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed, shared_folder
from scoreflow.llm import (chat, covertree, langid, merkle, mixing, pieces, pii, quality, repair, reputation, simhash,
                           topk, warc)
from scoreflow.llm.common import held_out, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODEL = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
FINGERPRINT_BUDGET = 4


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_pii")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, per document."""
    found = pii.find(read(spark, d, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))  # noqa: E731
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(  # noqa: E731
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select(
        F.col("key").alias("doc_id"), *counts, F.sha2(F.encode(said(of(*pii.BASE)), "utf-8"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"))


@query("op2_cover_tree_pairs")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return covertree.near_pairs(read(spark, d, "embeddings"), 0.95)


@query("op3_quality")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    stats = checkpointed(quality.statistics(read(spark, d, "documents")))
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("y"))
    model = quality.fit(stats.join(labels.where(~held_out("key", 3, 1)), "key"))
    return quality.scored(stats, model).select(
        F.col("key").alias("doc_id"), held_out("key", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_mix_sources", """
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source
             ORDER BY md5(doc_id || '|7'), CAST(doc_id AS VARCHAR), md5(text)) - 1 AS r,
           dense_rank() OVER (ORDER BY source) - 1 AS turn FROM documents),
n AS (SELECT count(DISTINCT source) AS sources FROM documents)
SELECT doc_id, source, CAST(r // 64 AS BIGINT) AS block,
       CAST((r // 64) * sources + turn AS BIGINT) AS slot, CAST(r % 64 AS BIGINT) AS place FROM s, n""")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """All documents at their place of a mixture with equal weights, in blocks of 64."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return mixing.mix(docs, tie="digest").select("row.doc_id", "row.source", "block", "slot", "place")


# Target weights of the mixture that is registered; sources not named here weigh 1.
TARGETS = {"src0": 3.0, "src1": 0.5, "src2": 1.7, "src3": 0.25}


@query("op4_mix_sources_to_targets")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All documents at their place of a mixture with the weights ``TARGETS``, in blocks of 8."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return mixing.mix(docs, TARGETS, block_rows=8, tie="digest").select("row.doc_id", "row.source", "block", "slot", "place")


@query("op5_simhash")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = simhash.fingerprints(read(spark, d, "documents"), words=4, size=1)
    blocks = simhash.blocks_for(64, FINGERPRINT_BUDGET + 1)
    return simhash.classes(prints, FINGERPRINT_BUDGET, blocks).select(
        F.col("key").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """Piece ids of every document, and the digest of what they decode to."""
    model = pieces.read_model(MODEL)
    made = pieces.decode(pieces.encode(read(spark, d, "documents"), model), model)
    return made.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids",
                       F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


SUFFIX_SQL, DOMAIN_SQL = reputation.suffix_patterns(reputation.TWO_LABEL_SUFFIXES)


def _prior_sql(name: str, groups: str) -> str:
    """Mean and strength of one level, as in ``reputation._prior``."""
    return f"""{name}_sums AS (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS sn, CAST(coalesce(sum(k), 0) AS DOUBLE) AS sk,
  CAST(coalesce(sum(n * n), 0) AS DOUBLE) AS snn, coalesce(sum(CAST(k * k AS DOUBLE) / n), 0) AS skkn,
  CAST(count(*) AS DOUBLE) AS g FROM {groups} WHERE n > 0),
{name}_mean AS (SELECT *, CASE WHEN sn > 0 THEN sk / sn ELSE 0.5 END AS m FROM {name}_sums),
{name}_free AS (SELECT *, m * (1 - m) AS v, m * (1 - m) * (sn - snn / nullif(sn, 0) - (g - 1)) AS f FROM {name}_mean),
{name} AS (SELECT m, 1 / greatest({reputation.LEAST_RHO}, least({reputation.MOST_RHO},
  CASE WHEN sn > 0 AND g > 1 AND f > 0 THEN (skkn - m * sk - (g - 1) * v) / f ELSE 1.0 / 3 END)) - 1 AS s FROM {name}_free)"""


OP7_SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '{reputation.URL}', 1),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '{reputation.URL}', 2), '') AS path FROM pages),
o AS (SELECT host, quality FROM p JOIN labels ON doc_id =
  TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT) WHERE quality IS NOT NULL),
c AS (SELECT host, regexp_extract(host, '{DOMAIN_SQL}', 1) AS domain, regexp_extract(host, '{SUFFIX_SQL}', 1) AS suffix,
  CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT DISTINCT host, 0 AS n, 0 AS k FROM p
  UNION ALL SELECT host, 1, quality FROM o) GROUP BY 1),
gs AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM c GROUP BY 1),
gd AS (SELECT suffix, domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM c GROUP BY 1, 2),
{_prior_sql("ph", "c")}, {_prior_sql("ps", "gs")}, {_prior_sql("pd", "gd")},
ms AS (SELECT suffix, (k + ps.s * ph.m) / (n + ps.s) AS above FROM gs, ps, ph),
md AS (SELECT suffix, domain, (k + pd.s * above) / (n + pd.s) AS above FROM gd JOIN ms USING (suffix), pd),
mh AS (SELECT host, n, s, (k + ph.s * above) / (n + ph.s) AS mean FROM c JOIN md USING (suffix, domain), ph),
b AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound FROM mh),
r AS (SELECT page_id, host, path, round(bound, 6) AS bound, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS judged,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' ELSE judged END AS verdict, bound FROM r"""


@query("op7_url_filter", OP7_SQL)
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every url; outcomes are the quality labels of the documents that urls name by number."""
    pages = read(spark, d, "pages").select("page_id", "url")
    number = F.regexp_extract(reputation.path_of(F.col("url")), "/([0-9]{1,18})[^0-9]*$", 1)
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").alias("good"))
    named = pages.select("url", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    return reputation.filter_urls(pages, named.join(labels, "doc_id").select("url", "good"), RULES)


@query("op8_top_k")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.top_k(read(spark, d, "embeddings"), every=20, k=20)


@query("op9_language")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    learn = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    model = langid.train(langid.gram_counts(learn))
    if model:
        model = langid.calibrate(model, learn)
    return langid.identify(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def _escaped_sql(column: str) -> str:
    for c in ("\\", *chat.CONTROLS):
        column = f"replace({column}, '{c}', '\\{c}')"
    return column


OP10_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql('text')}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 20 + length({_escaped_sql('role')}) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op10_chat", OP10_SQL)
def op10(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(probe)))


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text."""
    return (f"xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], [ascii(c)::UBIGINT for c in "
            f"string_split({text}, '')]), lambda h, b: list_reduce(list_concat([xor(h, b)], [0::UBIGINT for z in range(8)]), "
            f"lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))))")


OP11_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
w AS (SELECT *, {_crc32_sql('name')} % 20 AS what FROM k),
d AS (SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
  CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM w JOIN (VALUES (1), (2)) AS copies(n) ON n = 1 OR what = 3 WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_extract(text, '([^ 	

])[ 	

]*\z', 1) AS ending FROM d),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN ending = '' THEN 1
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS b FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, max(i) AS n,
  count(*) FILTER (b IS NOT NULL AND b || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
more(s, t, word, cost, said) AS (VALUES ('0', '0', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''),
  ('0', 'u', 'I', 5, chr(10) || 'user:'), ('s', 'u', 'I', 5, chr(10) || 'user:'), ('a', 'u', 'I', 5, chr(10) || 'user:'),
  ('u', 'a', 'I', 5, chr(10) || 'assistant:'), ('0', 'a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 'a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', 'II', 10, chr(10) || 'assistant:' || chr(10) || 'user:'), ('a', 'a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
legal(s, t) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edges AS (SELECT conv_id, i, l.s, l.t, 'R' AS word, CASE fault WHEN 3 THEN 6 ELSE 1 END AS cost,
    chr(10) || CASE l.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text AS said FROM f, legal l WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, l.s, l.t, 'K', CASE fault WHEN 3 THEN 5 ELSE 0 END, chr(10) || role || ':' || text
    FROM f JOIN (FROM legal UNION ALL SELECT '0', 's') AS l ON l.t = f.r WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, x.s, x.s, 'D', 2, '' FROM f, (SELECT DISTINCT s FROM more) AS x),
p(conv_id, i, s, best) AS (SELECT conv_id, CAST(0 AS BIGINT), '0', {{'cost': 0, 'audit': '', 'said': ''}} FROM c
  UNION ALL SELECT p.conv_id, p.i + 1, e.t, min({{'cost': best.cost + m.cost + e.cost, 'audit': best.audit || m.word || e.word,
    'said': best.said || m.said || e.said}}) FROM p JOIN more AS m ON m.s = p.s
    JOIN edges AS e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.s = m.t GROUP BY p.conv_id, p.i, e.t),
z AS (SELECT p.conv_id, min({{'cost': best.cost + m.cost, 'audit': best.audit || m.word, 'said': best.said || m.said}}) AS best
  FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n JOIN more AS m ON m.s = p.s AND m.t IN ('0', 'a')
  GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op11_repair_conversations", OP11_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and the digest of what is repaired."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.digests(*repair.repair(repair.damaged(turns)))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    counts = [F.coalesce(F.col(c.split()[0]), F.lit(0)).alias(c.split()[0]) for c in repair.COUNTS]
    return every.join(found, every["id"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM m""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Every page written to archives and read back: its payload, and the response it revisits."""
    folder = posixpath.join(shared_folder(spark), f"warc-{uuid.uuid4().hex}")
    manifest = warc.write(warc.records(read(spark, d, "pages").select("page_id", "url", "html")), folder)
    found = checkpointed(warc.resolved(warc.read(manifest, folder, with_payload=False)))
    warc.remove(folder)  # scratch archives of this query
    return found.select(F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP13_SQL = rf"""
WITH RECURSIVE v AS (SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS a,
  [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS b,
  coalesce({_crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0, false) AS tampered FROM documents),
h AS (SELECT doc_id, lang, sha256(array_to_string([CASE WHEN x IS NULL THEN '-' ELSE CAST(octet_length(encode(x)) AS VARCHAR)
    || ':' || x END for x in a], '')) AS leaf,
  sha256(array_to_string([CASE WHEN x IS NULL THEN '-' ELSE CAST(octet_length(encode(x)) AS VARCHAR) || ':' || x END
    for x in CASE WHEN tampered THEN b ELSE a END], '')) AS claim FROM v),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos FROM h),
t AS (SELECT 0 AS level, lang, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
    FROM t WHERE n > 1 GROUP BY level, lang, pos // 2, n),
r AS (SELECT lang, node AS subroot, level AS high, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM r
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
w AS (SELECT 0 AS level, l.lang, l.pos, l.pos AS place, r.pos AS part, r.high, claim AS node, '' AS proof FROM l
    JOIN r ON r.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT w.level + 1, w.lang, w.pos, w.place // 2, w.part, w.high,
    sha256(CASE WHEN o.node IS NULL THEN w.node WHEN w.place % 2 = 0 THEN w.node || o.node ELSE o.node || w.node END),
    w.proof || coalesce(o.node, '') FROM w
    LEFT JOIN t AS o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.pos = xor(w.place, 1) WHERE w.level < w.high),
x AS (SELECT lang, pos, part AS place, 0 AS level, node, proof FROM w WHERE level = high
  UNION ALL SELECT x.lang, x.pos, x.place // 2, x.level + 1,
    sha256(CASE WHEN o.node IS NULL THEN x.node WHEN x.place % 2 = 0 THEN x.node || o.node ELSE o.node || x.node END),
    x.proof || coalesce(o.node, '') FROM x LEFT JOIN u AS o ON o.level = x.level AND o.pos = xor(x.place, 1)
    WHERE x.level < (SELECT max(level) FROM u)),
g AS (SELECT node AS root, level AS high FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, r.subroot, g.root, sha256(x.proof) AS proof_sha256, x.node AS folded_root, x.node = g.root AS verified
FROM l JOIN r ON r.lang IS NOT DISTINCT FROM l.lang JOIN g ON true
JOIN x ON x.lang IS NOT DISTINCT FROM l.lang AND x.pos = l.pos AND x.level = g.high"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its tampered leaf folds to."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0, F.lit(False))
    true = merkle.leaf([merkle.field(f) for f in fields])
    false = merkle.leaf([merkle.field(f, int(f == "n_chars")) for f in fields])
    leaves = read(spark, d, "documents").select(
        F.col("doc_id").alias("key"), F.col("lang").alias("grp"), true.alias("leaf"), F.when(tampered, false).otherwise(true).alias("claim"))
    return merkle.manifest(leaves).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
