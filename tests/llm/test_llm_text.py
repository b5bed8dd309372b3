"""Personal data, chat formatting, language and pieces against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreflow.llm import chat, langid, pieces, pii
from scoreflow.llm.queries import MODEL, QUERIES

SF = "/root/testdata/sf0.001"
ODD_DOCS = [(1, None, "en"), (2, "", "en"), (3, "   \n", None), (4, "Hello there a@b.co", "en"),
            (4, "Hello there a@b.co", "en"), (None, "x 1.2.3.4", None), (6, "wörd " * 30000, "de")]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    return spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string").select(
        "*", F.lit(1).alias("key"), F.lit("s").alias("score"), F.lit(2).alias("row"), F.lit(3).alias("spans"))


# Personal data --------------------------------------------------------------------------------
def plain_spans(text):
    """Base spans by the patterns as they are written down."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card, phone = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda t: [int(c) for c in t if c in "0123456789"]
    out = []
    for kind, pattern in (("email", email), ("ip", ip), ("card", card), ("phone", phone)):
        for m in re.finditer(pattern, text):
            d = digits(m[0])
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), pii.BASE.index(kind), m.end()))
    return sorted(out)


def base(text):
    return [s[:3] for s in pii.scan(text) if s[1] < len(pii.BASE)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123456789()é%_", max_size=80))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == plain_spans(text)


def test_long_runs_of_digits_take_linear_time():
    import time
    start = time.perf_counter()
    run = "1" * 1_000_000
    assert base("a. " + run + " 1.2.3.4 " + run) == [(1_000_004, 1, 1_000_011)]
    assert base("9" * 5_000 + ".1.2.3 and 0" + "0" * 5_000 + "25.1.2.255") == [(5_011, 1, 5_011 + 5_011)]
    assert base("1.2.3.256 1.2.3.00255 .1.2.3.4.5.6.7.8") == plain_spans("1.2.3.256 1.2.3.00255 .1.2.3.4.5.6.7.8")
    assert time.perf_counter() - start < 20


def test_base_spans_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    assert all(base(r["text"]) == plain_spans(r["text"]) for r in docs)
    assert sum(len(base(r["text"])) for r in docs) > 0


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    kinds = lambda t: [pii.KINDS[s[1]] for s in pii.scan(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB83 WEST 1234 5698 7654 32 now") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.scan("call +44 20 7946 0958")[0][3] > pii.scan("x +44 20 7946 0958")[0][3]
    assert pii.redact("mail a@b.co, or +44 20 7946 0958") == "mail [EMAIL], or [PHONE]"


def test_pii_edge_rows(spark, odd):
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD_DOCS)
    assert {r["key"]: len(r["spans"]) for r in rows} == {1: 0, 2: 0, 3: 0, 4: 1, None: 1, 6: 0}
    new = pii.redacted(odd.withColumn("n_chars", F.lit(9).cast("long")), "text", "n_chars")
    assert new.columns == [*odd.columns, "n_chars"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in new.collect()}
    assert got[1] == (None, 9) and got[4] == ("Hello there [EMAIL]", 19) and len(got[6][0]) == 150000
    assert pii.find(odd.limit(0)).count() == 0


def test_pii_query(spark):
    row = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in texts:
        said = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in plain_spans(text))
        assert row[doc_id]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# Chat -----------------------------------------------------------------------------------------
ROLE = st.sampled_from(["system", "user", "assistant", "tool", "", "a[/ROLE]b"])
PART = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "/", "s>", "x", "é", "\n", "INST]"]), max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, PART.map("".join)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    roles, texts = [r for r, _ in turns], [t for _, t in turns]
    out, starts, _ = chat.assemble(roles, pa.array([chat.escape(t) for t in texts], pa.large_string()))
    formatted = out.tobytes().decode()
    assert list(chat.parse(formatted)) == turns
    assert starts[-1] == len(out)


def batch(rows):
    conv, turn, role, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()),
                                       pa.array(text, pa.string())], names=["conv_id", "turn", "role", "text"])


def test_giant_conversations_in_pieces(monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"é{c}.{t} </s>" * 7) for c in (1, 2, 3) for t in range(40 * c)]
    whole = list(chat._format(iter([batch(rows)])))
    monkeypatch.setattr(chat, "PIECE_BYTES", 500)
    cut = list(chat._format(iter([batch(rows[i:i + 7]) for i in range(0, len(rows), 7)])))
    assert sum(b.num_rows for b in whole) == 3 < sum(b.num_rows for b in cut)
    digest = lambda batches: [r for b in chat._digest(iter(batches)) for r in b.to_pylist()]
    assert digest(whole) == digest(cut)
    said = "".join(t for c, _, r, t in rows if c == 2 and r == "assistant")
    assert digest(cut)[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_edge_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "a"), (None, None, "assistant", ""), (2, 0, "assistant", "x\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 2 and got[2]["loss_chars"] == 2
    assert got[2]["formatted_chars"] == len("<s>x\\\\</s>")
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


# Language -------------------------------------------------------------------------------------
def plain_model(samples):
    """Interpolated Kneser-Ney by dictionaries, over tuples of symbols."""
    langs = sorted({lang for _, lang in samples})
    top = {x: Counter() for x in langs}
    for text, lang in samples:
        sym = [0] * (langid.ORDER - 2) + langid.symbols(text).tolist()
        for i in range(len(sym) - langid.ORDER + 1):
            top[lang][tuple(sym[i:i + langid.ORDER])] += 1
    orders = {x: {langid.ORDER: top[x]} for x in langs}
    for x in langs:
        for n in range(langid.ORDER - 1, 0, -1):
            orders[x][n] = Counter(g[1:] for g in orders[x][n + 1])
    size = len({g for x in langs for g in orders[x][1]}) + 1

    def prob(lang, gram):
        if not gram:
            return 1 / size
        counts = orders[lang][len(gram)]
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return prob(lang, gram[1:])
        seen = max(counts[gram] - langid.DISCOUNT, 0) if gram in counts else 0
        return (seen + langid.DISCOUNT * len(same) * prob(lang, gram[1:])) / sum(same)
    return langs, prob


def test_language_model_is_kneser_ney(spark):
    samples = [("the cat sat on the mat", "en"), ("that cat and this", "en"), ("le chat été là", "fr"), ("les chats", "fr"), ("", "en")]
    docs = spark.createDataFrame(samples, "text string, lang string")
    model = langid.train(langid.gram_counts(docs))
    langs, prob = plain_model(samples)
    assert model.langs == langs
    for text in ("the chat", "zz qq", "été", "mat les"):
        sym = langid.symbols(text)
        padded = [0] * (langid.ORDER - 2) + sym.tolist()
        got = model.log_prob(langid.grams(sym))
        for i in range(len(sym) - 1):
            for j, lang in enumerate(langs):
                want = math.log(prob(lang, tuple(padded[i:i + langid.ORDER])))
                assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_language_edge_rows(spark, odd):
    model = langid.calibrate(langid.train(langid.gram_counts(odd)), odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD_DOCS)
    by = {r["key"]: r for r in got}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[1]["score"] == 0
    assert by[6]["lang_pred"] == "de" and 0 <= by[6]["score"] <= 1
    assert langid.train(langid.gram_counts(odd.limit(0))) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_language_held_out(spark):
    got = QUERIES["op9_language"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


# Pieces ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(MODEL)


@pytest.fixture(scope="module")
def unigram(model):
    """The same pieces as a unigram model, the scores in the range of such models."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -5 + p.score / 4000 if p.score > -1e8 else -15
    return proto.SerializeToString()


WORDS = ["the", "Hello", "naïve", "日本", "  ", "\n\n", "\t", "antidisestablishment", "x" * 40, "1234567", "ß", "🙂", " ", "aaaa"]


def test_pieces_are_those_of_the_library(library, model):
    rng, v = random.Random(3), pieces.Vocabulary(model)
    for _ in range(300):
        text = "".join(rng.choice(WORDS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text)
        assert v.encode(text) == ids
        assert v.decode(ids) == library.decode(ids) == text


def chunked(v, text, chunk):
    s, side, out, matrices, windows = v.prefix + text.replace(" ", pieces.SPACE), v.longest, [], [], []
    for at in range(0, len(s), chunk):
        begin = max(0, at - side)
        windows.append((s[begin:begin + chunk + 2 * side], at - begin, min(len(s), at + chunk) - begin))
    for w in windows:
        matrices.append({(e, x): weight for e, x, weight in v.matrix(*w)})
    whole = matrices[0]
    for m in matrices[1:]:
        whole = pieces.combined(whole, m)
    states = pieces.route(matrices, ("", 0), pieces.best_end(whole))
    for w, a, b in zip(windows, states, states[1:]):
        out += v.traced(*w, a, b)
    return out, matrices


def test_chunks_give_the_same_pieces(library, model, unigram):
    rng, v, u = random.Random(5), pieces.Vocabulary(model), pieces.Vocabulary(unigram)
    for i in range(12):
        text = "".join(rng.choice(WORDS) + rng.choice(["", " ", ""]) for _ in range(120))
        if i % 3 == 0:
            text = text.replace(" ", "")  # no border anywhere
        got, matrices = chunked(v, text, rng.randint(64, 150))
        assert got == library.encode(text)
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            assert pieces.combined(pieces.combined(a, b), c) == pieces.combined(a, pieces.combined(b, c))
        weight = lambda ids: sum(u.scores.get(u.names[i], 0) for i in ids)
        assert weight(chunked(u, text, 100)[0]) == pytest.approx(weight(u.encode(text)))


def test_unigram_pieces_are_those_of_the_library(unigram):
    sentencepiece = pytest.importorskip("sentencepiece")
    processor, u = sentencepiece.SentencePieceProcessor(model_proto=unigram), pieces.Vocabulary(unigram)
    for text in ("Hello world", "the naive approach", "aaaa bbbb"):
        assert u.encode(text) == processor.encode(text)


def test_encode_on_spark(spark, odd, library, model):
    long = spark.createDataFrame([(7, "word " * 900 + "x" * 3000 + "日本" * 500), (7, "word " * 900)], "doc_id long, text string")
    docs = odd.unionByName(long, allowMissingColumns=True)
    docs = docs.unionAll(docs.where("doc_id = 6"))  # a repeated giant
    got = pieces.decode(pieces.encode(docs, model, chunk=512), model).collect()
    want = docs.select("doc_id", "text").collect()
    assert len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r["key"]].append((r["ids"], r["text"]))
    for doc_id, text in want:
        ids = None if text is None else library.encode(text)
        assert (ids, text) in by[doc_id]
    assert pieces.encode(odd.limit(0), model).count() == 0


def test_vocabulary_needs_the_identity_normalizer(model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.name = "nmt_nfkc"
    with pytest.raises(ValueError):
        pieces.Vocabulary(proto.SerializeToString())


def test_symbols():
    assert langid.symbols("").size == 0 and langid.symbols("12 !").size == 0
    assert np.array_equal(langid.symbols("Ab"), langid.symbols("..aB9"))
