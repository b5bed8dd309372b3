"""Language identification with interpolated Kneser-Ney character models.

Training counts the 4-grams of all training texts on Spark: each task counts the distinct grams of
its batches in numpy, the counts are summed by (language, gram). The lower orders use continuation
counts (numbers of distinct left neighbours), which follow from the distinct 4-grams. The model is
one sorted array of gram codes with the log-probability in every language beside it for each order,
plus back-off weights, so a lookup is one binary search for all languages.

Texts are lower-cased, anything but letters becomes one space, and a text starts and ends with a
space. The language with the lowest cross-entropy per character wins. The score is the softmax of
the length-weighted entropies, calibrated: it is scaled so that the rejection threshold, learned
from training texts as a quantile of the winner's cross-entropy, is where the score falls to 0.5 of
its value. Rejected texts keep the winner unless ``reject`` is set, then they become ``und``.

Null texts and texts without a letter are ``und`` with score 0. Rows with null language do not
train. A corpus without training rows predicts ``und`` for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import texts

ORDER = 4
# Letters share 97 symbols by the remainder of their code point, which keeps a-z and the Latin-1
# letters apart: at most 98^4 grams exist whatever the corpus, so the model's size is bounded.
SYMBOLS, SYMBOL_BITS = 97, 7
BATCH_CHARS = 2_000_000
DISCOUNT = 0.75
_letters: np.ndarray | None = None


def _alphabet() -> np.ndarray:
    """For each code point its symbol: 0 for what is not a letter."""
    global _letters
    if _letters is None:
        codes = np.arange(0x110000)
        known = np.fromiter((chr(c).isalpha() for c in codes), bool, len(codes))
        _letters = np.where(known, 1 + (codes - 1) % SYMBOLS, 0)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Symbols of a text: letters lower-cased, runs of others as one 0, a 0 at both ends; or empty."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.concatenate([[0], _alphabet()[codes], [0]]).astype(np.int64)
    kept = found[np.append(True, (found[1:] != 0) | (found[:-1] != 0))]
    return kept if len(kept) > 2 else kept[:0]


def grams(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of all grams, one for each symbol after the first; missing left context is 0."""
    padded = np.concatenate([np.zeros(order - 2, np.int64), sym])
    n = len(sym) - 1
    code = np.zeros(n, np.int64)
    for i in range(order):
        code = (code << SYMBOL_BITS) | padded[i:i + n]
    return code


def _slices(column: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts as symbols, in groups of about BATCH_CHARS."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts(column)):
        sym = symbols(text)
        rows.append(i)
        parts.append(sym)
        size += len(sym)
        if size >= BATCH_CHARS:
            yield rows, parts
            rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for rows, parts in _slices(batch.column(1)):
            by: dict[str, list[np.ndarray]] = {}
            for i, sym in zip(rows, parts):
                if len(sym):
                    by.setdefault(langs[i], []).append(grams(sym))
            for lang, codes in by.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)],
                    names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of 4-grams by language over all rows with a language."""
    rows = docs.where(docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"),
                                                     docs[text].cast("string").alias("text"))
    return (rows.mapInArrow(_count_batches, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Sorted codes of each order with log-probabilities by language, lowest order first."""

    langs: list[str]
    codes: list[np.ndarray]
    logs: list[np.ndarray]
    backs: list[np.ndarray]  # log back-off weight of contexts, aligned with contexts
    contexts: list[np.ndarray]
    floor: np.ndarray
    limit: float = np.inf
    scale: float = 1.0

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each gram after the others: grams x languages."""
        out = np.tile(self.floor, (len(gram), 1))
        todo = np.arange(len(gram))
        weight = np.zeros((len(gram), len(self.langs)))
        for order in range(ORDER, 0, -1):
            if not len(todo):
                break
            mask = (1 << (SYMBOL_BITS * order)) - 1
            codes, part = self.codes[order - 1], gram[todo] & mask
            at = np.minimum(np.searchsorted(codes, part), max(len(codes) - 1, 0))
            hit = codes[at] == part
            out[todo[hit]] = weight[todo[hit]] + self.logs[order - 1][at[hit]]
            todo = todo[~hit]
            if order > 1 and len(todo):
                known, context = self.contexts[order - 1], (gram[todo] & mask) >> SYMBOL_BITS
                at = np.minimum(np.searchsorted(known, context), max(len(known) - 1, 0))
                hit = known[at] == context
                weight[todo[hit]] += self.backs[order - 1][at[hit]]
        if len(todo):
            out[todo] = weight[todo] + self.floor
        return out


def train(counts: DataFrame) -> Model | None:
    """The model from gram counts; its size is that of the distinct grams of the alphabets in use."""
    table = counts.toPandas()
    if not len(table):
        return None
    langs = sorted(table["lang"].unique())
    column = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    code, at = np.unique(table["gram"].to_numpy(), return_inverse=True)
    count = np.zeros((len(code), len(langs)))
    np.add.at(count, (at, column), table["n"].to_numpy())
    tables = [(code, count)]
    for order in range(ORDER - 1, 0, -1):
        longer, n = tables[0]
        part, at = np.unique(longer & ((1 << (SYMBOL_BITS * order)) - 1), return_inverse=True)
        kinds = np.zeros((len(part), len(langs)))
        np.add.at(kinds, at, (n > 0).astype(float))
        tables.insert(0, (part, kinds))
    size = len(tables[0][0]) + 1
    lower = np.full((1, len(langs)), 1.0 / size)
    codes, logs, backs, contexts = [], [], [], []
    for order, (code, count) in enumerate(tables, 1):
        context, at = np.unique(code >> SYMBOL_BITS, return_inverse=True)
        total, kinds = np.zeros((2, len(context), len(langs)))
        np.add.at(total, at, count)
        np.add.at(kinds, at, (count > 0).astype(float))
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-300), 1.0)
        if order == 1:
            below = np.repeat(lower, len(code), axis=0)
        else:
            place = np.searchsorted(codes[-1], code & ((1 << (SYMBOL_BITS * (order - 1))) - 1))
            below = np.exp(logs[-1][place])
        seen = np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1e-300)
        codes.append(code)
        logs.append(np.log(seen + back[at] * below))
        backs.append(np.log(back))
        contexts.append(context)
    floor = np.log(lower[0]) + backs[0][0]
    return Model(langs, codes, logs, backs, contexts, floor)


def entropies(model: Model, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text (rows) in each language, and the lengths."""
    n = np.array([max(len(p) - 1, 0) for p in parts])
    total = np.zeros((len(parts), len(model.langs)))
    if n.any():
        code, at = np.unique(np.concatenate([grams(p) for p in parts if len(p)]), return_inverse=True)
        logs = model.log_prob(code)
        full = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[full]
        for j in range(len(model.langs)):
            total[full, j] = np.add.reduceat(logs[:, j][at], starts)
    return -total / np.maximum(n, 1)[:, None], n


def _scored(model: Model, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: best language, its entropy, margin to the next, length."""
    for _, parts in _slices(column):
        h, n = entropies(model, parts)
        best = h.argmin(1)
        rows = np.arange(len(h))
        least = h[rows, best]
        rest = h.copy()
        rest[rows, best] = np.inf
        margin = rest.min(1) - least if h.shape[1] > 1 else np.full(len(h), 1.0)
        yield best, least, margin, n


def calibrate(model: Model, docs: DataFrame, text: str = "text", keep: float = 0.999) -> Model:
    """Set the rejection limit: the ``keep`` quantile of the winner's cross-entropy on these rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, least, margin, n in _scored(shared.value, batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(least[n > 0]), pa.array(margin[n > 0])],
                                                 names=["h", "margin"])

    scores = docs.select(docs[text].cast("string").alias("t")).mapInArrow(batches, "h double, margin double")
    row = scores.agg(F.percentile_approx("h", keep, 10_000), F.percentile_approx("margin", 0.05, 10_000)).first()
    if row[0] is not None:
        model.limit, model.scale = float(row[0]), max(float(row[1]), 1e-3)
    return model


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text",
             reject: bool = False) -> DataFrame:
    """Columns ``key, lang_pred, score, cross_entropy, rejected`` for every row."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in parts:
            names, scores, h, out = [], [], [], []
            if fitted is None:
                n = batch.num_rows
                names, scores, h, out = ["und"] * n, [0.0] * n, [None] * n, [True] * n
            for best, least, margin, n in _scored(fitted, batch.column(1)) if fitted else ():
                far = np.clip((least - fitted.limit) / np.log(2), 0, 50)
                sure = 0.5 + 0.5 * np.tanh(margin / (2 * fitted.scale))
                bad = (least > fitted.limit) | (n == 0)
                score = np.where(n > 0, sure * 0.5 ** far, 0.0)
                for i in range(len(best)):
                    gone = n[i] == 0 or (reject and bad[i])
                    names.append("und" if gone else fitted.langs[best[i]])
                    h.append(float(least[i]) if n[i] else None)
                scores += score.tolist()
                out += bad.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(h, pa.float64()), pa.array(out, pa.bool_())],
                names=["key", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(batches, schema)
