"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

``scan`` finds spans in one text; ``find`` maps it over a frame in Arrow batches (no shuffle), and
``redacted`` replaces the spans. Offsets are code points, end exclusive.

Base kinds (email, ip, card, phone) are always kept once their checks hold: parts of an address up
to 255, Luhn for cards, 9 to 15 digits for phones. The other kinds start from a score, raised by a
passed checksum (mod 97 for iban) and by context words within 40 code points, lowered by words that
speak against them, and are kept from ``LEAST``. Null and empty texts have no spans. Spans of one
kind never overlap; spans of different kinds may. Time is linear in the text, also for long runs of
digits. Rows are independent, so nulls in other columns, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scoreflow.llm.common import parts_of, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "mac")
NEAR = 40
ROWS_AT_ONCE = 1024
LEAST = 0.5
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: what fails at its start fails everywhere in it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
# Words that raise or lower the score of a kind.
FOR = {
    "email": re.compile(r"\b(?:mail|e-mail|email|contact|write|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tel[ée]fono|appel)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer)\b", re.I),
    "mac": re.compile(r"\b(?:mac|device|adapter|hardware)\b", re.I),
}
AGAINST = re.compile(r"\b(?:example|sample|dummy|isbn|version|order|invoice|test)\b", re.I)
START = {"email": 0.9, "ip": 0.7, "card": 0.7, "phone": 0.6, "iban": 0.3, "ssn": 0.35, "mac": 0.5}
CHECKED, FOR_STEP, AGAINST_STEP = 0.3, 0.25, 0.2

Span = tuple[int, int, int, float]  # start, place in KINDS, end, score


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of account numbers: letters as 10 to 35, first four characters last."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = HOST.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans whose hard checks hold, and whether a check sum confirmed them."""
    for start, end in _emails(text):
        yield "email", start, end, False
    for m in IP.finditer(text) if "." in text else ():
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) < 3 or len(part) == 3 and part <= "255" for part in parts):
            yield "ip", m.start(), m.end(), False
    for m in CARD.finditer(text):
        if len(m[0]) < 38 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        yield "iban", m.start(), m.end(), len(code) >= 15 and mod97(code)
    for m in SSN.finditer(text) if "-" in text else ():
        yield "ssn", m.start(), m.end(), False
    for m in MAC.finditer(text) if ":" in text else ():
        yield "mac", m.start(), m.end(), False


def scan(text: str | None) -> list[Span]:
    """All kept spans by start, then kind."""
    found = []
    for kind, start, end, checked in _proposals(text or ""):
        around = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
        score = START[kind] + CHECKED * checked
        score += FOR_STEP * bool(FOR[kind].search(around)) - AGAINST_STEP * bool(AGAINST.search(around))
        if kind in BASE or score >= LEAST:
            found.append((start, KINDS.index(kind), end, round(min(1.0, max(0.0, score)), 2)))
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                  ("score", pa.float64())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in scan(t)]
                 for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_SPANS)],
                                         names=["key", "spans"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key, spans`` for every row, repeated rows included."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_scan_batches, f"key {kind}, spans {SPANS}")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    parts, done = [], 0
    for start, kind, end, _ in scan(text):
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` replaced; null stays null.

    ``length`` names a column to set to the new number of code points.
    """
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length else None

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(rows, ROWS_AT_ONCE):
            column = batch.column(at)
            new = pa.array([None if not v.is_valid else redact(v.as_py()) for v in column], column.type)
            columns = list(batch.columns)
            columns[at] = new
            if size is not None:
                counted = pc.utf8_length(new).cast(columns[size].type)
                columns[size] = pc.if_else(pc.is_valid(new), counted, columns[size])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(batches, docs.schema)
