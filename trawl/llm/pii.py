"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, digits, plus signs before digits, dots before
digits, and identifier cues. Deterministic local parsers grow each anchor to its boundaries and validate what they find.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import slices, small_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Spans that the method finds beyond the base kinds: credentials before the host of a link, accounts after a cue.
MORE_KINDS = ("login", "iban", "account")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"([^\s/?#@:]+):([^\s/?#@]+)@(?=[A-Za-z0-9\[])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}")
_GAP = re.compile(r"(?:[\x20\t]*(?:number|no\.?|nr\.?|id))?[\x20\t]*[:#=]?[\x20\t]*", re.I)
_NUMBER = re.compile(r"[A-Za-z]{0,2}[0-9](?:[\x20-]?[0-9]){5,17}(?![A-Za-z0-9])")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")

#: Words after which a number is an account or identity number.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "compte", "cuenta", "routing")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
        found.add_word("." + d, ("dot", 2))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _left_run(text: str, at: int, floor: int, chars: frozenset[str]) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """The base spans and those the method adds, by kind and start.

    Within a base kind, matches are leftmost and do not overlap: a candidate that fails its validation still uses up its
    text. Of the added kinds, what lies inside a base span of any kind is left out.
    """
    base: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    used = dict.fromkeys((*BASE_KINDS, *MORE_KINDS), 0)
    more: list[Span] = []
    for last, (what, width) in anchors.iter(text):
        start, end = last + 1 - width, last + 1
        if what == "digit":
            if start >= used["card"] and (m := _CARD.match(text, start)):
                used["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    base["card"].append(Span("card", start, m.end()))
        elif what == "dot":
            if start >= used["ip"]:
                first = _left_run(text, start, used["ip"], _DIGITS)
                if first < start and (m := _IP.match(text, first)):
                    used["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        base["ip"].append(Span("ip", first, m.end()))
        elif what == "plus":
            if start >= used["phone"] and (m := _PHONE.match(text, start)):
                used["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    base["phone"].append(Span("phone", start, m.end()))
        elif what == "at":
            if start >= used["email"]:
                first = _left_run(text, start, used["email"], _LOCAL_CHARS)
                if first < start and (m := _DOMAIN.match(text, end)):
                    used["email"] = m.end()
                    base["email"].append(Span("email", first, m.end()))
        elif what == "scheme":
            if end >= used["login"] and (m := _LOGIN.match(text, end)):
                used["login"] = m.end()
                more.append(Span("login", end, m.end() - 1))
        elif start == 0 or not text[start - 1].isalnum():
            at = _GAP.match(text, end).end()
            if at > end and at >= used["iban"] and (m := _IBAN.match(text, at)) and iban_valid(m[0].replace(" ", "").replace("-", "")):
                used["iban"] = m.end()
                more.append(Span("iban", at, m.end()))
            elif at > end and at >= used["account"] and (m := _NUMBER.match(text, at)):
                used["account"] = m.end()
                more.append(Span("account", at, m.end()))
    spans = [s for k in BASE_KINDS for s in base[k]]
    whole = sorted((s.start, s.end) for s in spans)
    for k in MORE_KINDS:
        spans += [s for s in sorted(more) if s.kind == k and not any(a <= s.start and s.end <= b for a, b in whole)]
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_FOUND = "array<struct<kind:string,start:int,end:int>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and pii, an array of (kind, start, end) in code points, end exclusive, for every row of docs.

    Null and empty texts have none; repeated rows are judged alike; columns beyond doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[s._asdict() for s in find_spans(t, anchors)] for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "pii"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, f"doc_id long, pii {_FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    number = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, word), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", word), ",").alias("spans"),
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data in `text` masked and all other columns as they are; null texts stay null."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    where = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                masked = [None if t is None else mask(t, find_spans(t, anchors)) for t in part.column(where).to_pylist()]
                yield part.set_column(where, part.schema.field(where), pa.array(masked, part.schema.field(where).type))

    return docs.mapInArrow(scan, schema)
