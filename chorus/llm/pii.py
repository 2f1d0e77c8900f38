"""Personal data: patterns propose spans, checksums confirm them, context words adjust
their score.

Base spans (the leftmost non-overlapping matches of one pattern per kind, failing
ones dropped without retry) are always returned:

- ``email``, a local part, ``@`` and a domain with a dot;
- ``ip``, four decimal parts of at most 255;
- ``card``, 12 to 19 digits that pass Luhn's check;
- ``phone``, ``+`` and 9 to 15 digits.

More spans are proposed and returned where their score reaches ``MIN_SCORE``:

- ``card``: one blank-separated group of 13 to 19 digits that passes Luhn's check inside a
  longer run of digit groups; needs a context word;
- ``phone``: 10 digits in groups of 3, 3 and 4 without ``+``; needs a context word;
- ``iban``: country letters, check digits and groups that pass mod 97;
- ``ssn``: 3, 2 and 4 digits with hyphens in the ranges issued; needs a context word.

A score starts at the kind's own, gains ``FOUND`` if a word that speaks for the kind
stands near (``BEFORE`` bytes before, ``AFTER`` after), and loses as much for one that
speaks against it. Base spans below the threshold stay, with their low score.

All patterns are ASCII, so texts are searched as UTF-8 bytes and offsets are
turned into code points at the end. Each pattern runs in time linear in the text:
an ``@`` or ``+`` or a run of digits is looked at once, however long its
surroundings. Nothing is shuffled; a text is worked on whole, one at a time."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")  # order of spans that start together
BASE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6}
MORE = {"card": 0.4, "phone": 0.35, "iban": 0.7, "ssn": 0.4}
FOUND = 0.3
MIN_SCORE = 0.6
BEFORE, AFTER = 48, 24

FOR = {
    "email": "email mail e-mail contact correo courriel kontakt",
    "ip": "ip host server address adresse serveur servidor dirección",
    "card": "card credit visa mastercard amex debit carte carta tarjeta kreditkarte karte",
    "phone": "phone tel telephone call fax mobile cell telefon handy téléphone portable teléfono móvil",
    "iban": "iban account konto compte cuenta bank banque banco",
    "ssn": "ssn social security",
}
AGAINST = {"ip": "version release section chapter v", "card": "order isbn serial tracking", "phone": "isbn serial order",
           "ssn": "part serial order"}

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(rb"[0-9][0-9.]++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(rb"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,38}+")
_SSN = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)
_WORD = re.compile(rb"[A-Za-z\x80-\xff][A-Za-z\x80-\xff-]*")
_FOR = {k: frozenset(w.encode() for w in v.split()) for k, v in FOR.items()}
_AGAINST = {k: frozenset(w.encode() for w in v.split()) for k, v in AGAINST.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: bytes) -> bool:
    """The check of an account number: first four characters last, letters as 10 to 35."""
    rest = 0
    for c in code[4:] + code[:4]:
        v = c - 48 if c < 58 else c - 55
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(t: bytes):
    done, at = 0, t.find(b"@")
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            done = m.end()
            yield a, done
        at = t.find(b"@", max(done, at + 1))


def _ips(t: bytes):
    for run in _DOTTED.finditer(t):
        if t.count(b".", run.start(), run.end()) >= 3:
            for m in _IP.finditer(t, run.start(), run.end()):
                if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
                    yield m.span()


def _base(t: bytes):
    """(kind, start, end) of the base spans, and (kind, start, end) of failed runs of digits."""
    out, failed = [("email", *s) for s in _emails(t)], []
    out += [("ip", *s) for s in _ips(t)]
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(None, _NOT_DIGIT)
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
            else:
                failed.append(m.span())
    at = t.find(b"+")
    while at >= 0:
        m = _PHONE.match(t, at)
        if m and 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
            out.append(("phone", *m.span()))
        at = t.find(b"+", m.end() if m else at + 1)
    return out, failed


def _iban_end(t: bytes, a: int, b: int) -> int | None:
    """End of the longest run of whole groups from ``a`` that passes mod 97."""
    ends = [i for i in range(a + 15, b + 1) if i == b or t[i] == 32]
    for e in reversed(ends):
        if e < len(t) and chr(t[e]).isalnum() and t[e] < 128:
            continue
        code = t[a:e].replace(b" ", b"")
        if 15 <= len(code) <= 34 and mod97(code):
            return e
    return None


def _more(t: bytes, failed):
    for a, b in failed:
        start = a
        for group in t[a:b].split(b" "):
            digits = group.replace(b"-", b"")
            if 13 <= len(digits) <= 19 and (len(group) < b - a) and luhn(digits):
                yield "card", start, start + len(group)
            start += len(group) + 1
    for m in _LOCAL_PHONE.finditer(t):
        yield "phone", *m.span()
    for m in _IBAN.finditer(t):
        a = m.start()
        if a and t[a - 1] < 128 and chr(t[a - 1]).isalnum():
            continue
        if e := _iban_end(t, a, m.end()):
            yield "iban", a, e
    for m in _SSN.finditer(t):
        area, group, serial = m[0].split(b"-")
        if area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000":
            yield "ssn", *m.span()


def _context(t: bytes, kind: str, a: int, b: int) -> float:
    """FOUND times (a word for the kind is near) - (a word against it is near)."""
    lo, hi = max(0, a - BEFORE), min(len(t), b + AFTER)
    before = [m[0] for m in _WORD.finditer(t[lo:a].lower()) if m.start() or not _WORD.match(t, max(0, lo - 1), lo)]
    after = [m[0] for m in _WORD.finditer(t[b:hi].lower()) if b + m.end() < hi or not _WORD.match(t, hi)]
    near = {*before, *after}  # whole words only
    return FOUND * (bool(near & _FOR[kind]) - bool(near & _AGAINST.get(kind, frozenset())))


def spans_of(t: bytes) -> list[Span]:
    """Spans of a UTF-8 text in byte offsets, sorted by start, then kind, then end."""
    base, failed = _base(t)
    out = [Span(k, a, b, BASE[k] + _context(t, k, a, b), True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for k, a, b in _more(t, failed):
        i = int(np.searchsorted(starts, b))  # base spans that start before b
        if i and reach[i - 1] > a and k != "iban":
            continue                         # overlaps a base span
        score = MORE[k] + _context(t, k, a, b)
        if score >= MIN_SCORE:
            out.append(Span(k, a, b, score, False))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def code_points(t: bytes, spans: list[Span]) -> list[Span]:
    """The same spans in code points."""
    if not spans or t.isascii():
        return spans
    data, at, last, n = np.frombuffer(t, np.uint8), {}, 0, 0
    for x in sorted({x for s in spans for x in (s.start, s.end)}):
        n += int(np.count_nonzero((data[last:x] & 0xC0) != 0x80))
        at[x], last = n, x
    return [s._replace(start=at[s.start], end=at[s.end]) for s in spans]


def _digest(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _text(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the personal data of every text; a span has kind, start and end
    (code points, end exclusive), score and whether it is a base span.

    Defined cases: a null or empty text has no spans; equal texts have equal spans;
    repeated rows and null ids are returned as they are; an empty table gives no
    rows; a text of any length is searched whole; other columns are not read."""
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [[s._asdict() for s in code_points(t, spans_of(t))] for t in map(_text, part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` with every span of at least ``min_score`` replaced by its kind
    in brackets, for example ``[email]``; overlapping spans become one, named after
    the first. Other columns are unchanged, whatever their names; null texts stay null."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for x in part.column("text"):
                    t, at, kept = _text(x), 0, []
                    for s in spans_of(t):
                        if s.score >= min_score:
                            if s.start >= at:
                                kept += [t[at:s.start], f"[{s.kind}]".encode()]
                            at = max(at, s.end)
                    out.append(b"".join([*kept, t[at:]]).decode() if x.is_valid else None)
                i = part.schema.get_field_index("text")
                yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))
    return docs.mapInArrow(run, docs.schema)


def op11(docs: DataFrame) -> DataFrame:
    """The counts and digests of the spans of :func:`find_pii`, derived in the same pass."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for t in map(_text, batch.column("text")):
                spans = code_points(t, spans_of(t))
                base = [s for s in spans if s.base]
                n = [sum(s.kind == k for s in base) for k in KINDS[:4]]
                rows.append((*n, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
