"""Personal data (operator 5).

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, octets for addresses,
digit counts for phones and US social security numbers), and words near a span move its score up or down. The four
base kinds follow their contract to the letter: leftmost non-overlapping matches of one pattern a kind, failing
matches dropped, no retries; context only scores them. The added kinds (iban, ssn, mac) need their validator and a
score of at least KEEP; an IBAN ends where its country's length says, whatever words follow it.

Every search is linear in the text: an e-mail is built from its @ outwards, and no digit run is entered in its middle.

Defined results: a null or empty text has no spans, counts 0 and the hash of no bytes; positions are code points, end
exclusive; repeated rows are searched each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm._batches import slices, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "mac")
KEEP = 0.5
#: Characters on either side of a span that are searched for context.
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
#: Characters of an account number by country, as the public registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])")

#: kind: score without context, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.9, ("mail", "contact", "write"), ("example",)),
    "ip": (0.6, ("ip", "address", "host", "server", "login"), ("version", "release", "section")),
    "card": (0.8, ("card", "visa", "mastercard", "credit", "payment", "cvv"), ("order", "invoice", "isbn", "serial")),
    "phone": (0.7, ("phone", "tel", "call", "mobile", "fax", "whatsapp", "contact"), ("isbn", "serial")),
    "iban": (0.8, ("iban", "bank", "account", "konto", "cuenta", "compte"), ("serial", "model")),
    "ssn": (0.4, ("ssn", "social", "security", "tax"), ("part", "order", "serial")),
    "mac": (0.6, ("mac", "ethernet", "wifi", "device"), ("example",)),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; a match's local part is what stands before its @, after the match before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        done = tail.end() if tail else at + 1
        if tail:
            out.append((start, done))
        at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


@lru_cache(maxsize=None)
def _iban_rest(n: int) -> re.Pattern:
    """What follows country and check digits up to the country's length: groups of four, each perhaps behind a blank."""
    whole, rest = divmod(n - 4, 4)
    last = rf"(?:\x20?[A-Z0-9]{{{rest}}})" if rest else ""
    return re.compile(rf"(?:\x20?[A-Z0-9]{{4}}){{{whole}}}{last}(?![A-Za-z0-9])")


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[1])
        own = _iban_rest(n).match(text, m.end()) if n and m.start() >= done else None
        if own and mod97((m[0] + own[0]).replace(" ", "")):
            done = own.end()
            yield "iban", m.start(), done
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", m.start(), m.end()
    if ":" in text:
        for m in _MAC.finditer(text):
            yield "mac", m.start(), m.end()


_WORD = re.compile(r"[a-z]+")
#: Every kind has a digit or an @, or is a MAC address.
_ANY = re.compile(r"[0-9@]|[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:")


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, moved by the words near the span; between 0 and 1."""
    prior, up, down = CONTEXT[kind]
    near = set(_WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(_WORD.findall(text[end : end + NEAR].lower()))
    moved = prior + 0.3 * (not near.isdisjoint(up)) - 0.3 * (not near.isdisjoint(down))
    return round(min(1.0, max(0.0, moved)), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed in BASE and ADDED, then start."""
    if not _ANY.search(text):
        return []
    base = [(k, s, e, score(text, k, s, e)) for k, s, e in _base(text)]
    return base + [(k, s, e, p) for k, s, e in _added(text) if (p := score(text, k, s, e)) >= KEEP]


def _listed(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [find_spans(t) for t in texts(part)]
                base = [[x for x in f if x[0] in BASE] for f in found]
                out = {"doc_id": part.column("doc_id")}
                for kind in BASE:
                    out[f"n_{kind}"] = pa.array([sum(x[0] == kind for x in b) for b in base], pa.int64())
                out["base_sha256"] = pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string())
                out["spans"] = pa.array(map(_listed, found), pa.string())
                out["scores"] = pa.array([",".join(f"{x[3]:.2f}" for x in f) for f in found], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string")


def redact_text(text: str) -> str:
    """Each span, or run of spans that overlap, becomes the kind of its first span in brackets."""
    out, done, last = [], 0, -1
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in find_spans(text)):
        if start >= last:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = last = max(end, last)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The same columns and rows, with personal data in text replaced and n_chars, where there is one, counted again."""
    names, sized = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                given = part.column("text").to_pylist()
                clean = [t and redact_text(t) for t in given]
                columns = {n: part.column(n) for n in names}
                columns["text"] = pa.array(clean, part.schema.field("text").type)
                if sized:
                    kept = part.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, given, clean, strict=True)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
