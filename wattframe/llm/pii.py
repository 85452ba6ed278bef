"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

A finder proposes every e-mail address, IP address, card number and phone number of a text and
drops those that fail their check (parts up to 255, Luhn, number of digits).  Beyond these:
international bank account numbers by mod-97, and two kinds that a number alone does not
prove, shorter card numbers and social security numbers.

Every span has a score: its kind's prior, moved by the words around it, some of which speak for the
kind and some against it, in four languages.  The kinds beyond the base count only if their score reaches
the threshold; base spans stay whatever it is, and show it.

Null and empty texts have no spans.  Texts of any length are read whole; work grows with the length and, for
overlaps, with the logarithm of the number of spans.  Of two proposals beyond the base that overlap, the earlier
by kind and place counts; none overlaps a base span.  Each row stands for itself, so equal rows give equal
results and an empty table gives none.  Other columns are ignored by ``detect`` and passed on by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wattframe.llm.common import small

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn")
KINDS = BASE + ADDED

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

#: Score without context, and the score that a span beyond the base needs.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "short_card": 0.4, "ssn": 0.4}
THRESHOLD = 0.6
#: Words looked at on either side.
REACH = 8
#: What a word there adds, by kind: words that speak for it (English, German, French, Spanish) or against it.
_FOR = {
    "email": "email mail contact write kontakt schreiben courriel contacter correo contacto",
    "ip": "ip address server host client adresse serveur rechner dirección servidor",
    "card": "card credit visa mastercard amex karte kreditkarte carte crédit bancaire tarjeta crédito",
    "phone": "phone call tel telephone mobile telefon anrufen handy téléphone appelez portable teléfono llame móvil",
    "iban": "iban account bank transfer konto bankverbindung überweisung compte virement cuenta banco",
    "ssn": "ssn social security taxpayer sozialversicherung steuernummer sécurité sociale seguridad contribuyente",
}
_AGAINST = {
    "ip": "version release build versión ausgabe",
    "card": "order serial part tracking bestellnummer seriennummer commande série pedido serie",
    "ssn": "order serial part tracking bestellnummer seriennummer commande série pedido serie",
}
_FOR["short_card"], _AGAINST["short_card"] = _FOR["card"], _AGAINST["card"]
CONTEXT = {
    kind: {**dict.fromkeys(_FOR[kind].split(), 0.3), **dict.fromkeys(_AGAINST.get(kind, "").split(), -0.3)} for kind in _FOR
}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run before it, the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL_END.match(text, start - 1, start):
            start -= 1
        end = start < at and _DOMAIN.match(text, at + 1)
        if end:
            last = end.end()
            yield start, last
        elif at >= last:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def _beside(text: str, start: int, end: int) -> set[str]:
    """The words next to a span, as many on either side as the reach; no more text is read than they take."""
    out: list[str] = []
    for step in (-1, 1):
        size, found = 16 * REACH, []
        while True:
            # a word cut by the edge of the stretch does not count unless the text ends there
            part = text[max(0, start - size) : start] if step < 0 else text[end : end + size]
            whole = size >= (start if step < 0 else len(text) - end)
            found = _WORD.findall(part)
            if not whole and found:
                found = found[1:] if step < 0 else found[:-1]
            if whole or len(found) >= REACH:
                break
            size *= 4
        out += found[-REACH:] if step < 0 else found[:REACH]
    return {w.lower() for w in out}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the kind, moved by the words around, from 0 to 1."""
    weights = CONTEXT[kind]
    moved = PRIOR[kind] + sum(weights.get(w, 0.0) for w in sorted(_beside(text, start, end)))
    return min(1.0, max(0.0, moved))


class Taken:
    """Stretches of text that are taken; none of them empty."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):  # overlapping ones become one
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Takes a stretch unless it overlaps one; says whether it did."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind and start."""
    text = text or ""
    base: list[tuple[str, int, int]] = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            base.append(("ip", m.start(), m.end()))
    short = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            if len(digits) >= 16:
                base.append(("card", m.start(), m.end()))
            elif len(set(digits)) > 1:
                short.append(("short_card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                base.append(("phone", m.start(), m.end()))
    proposed = [("iban", s, e) for s, e in ibans(text)] + short
    if "-" in text:
        proposed += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    taken = Taken([(s, e) for _, s, e in base])
    spans = [(kind, s, e, score(text, kind, s, e)) for kind, s, e in base]
    for kind, s, e in proposed:
        worth = score(text, kind, s, e)
        if worth >= THRESHOLD and taken.add(s, e):
            spans.append((kind, s, e, worth))
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers with a right check sum; a run is cut back to the longest right one."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            if text[end - 1] != " " and (end == m.end() or text[end] == " "):
                account = text[m.start() : end].replace(" ", "")
                if 15 <= len(account) <= 34 and mod97(account):
                    yield m.start(), end
                    break
            end -= 1


def describe(spans: list[tuple[str, int, int, float]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in kinds)


def mask(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    if not spans or text is None:
        return text
    out, last = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, and their scores in that order."""
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, scores string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(describe(x, BASE).encode()).hexdigest() for x in found]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                *counts,
                pa.array(digests, pa.string()),
                pa.array([describe(x) for x in found], pa.string()),
                pa.array([",".join(f"{s[3]:.2f}" for s in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores"]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            found = [find(t) for t in texts]
            masked = [mask(t, s) for t, s in zip(texts, found)]
            new = {"text": masked}
            if "n_chars" in batch.schema.names:
                kept = batch.column("n_chars").to_pylist()
                new["n_chars"] = [len(t) if s else n for t, s, n in zip(masked, found, kept)]
            columns = [
                pa.array(new[f.name], f.type) if f.name in new else batch.column(i)
                for i, f in enumerate(batch.schema)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
