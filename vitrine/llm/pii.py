"""Personal data: regular expressions propose, checksums confirm, nearby words adjust.

A span is (kind, start, end, score) in code points, end exclusive.  The four base kinds
are fixed patterns, leftmost and without overlap per kind, and stay whatever their
score; a match that fails its check is dropped and not tried again:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card   ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn
* phone  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Further kinds are proposed with a score that their check and the words around them
raise or lower; they are spans when it reaches ``THRESHOLD`` and no base span overlaps:
iban (country's length, mod-97), national_id (3-2-4 digits of the issued ranges),
local_phone (without the plus), ipv6, masked_email ("name (at) host (dot) org") and
birth_date (a date of the calendar).

The patterns are written so that time grows with the length of a text, whatever it
holds: runs are matched once and never again from their middle.

Defined cases: a null or empty text has no spans; every row is answered alone, so
repeated rows and null ids get their own answers; an empty table gives no rows; a text
is read whole, however long; other columns are never read.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban", "national_id", "local_phone", "ipv6", "masked_email", "birth_date")
THRESHOLD = 0.6
#: Words this near (code points before and after) speak for or against a candidate.
BEFORE, AFTER = 48, 24
#: Score of a candidate that passed its check, without its context.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4, "local_phone": 0.3,
         "ipv6": 0.7, "masked_email": 0.6, "birth_date": 0.2}
RAISE, LOWER = 0.4, 0.3
#: Words that speak for a kind, in the four languages of the corpus and more (fixed values).
FOR = {
    "email": "e-mail email mail contact correo courriel kontakt",
    "ip": "ip address host server client adresse dirección",
    "card": "card visa mastercard amex credit debit karte kreditkarte tarjeta carte payment",
    "phone": "phone tel telephone mobile cell call fax whatsapp telefon handy anruf teléfono móvil llamar téléphone portable appeler",
    "iban": "iban bank account konto cuenta banque compte transfer",
    "national_id": "ssn social security taxpayer tin",
    "local_phone": "phone tel telephone mobile cell call fax whatsapp telefon handy anruf teléfono móvil llamar téléphone portable appeler",
    "ipv6": "ip ipv6 address host server client",
    "masked_email": "e-mail email mail contact correo courriel kontakt write",
    "birth_date": "born birth birthday dob geboren geburtstag nacido nacida nacimiento né née naissance",
}
#: Words that speak against any kind.
AGAINST = frozenset("version release isbn issn order invoice serial model build sku example test".split())
_FOR = {kind: frozenset(names.split()) for kind, names in FOR.items()}
#: Length of an IBAN by country (fixed values of the public registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Every ip, card, date and number lies inside one longest run of these characters.
_NUMERIC = re.compile(r"[0-9][0-9. -]{6,}+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DATE = re.compile(r"(?<![0-9.-])(?:([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})|([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9]{4}))(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9.+-])0?[0-9]{2,5}(?:[ .-][0-9]{2,8}){1,4}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]{0,39}:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_AT = re.compile(r"[ \t]?[\[(][ \t]?(?:at|AT)[ \t]?[\])][ \t]?([A-Za-z0-9-]{1,63})((?:[ \t]?(?:\.|[\[(][ \t]?(?:dot|DOT)[ \t]?[\])])[ \t]?[A-Za-z0-9-]{1,63}){1,8})")
_WORD = re.compile(r"[^\W\d_](?:[\w-]*[^\W_])?")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country's length, and the number that its letters and digits spell is 1 modulo 97."""
    if IBAN_LENGTH.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One match holds one "@"; its name is the longest run before it that no earlier match has used."""
    used = 0
    for m in _DOMAIN.finditer(text):
        name = text[used:m.start()]
        size = len(name) - len(name.rstrip(_LOCAL))
        if size:
            yield m.start() - size, m.end()
            used = m.end()
        else:
            used = max(used, m.start())  # nothing before this "@" belongs to a later name


def _ip_ok(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for run in _NUMERIC.finditer(text):
        own = run.group()
        if own.count(".") >= 3:
            out += [(run.start() + m.start(), 1, run.start() + m.end()) for m in _IP.finditer(own) if _ip_ok(m.group())]
        if len(own) >= 12:
            for m in _CARD.finditer(own):
                if m.end() - m.start() >= 12 and 12 <= len(digits := _only_digits(m.group())) <= 19 and luhn(digits):
                    out.append((run.start() + m.start(), 2, run.start() + m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return sorted(out)


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words around a candidate add to its score."""
    around = _WORD.findall(text[max(0, start - BEFORE):start].lower()) + _WORD.findall(text[end:end + AFTER].lower())
    near = set(around)
    return RAISE * bool(near & _FOR[kind]) - LOWER * bool(near & AGAINST)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates of the further kinds that pass their checks."""
    for m in _IBAN.finditer(text):
        size, end = IBAN_LENGTH.get(m.group()[:2]), 0
        if size:
            seen = 0
            for end, c in enumerate(m.group(), 1):
                seen += c != " "
                if seen == size:
                    break
            found = m.group()[:end].replace(" ", "")
            follows = text[m.start() + end:m.start() + end + 1]
            if mod97(found) and not (follows.isascii() and follows.isalnum()):
                yield "iban", m.start(), m.start() + end
    for run in _NUMERIC.finditer(text):
        own, at = run.group(), run.start()
        for m in _NATIONAL.finditer(own):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield "national_id", at + m.start(), at + m.end()
        for m in _DATE.finditer(own):
            year, month, day = (m[1], m[2], m[3]) if m[1] else (m[6], m[5], m[4])
            try:
                date(int(year), int(month), int(day))
            except ValueError:
                continue
            yield "birth_date", at + m.start(), at + m.end()
        for m in _LOCAL_PHONE.finditer(own):
            if 7 <= len(_only_digits(m.group())) <= 12:
                yield "local_phone", at + m.start(), at + m.end()
    if "::" in text or text.count(":") > 6:
        for m in _IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            if sum(c not in ":" for c in m.group()) >= 4:
                yield "ipv6", m.start(), m.end()
    if "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            name = text[max(0, m.start() - 64):m.start()]
            size = len(name) - len(name.rstrip(_LOCAL))
            if size:
                yield "masked_email", m.start() - size, m.end()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by start, then kind as listed."""
    base = base_spans(text)
    out = [(start, k, end, START[KINDS[k]] + context(text, KINDS[k], start, end)) for start, k, end in base]
    used: list[list[int]] = []  # the base spans' union, in order and disjoint
    for start, _, end in base:
        if used and start <= used[-1][1]:
            used[-1][1] = max(used[-1][1], end)
        else:
            used.append([start, end])
    added: list[tuple[int, int, int, float]] = []
    for kind, start, end in _proposed(text):
        near = bisect_left(used, [end])
        if near and used[near - 1][1] > start:
            continue
        score = START[kind] + context(text, kind, start, end)
        if score >= THRESHOLD - 1e-9:
            added.append((start, KINDS.index(kind), end, score))
    kept: list[tuple[int, int, int, float]] = []
    for one in sorted(added):  # of two that overlap the better one stays, of equal ones the first
        if kept and one[0] < kept[-1][2]:
            if one[3] > kept[-1][3]:
                kept[-1] = one
        else:
            kept.append(one)
    out += kept
    return [(KINDS[k], start, end, min(1.0, max(0.0, score))) for start, k, end, score in sorted(out)]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "score")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a text at a time: the batch's strings are not all turned into Python's at once
            spans = [[dict(zip(names, s)) for s in find(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged but the text, in which each span is replaced by its kind in brackets."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, start, end, _ in find(text):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(text_col)], batch.column(text_col).type)
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, texts)

    return docs.mapInArrow(scan, docs.schema)


def listed(spans):
    """"kind:start:end" of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
