"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card and phone, found leftmost and non-overlapping, each kind by itself; a proposal that its
check refuses is dropped, with no second try inside it. They always stand; the score only ranks them. Added kinds stand
if their score reaches the threshold, so for each of them the words nearby decide:

    iban    country, two check digits, 11 to 30 more, of the country's length where that is known, else up to the last end of
            a word where mod-97 is 1; mod-97 must be 1; words that follow after a space are not part of it. Stands by itself,
            but not beside a word like "example"
    ssn     ddd-dd-dddd of an issuable number; only with a context word
    cpf     ddd.ddd.ddd-dd whose two check digits (mod 11) are right; only with a context word
    dni     eight digits and the letter that they give mod 23; only with a context word
    secret  a key of a known make or a private key's head: by itself; a long string of hex digits or mixed characters that
            varies enough (Shannon entropy): only with a context word, such as "token", or assigned to such a name

Offsets are code points, ends exclusive. Defined cases: null text is empty text and gives no spans, and redacted() leaves it
null. One row comes out for each that goes in, repeated rows among them; an empty table gives none. Texts are searched whole,
in runs of bounded size, one text at least. Columns but doc_id and text are ignored by find_spans() and kept by redacted().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "cpf", "dni", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_GOES_ON = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CPF = re.compile(r"(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])")
_DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
#: The letters of a DNI by its number mod 23, and the shapes of keys of known makes.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_MADE = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_STRING = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,512}(?![A-Za-z0-9+/_-])")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|credentials?|auth)[\"']?\s{0,4}[:=]\s{0,4}[\"']?$")
LEAST_ENTROPY = 3.0

#: Characters of an IBAN by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
#: A kind's score before its context, words that raise it and words that lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "cpf": 0.5, "dni": 0.4, "secret": 0.4, "made": 0.8, "assigned": 0.6}
FOR = {
    "email": {"mail", "email", "contact", "write", "address"}, "ip": {"ip", "address", "host", "server", "client", "login"}, "card": {"card", "credit", "visa", "mastercard", "payment", "pay"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "whatsapp"}, "iban": {"iban", "account", "bank", "transfer"}, "ssn": {"ssn", "social", "security", "taxpayer"},
    "cpf": {"cpf", "cadastro", "contribuinte", "receita"}, "dni": {"dni", "nif", "documento", "identidad"}, "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "credential", "credentials", "bearer", "auth"},
}
AGAINST = {"example", "sample", "dummy", "test", "version", "order", "sku", "isbn", "serial"}
AGAINST_KIND = {"secret": {"commit", "sha", "hash", "checksum", "digest", "md", "uuid", "etag"}}
SECRETS = ("secret", "made", "assigned")
NEARBY, STEP, THRESHOLD = 40, 0.3, 0.6
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def cpf(digits: str) -> bool:
    rest = [sum(int(c) * (n + 1 - k) for k, c in enumerate(digits[:n])) * 10 % 11 % 10 for n in (9, 10)]
    return rest == [int(digits[9]), int(digits[10])] and len(set(digits)) > 1


def entropy(text: str) -> float:
    """Bits a character, from the text's own characters."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _varied(text: str) -> bool:
    """Whether a long string looks drawn at random: digits and letters, all of them hex digits or of both cases, and varying."""
    mixed = re.search("[0-9]", text) and re.search("[A-Za-z]", text) and (re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) or (re.search("[a-z]", text) and re.search("[A-Z]", text)))
    return bool(mixed) and entropy(text) >= LEAST_ENTROPY


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each "@" outwards, which takes time linear in the text where a search from every start would not
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _iban_end(text: str, start: int, after: int) -> int | None:
    """Where the IBAN whose country and check digits are text[start:after] ends: at its country's length, else at the last end of a word that passes mod-97."""
    rest = _IBAN_REST.match(text, after)
    if not rest:
        return None
    length, size = IBAN_LENGTH.get(text[start : start + 2]), 4
    ends = []
    for k in range(after, rest.end()):
        size += text[k] != " "
        if text[k] != " " and (size == length if length else size >= 15) and not _GOES_ON.match(text, k + 1):
            ends.append(k + 1)
    return next((e for e in reversed(ends) if mod97(text[start:e].replace(" ", ""))), None)


def _proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of all that patterns propose and checks confirm."""
    if "@" in text:
        for s, e in _emails(text):
            yield s, e, "email"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.start(), m.end(), "phone"
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() >= free and (end := _iban_end(text, m.start(), m.end())):
            yield m.start(), end, "iban"
            free = end
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn"
    for m in _CPF.finditer(text):
        if cpf(re.sub("[.-]", "", m[0])):
            yield m.start(), m.end(), "cpf"
    for m in _DNI.finditer(text):
        if DNI_LETTERS[int(m[0][:8]) % 23] == m[0][-1]:
            yield m.start(), m.end(), "dni"
    for m in _MADE.finditer(text):
        yield m.start(), m.end(), "made"
    for m in _STRING.finditer(text):
        if _varied(m[0]) and not _MADE.match(text, m.start()):
            yield m.start(), m.end(), "assigned" if _ASSIGNED.search(text[max(0, m.start() - 32) : m.start()]) else "secret"


def score(text: str, start: int, end: int, kind: str) -> float:
    """What the kind is worth before its context, more with a word nearby that speaks for it, less with one against. Secrets of known make are of kind "made", those given to a name "assigned"."""
    words, of = set(_WORD.findall(f"{text[max(0, start - NEARBY) : start]} {text[end : end + NEARBY]}".lower())), "secret" if kind in SECRETS else kind
    against = words & AGAINST or words & AGAINST_KIND.get(kind, set())
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * bool(words & FOR[of]) - STEP * bool(against))), 3)


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span that stands, by start, then kind."""
    if not text:
        return []
    out = [("secret" if k in SECRETS else k, s, e, score(text, s, e, k)) for s, e, k in _proposals(text)]
    return sorted((x for x in out if x[0] in BASE_KINDS or x[3] >= threshold), key=lambda x: (x[1], ORDER[x[0]]))


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """text with each span, or run of overlapping spans, replaced by <KIND> of its first."""
    spans = find(text, threshold)
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>> of every row of docs (doc_id, text); other columns are left."""

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in _shared.slices(b.column(1)):
                found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t, threshold)] for t in b.column(1).slice(at, n).to_pylist()]
                yield pa.record_batch({"doc_id": b.column(0).slice(at, n), "spans": pa.array(found, SPANS)})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _shared.text_or_empty(docs).alias("text"))
    return _shared.arrow(rows, spans, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs, the same rows and columns, with spans in `text` replaced by <KIND>; null text stays null."""
    place = [c.lower() for c in docs.columns].index("text")

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in _shared.slices(b.column(place)):
                part = b.slice(at, n)
                texts = pa.array([redact(t, threshold) for t in part.column(place).to_pylist()], b.schema.field(place).type)
                yield part.set_column(place, b.schema.field(place), texts)

    return _shared.arrow(docs, mask, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and of all, base_sha256, spans as text and their scores likewise, of what find_spans returns."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 1)), ",").alias("scores"))


