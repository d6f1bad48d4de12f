r"""Personal data by anchor expansion (operator 9).

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, plus signs, digits,
schemes and identifier cues. At each anchor a deterministic local parser expands to the boundaries of
what may stand there and validates it; nothing else of the text is looked at twice.

Kinds, in order: email, ip, card, phone (the base kinds, found leftmost and without overlap within a
kind; a candidate that fails its check is dropped and what it covers is not tried again), then those
that need a cue: account (IBAN by its check digits, or a number after an account cue), ssn, login
(user and password before the host of an address) and secret (passwords and access keys that are
assigned; a value ends at a blank, quote, comma or semicolon, and cues within a value announce nothing more).
Spans are in code points, end exclusive.

The time is linear in the text: a value, number or address that was parsed is not parsed again from a place within it, and
all other parsers look at a bounded number of characters.

Defined cases: a null text has no spans; equal rows get equal spans; an empty table gives an empty
table; long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "ssn", "login", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[\x20:#=.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no|nr|nº)\.?)?[\x20:#=.]{1,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.IGNORECASE)
_SSN = re.compile(r"[^0-9\n]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
_ASSIGNED = re.compile(r"[\x22']?\x20?[=:]\x20?[\x22']?([^\s\x22',;]{6,})")
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")

#: Cues by what they announce; each also in upper case and with a capital.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "login": ("://",),
    "secret": ("password", "passwd", "pwd", "api_key", "apikey", "secret_key", "access_token", "auth_token", "token"),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("AKIA", ("key", 4))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


class Finder:
    """spans(text) -> {kind: [(start, end), ...]}, each list by start."""

    def __init__(self):
        self.automaton = automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {}
        email_end = card_end = phone_end = digits_end = ip_end = secret_end = kept_end = 0
        add = lambda kind, start, end: found.setdefault(kind, []).append((start, end))
        for last, (what, width) in self.automaton.iter(text):
            at = last - width + 1
            if what == "digit":
                if at >= card_end:
                    m = _CARD.match(text, at)
                    card_end = m.end() if m else at + 1
                    if m:
                        digits = "".join(c for c in m[0] if c not in " -")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            add("card", at, card_end)
                if at >= digits_end and at >= ip_end:
                    digits_end = _DIGITS.match(text, at).end()
                    if text[digits_end : digits_end + 1] == "." and (m := _IP.match(text, at)):
                        ip_end = m.end()
                        parts = [p.lstrip("0") for p in m[0].split(".")]
                        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                            add("ip", at, ip_end)
            elif what == "at":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    email_end = m.end()
                    add("email", start, email_end)
            elif what == "plus":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                        add("phone", at, phone_end)
            elif what == "key":
                if at >= kept_end and (m := _ACCESS_KEY.match(text, at)):
                    kept_end = m.end()
                    add("secret", at, kept_end)
            elif what == "secret":
                # what a value covers is not looked at again, valid or not: each character is in one value at most
                if at >= secret_end and (m := _ASSIGNED.match(text, last + 1)):
                    secret_end = m.end()
                    if any(c.isdigit() for c in m[1]):
                        kept_end = secret_end
                        add("secret", m.start(1), secret_end)
            else:
                self._cue(text, what, at, last + 1, found, add)
        return {k: sorted(set(v)) for k, v in found.items()}

    @staticmethod
    def _cue(text: str, what: str, at: int, after: int, found: dict, add) -> None:
        if what == "iban":
            if m := _IBAN.match(text, after):
                packed, ends = [], []
                for k in range(m.start(1), m.end(1)):
                    if text[k] != " ":
                        packed.append(text[k])
                        ends.append(k + 1)
                for n in range(len(packed), 14, -1):  # a following word in capitals may have been taken in
                    if iban_valid("".join(packed[:n])):
                        add("account", m.start(1), ends[n - 1])
                        break
        elif what == "account":
            if m := _ACCOUNT.match(text, after):
                add("account", *m.span(1))
        elif what == "ssn":
            if m := _SSN.match(text, after):
                add("ssn", *m.span(1))
        elif what == "login":
            if m := _LOGIN.match(text, after):
                add("login", *m.span(1))


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ()))


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    flat = sorted((a, -b, KINDS.index(k)) for k, v in spans.items() for a, b in v)
    out, at, i = [], 0, 0
    while i < len(flat):
        a, b, kind = flat[i][0], -flat[i][1], flat[i][2]
        i += 1
        while i < len(flat) and flat[i][0] < b:
            b = max(b, -flat[i][1])
            i += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs (or its columns `keep`) with pii_spans and pii_base (listed spans) and counts of the base kinds."""
    keep = docs.columns if keep is None else keep
    names = {n: fresh(docs, n) for n in (*(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans")}
    kinds = [T.LongType()] * len(BASE_KINDS) + [T.StringType()] * 2
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, k, False) for n, k in zip(names.values(), kinds, strict=True))])
    at, positions = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder()
        for batch in batches:
            rows = []
            for value in batch.column(at):
                spans = finder.spans(value.as_py() or "")
                rows.append((*(len(spans.get(k, ())) for k in BASE_KINDS), listed(spans, BASE_KINDS), listed(spans, KINDS)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            arrays = [batch.column(p) for p in positions]
            arrays += [pa.array(c, pa.int64() if i < len(BASE_KINDS) else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema), names


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; all other columns and untouched texts stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder()
        for batch in batches:
            out = []
            for value in batch.column(at):
                value = value.as_py()
                spans = finder.spans(value) if value else None
                out.append(masked(value, spans) if spans else value)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    found, names = find_pii(docs.select("doc_id", "text"), keep=["doc_id"])
    counts = [F.col(names[f"n_{k}"]).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col(names["base_spans"]), 256).alias("base_sha256"), F.col(names["spans"]).alias("spans"))
