"""Personal data found by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text, in lower case, in a single
pass: at-signs, URL schemes, pairs of digits and identifier cues ("token",
"password", "iban", ...).  Around each anchor a deterministic local parser takes the
maximal run of characters that its kind allows and validates it:

* ``email``: local part, domain of two labels or more, alphabetic last label; letters
  of the Latin, Greek and Cyrillic scripts;
* ``ip``: four decimal parts of 0 to 255;
* ``ssn``: 3, 2 and 4 digits with hyphens, in the ranges that are issued;
* ``card``: 13 to 19 digits of which the first is 2 to 6, unbroken or in the groups that
  cards print (4-4-4-4 and up to three more, 4-6-4, 4-6-5) with one space or hyphen
  between them, Luhn; in a run of groups every part is tried;
* ``phone``: + or parenthesised area code, 8 to 15 digits in groups; or 3, 3 and 4 digits
  with hyphens or full stops, the first from 2 to 9;
* ``iban``: two letters, check digits, modulus 97, the country's length before any other;
* ``login``: user and password of a URL;
* ``secret``: the value after a credential cue, 8 characters or more with a digit and a
  letter; after a password cue and an assignment it may hold any sign and, in quotes,
  spaces; or a known key prefix;
* ``account``: the number after an account cue, 6 digits or more, ``ACCOUNT_CHARS``
  characters at most.

A long number that fails its checksum is left alone.  Spans that overlap are
joined and carry the kind of the first.  A run of characters is read once for each
kind: what an anchor inside it could still find is known from the first one, so the
cost is linear in the text.

Defined results: a null text stays null and an empty one empty, without spans;
repeated rows are treated each; a null id is carried; an empty table gives no
rows; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .textkernel import tidied

PASSWORD_CUES = ("password", "passwd", "passphrase", "passwort", "contraseña", "pwd")
SECRET_CUES = ("token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "bearer", "authorization", "credential")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "iban", "routing", "customer no", "accountnumber", "account_number", "accountno", "account_no", "acctno", "kontonummer", "konto", "cuenta", "compte")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-")

#: Letters beyond this are of scripts that are written without spaces, and end an address.
_LAST_LETTER = "\u052f"
_DOMAIN_RUN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-\u052f.-]*")
_VALUE_RUN = re.compile(r"[A-Za-z0-9._\-/+=~]*")
_LOGIN_RUN = re.compile(r"[^\s/?#\"'<>@]*")
_NUMBER_RUN = re.compile(r"[0-9 \-.()+]*")
_PASSWORD_RUN = re.compile(r"[^\s\"'<>,;]*")
_QUOTED_RUN = re.compile(r"[^\"'\n]{0,128}")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_NUMBER = frozenset("0123456789 -.()+")
ACCOUNT_CHARS = 40
_DIGITS = frozenset("0123456789")

_IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)", re.A)
_GROUP = re.compile(r"\d+", re.A)
_DIAL = re.compile(r"\+\d|\(\d", re.A)
#: The longest form first: a number may be followed by another after a space.
_PHONES = [re.compile(r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\) ?)\d{1,4}(?:[ .-]?\d{2,4}){%d}(?!\d)" % n, re.A) for n in (4, 3, 2, 1)]
_NATIONAL = re.compile(r"(?<![\d.+-])[2-9]\d\d([.-])\d{3}\1\d{4}(?![\d-])", re.A)
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])", re.A)
_AFTER = re.compile(r"""["']?(?:\s{0,3}(?:no|nr|number|id|code|is)\b\.?)?\s{0,3}[:=#]?\s{0,3}["']?""", re.I | re.A)
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){0,7}(?: ?[A-Z0-9]{1,3})?", re.A)
_ASSIGN = re.compile(r"""["']?\s{0,3}(?:[:=]\s{0,3}|\s)["']?""", re.A)

#: Characters of a country's IBAN.
_IBAN_SIZES = {
    n: frozenset(countries.split())
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}

Span = tuple[int, int, str]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    anchors = {"@": "at", "://": "scheme"}
    anchors |= {f"{a}{b}": "digits" for a in "0123456789" for b in "0123456789"}
    anchors |= {f"{a}.": "digits" for a in "0123456789"}
    for cues, kind in ((SECRET_CUES, "secret"), (PASSWORD_CUES, "password"), (ACCOUNT_CUES, "account")):
        anchors |= {cue: kind for cue in cues}
    anchors |= {p.lower(): "prefix" for p in KEY_PREFIXES}
    for word, kind in anchors.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _lower(text: str) -> str:
    """In lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def _left(text: str, at: int, allowed: frozenset[str]) -> int:
    while at > 0 and text[at - 1] in allowed:
        at -= 1
    return at


def _run(pattern: re.Pattern[str], text: str, at: int) -> int:
    return pattern.match(text, at).end()


def _local(c: str) -> bool:
    return c in ".!_%+-'" or (c.isalnum() and c <= _LAST_LETTER)


def _joined(found: list[Span]) -> list[Span]:
    """Spans in order; those that overlap are one, of the first one's kind."""
    if len(found) < 2:
        return found
    found = sorted(found, key=lambda s: (s[0], -s[1], s[2]))
    out = [found[0]]
    for lo, hi, kind in found[1:]:
        if lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), out[-1][2])
        else:
            out.append((lo, hi, kind))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _email(text: str, at: int) -> list[Span]:
    lo, hi = at, _run(_DOMAIN_RUN, text, at + 1)
    while lo > 0 and _local(text[lo - 1]):
        lo -= 1
    while lo < at and text[lo] in ".!%'-":
        lo += 1
    while hi > at + 1 and text[hi - 1] in ".-":
        hi -= 1
    labels = text[at + 1 : hi].split(".")
    while len(labels) > 2 and not (labels[-1].isalpha() and len(labels[-1]) >= 2):  # what follows the domain without a space
        hi -= len(labels.pop()) + 1
    if lo == at or text[at - 1] == "." or len(labels) < 2 or not all(labels) or not (labels[-1].isalpha() and len(labels[-1]) >= 2):
        return []
    return [(lo, hi, "email")]


def _login(text: str, at: int) -> list[Span]:
    """at: the first character after ://."""
    hi = _run(_LOGIN_RUN, text, at)
    if hi < len(text) and text[hi] == "@" and ":" in text[at:hi]:
        return [(at, hi, "login")]
    return []


def _iban(text: str, lo: int) -> list[Span]:
    """The IBAN that begins at lo; a number or a word in capitals may follow it after a space."""
    m = _IBAN.match(text, lo)
    if not m:
        return []
    fits = []
    for hi in range(lo + 15, m.end() + 1):
        if text[hi - 1] != " " and (hi == len(text) or text[hi] not in _WORD):
            plain = text[lo:hi].replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                fits.append((plain[:2] in _IBAN_SIZES.get(len(plain), ()), hi))
    return [(lo, max(fits)[1], "iban")] if fits else []


def _printed(sizes: list[int]) -> bool:
    """Whether a card's digits are printed in groups of these sizes."""
    if len(sizes) == 1:
        return 13 <= sizes[0] <= 19
    return sizes in ([4, 6, 4], [4, 6, 5]) or (sizes[:4] == [4] * 4 and (len(sizes) == 4 or (len(sizes) == 5 and sizes[4] <= 3)))


def _cards(run: str) -> Iterator[tuple[int, int]]:
    """Every part of a run, from the start of a group of digits to the end of one, that is a card's number."""
    groups = [m.span() for m in _GROUP.finditer(run)]
    for i, (a, b) in enumerate(groups):
        digits, sizes = "", []
        if run[a] not in "23456":
            continue
        for lo, hi in groups[i : i + 5]:
            if sizes and (lo - b != 1 or run[b] not in " -"):
                break
            if hi - lo > 19:
                break
            digits, b = digits + run[lo:hi], hi
            sizes.append(hi - lo)
            if _printed(sizes) and luhn(digits):
                yield a, b


def _numbers(text: str, at: int, end: int) -> tuple[list[Span], int]:
    """Spans in the run of digits and separators around an anchor, and the end of the run."""
    lo, hi = _left(text, at, _NUMBER), _run(_NUMBER_RUN, text, end)
    run, out, taken = text[lo:hi], [], bytearray(hi - lo)

    def apart(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0 and not ((lo + a and text[lo + a - 1] in _WORD) or (lo + b < len(text) and text[lo + b] in _WORD))

    def take(a: int, b: int, kind: str) -> None:
        taken[a:b] = b"\1" * (b - a)
        out.append((lo + a, lo + b, kind))

    def dialled(m: re.Match[str] | None) -> bool:
        return m is not None and 8 <= sum(c in _DIGITS for c in m.group()) <= 15

    for kind, pattern in (("ip", _IP), ("ssn", _SSN)):
        for m in pattern.finditer(run):
            if apart(*m.span()):
                take(*m.span(), kind)
    # of parts that overlap, any may be the card: they go together
    cards = _joined([(a, b, "card") for a, b in _cards(run) if apart(a, b)]) if hi - lo >= 13 else []
    for a, b, kind in cards:
        take(a, b, kind)
    starts = [a for a, _, _ in cards]
    for m in _DIAL.finditer(run):
        fits = [p.span() for p in (p.match(run, m.start()) for p in _PHONES) if dialled(p)]
        free = [x for x in fits if apart(*x)]
        if free:
            take(*free[0], "phone")
        elif fits:
            # a card that begins inside the number, and more than a country code before it
            x, y = fits[-1]
            k = bisect_right(starts, x)
            cut = starts[k] if k < len(starts) and starts[k] < y else 0
            if sum(c in _DIGITS for c in run[x:cut]) > 3:
                take(x, y, "phone")
    for m in _NATIONAL.finditer(run):
        if apart(*m.span()):
            take(*m.span(), "phone")
    return out, hi


def _is_secret(value: str) -> bool:
    return len(value) >= 8 and any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)


class _Values:
    """Values after cues.  Of a run that held no value, a later part with the same end holds none either, so it is not read again."""

    def __init__(self, text: str):
        self.text, self.barren = text, {"secret": 0, "password": 0}

    def after(self, at: int, kind: str) -> list[Span]:
        """The value after a cue that ends at at."""
        text = self.text
        if at < len(text) and text[at] in _WORD:
            return []
        m = (_AFTER if kind == "account" else _ASSIGN).match(text, at)
        lo = m.end() if m else at
        if lo == at:
            return []
        if kind == "account":
            hi = _VALUE_RUN.match(text, lo, lo + ACCOUNT_CHARS + 1).end()
            value = text[lo:hi].rstrip(".-/=")
            digits = sum(c in _DIGITS for c in value)
            return [(lo, lo + len(value), kind)] if digits >= 6 and 2 * digits >= len(value) and len(value) <= ACCOUNT_CHARS else []
        if kind == "password" and any(c in ":=" for c in m.group()):
            if m.group()[-1] in "\"'":
                hi = _run(_QUOTED_RUN, text, lo)
                if text[hi : hi + 1] == m.group()[-1]:
                    return [(lo, hi, "secret")] if _is_secret(text[lo:hi]) else []
            return self._value(lo, "password", _PASSWORD_RUN)
        return self._value(lo, "secret", _VALUE_RUN)

    def _value(self, lo: int, kind: str, pattern: re.Pattern[str]) -> list[Span]:
        if lo < self.barren[kind]:
            return []
        end = _run(pattern, self.text, lo)
        value = self.text[lo:end].rstrip(".-/=" if kind == "secret" else ".)]}")
        if _is_secret(value):
            return [(lo, lo + len(value), "secret")]
        self.barren[kind] = end
        return []

    def prefixed(self, at: int, end: int) -> list[Span]:
        """The key with a known prefix from at to end."""
        text = self.text
        if text[at:end] not in KEY_PREFIXES or (at and text[at - 1] in _WORD):
            return []
        hi = _run(_VALUE_RUN, text, end)
        return [(at, hi, "secret")] if hi - end >= 16 else []


def spans(text: str) -> list[Span]:
    """(start, end, kind) of the personal data of a text, in order and apart."""
    found: list[Span] = []
    values, numbers_end, value_end = _Values(text), 0, 0
    for last, (kind, n) in automaton().iter(_lower(text)):
        at, end = last - n + 1, last + 1
        if kind == "at":
            found += _email(text, at)
        elif kind == "scheme":
            found += _login(text, end)
        elif kind == "digits":
            if at >= numbers_end:
                new, numbers_end = _numbers(text, at, end)
                found += new
                if at >= 2 and text[at - 2 : at].isupper() and text[at - 2 : at].isascii() and (at == 2 or text[at - 3] not in _WORD):
                    found += _iban(text, at - 2)
        elif end > value_end:
            new = values.prefixed(at, end) if kind == "prefix" else values.after(end, kind)
            found += new
            value_end = max([value_end, *(s[1] for s in new)])
    return _joined(found)


def masked(text: str, where: list[Span]) -> str:
    parts, at = [], 0
    for lo, hi, kind in where:
        parts += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*parts, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


#: Rows that are text objects at a time.
_ROWS = 256


def _process(column: pa.Array) -> tuple[pa.Array, list[list[Span]]]:
    """The masked texts and the spans of each."""
    out, where = [], []
    for at in range(0, len(column), _ROWS):
        texts = column.slice(at, _ROWS).to_pylist()
        found = [spans(t) if t else [] for t in texts]
        out.append(pa.array([masked(t, w) if w else t for t, w in zip(texts, found, strict=True)], column.type))
        where += found
    return pa.concat_arrays(out) if out else column, where


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the redacted text, and the spans (kind, start, stop in characters) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            texts, where = _process(batch.column(1))
            rows = [[{"kind": k, "start": a, "stop": b} for a, b, k in w] for w in where]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(rows, _SPANS)], names=["doc_id", "text", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, text string, spans array<struct<kind: string, start: long, stop: long>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data replaced by its kind in ``text`` (and ``n_chars`` brought up to date)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            names = batch.schema.names
            texts, _ = _process(batch.column(names.index("text")))
            new = {"text": texts}
            if "n_chars" in names:
                new["n_chars"] = pc.utf8_length(texts).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], schema=batch.schema)
            del batch, texts, new

    return docs.mapInArrow(work, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
