"""Format-preserving Feistel pseudonyms for personal data.

A found value is validated, mapped to an integer below the size of its format, permuted by a keyed Feistel network
with cycle walking, and written back in the same format.  The permutation is a bijection per kind and key, so
equal values get equal pseudonyms in every document, different values stay different, and ``Feistel.back``
restores them for whoever holds the key.

Kinds: payment cards (13 to 19 digits with a right Luhn sum; the first digit, the length and a right sum are kept),
US social security numbers, phone numbers with a country code or a bracketed area code (country code kept), IPv4
addresses, IBANs (country, layout and a right checksum kept), dates (ISO, with or without a time behind a T, or day and month
with a year; valid and stays valid), and e-mail addresses (letters and digits of the local part, each within its class; the domain
is kept).  Other numbers are left alone: those without separators or a check digit can't be validated.

A row's text is all that is needed, so there is no shuffle.

Defined results: a null text stays null and counts nothing; a text without findings is returned unchanged; null ids and
repeated rows are treated row by row; very long texts are searched whole; columns that clash with added ones are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright import workers

KINDS = ("card", "ssn", "phone", "ip", "iban", "date", "email")
ROUNDS = 10
#: Rows whose texts are held as Python objects at a time.
SLICE_ROWS = 1024
#: Dates are permuted within these years, both included.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1


def whole_key(key: bytes) -> bytes:
    """The key, or its SHA-512 digest where it is longer than the hash takes: all of it counts."""
    return key if len(key) <= hashlib.blake2b.MAX_KEY_SIZE else hashlib.sha512(key).digest()


class Feistel:
    """A keyed permutation of ``range(size)``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        if size < 1:
            raise ValueError("size must be positive")
        self.size = size
        self.base = 1
        while self.base * self.base < size:
            self.base += 1 if self.base < 64 else self.base // 8
        self.key = hashlib.blake2b(f"{tweak}:{size}".encode(), key=whole_key(key), digest_size=32).digest()

    def _round(self, i: int, value: int) -> int:
        data = i.to_bytes(1, "big") + value.to_bytes(32, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big") % self.base

    def _once(self, value: int) -> int:
        a, b = divmod(value, self.base)
        for i in range(ROUNDS):
            a, b = b, (a + self._round(i, b)) % self.base
        return a * self.base + b

    def _undo(self, value: int) -> int:
        a, b = divmod(value, self.base)
        for i in reversed(range(ROUNDS)):
            a, b = (b - self._round(i, a)) % self.base, a
        return a * self.base + b

    def to(self, value: int) -> int:
        """The pseudonym of ``value``."""
        value = self._once(value)
        while value >= self.size:
            value = self._once(value)
        return value

    def back(self, value: int) -> int:
        """The value of a pseudonym."""
        value = self._undo(value)
        while value >= self.size:
            value = self._undo(value)
        return value


@lru_cache(maxsize=4096)
def _net(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def luhn(digits: str) -> bool:
    """Whether the digits have a right Luhn sum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _number(key: bytes, kind: str, digits: str, way: str) -> str:
    n = len(digits)
    return str(getattr(_net(key, f"{kind}{n}", 10**n), way)(int(digits))).zfill(n)


def card(text: str, key: bytes, way: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or not luhn(digits):
        return None
    new = digits[0] + _number(key, "card", digits[1:-1], way)
    check = next(d for d in "0123456789" if luhn(new + d))
    return _fill(text, new + check)


def ssn(text: str, key: bytes, way: str) -> str | None:
    a, g, s = text.split("-")
    size = 898 * 99 * 9999  # areas 001-899 without 666, groups 01-99, serials 0001-9999

    def valid(area: int, group: int, serial: int) -> bool:
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    if not valid(int(a), int(g), int(s)):
        return None
    area = int(a) - 1 - (int(a) > 666)
    value = getattr(_net(key, "ssn", size), way)((area * 99 + int(g) - 1) * 9999 + int(s) - 1)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(text: str, key: bytes, way: str) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d)", text)
    cut = head.end() if head else 0
    rest = text[cut:]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12 or len(set(digits)) == 1:
        return None
    return text[:cut] + _fill(rest, _number(key, "phone", digits, way))


def ip(text: str, key: bytes, way: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = getattr(_net(key, "ip", 1 << 32), way)(int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def _mod97(iban: str) -> int:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def iban(text: str, key: bytes, way: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    new = _classes(plain[4:], key, "iban", way)
    check = 98 - _mod97(plain[:2] + "00" + new)
    out = plain[:2] + f"{check:02d}" + new
    it = iter(out)
    return "".join(" " if c == " " else next(it) for c in text)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(text: str, key: bytes, kind: str, way: str) -> str:
    """Permute digits, small and capital letters together, each within its class; other characters stay."""
    classes = [next((a for a in _ALPHABETS if c in a), None) for c in text]
    out, shape = list(text), "".join("." if a is None else a[0] for a in classes)
    spots = [i for i, a in enumerate(classes) if a]
    for at in range(0, len(spots), 24):  # long values in blocks
        block = spots[at : at + 24]
        size = value = 1
        value = 0
        for i in block:
            size *= len(classes[i])
            value = value * len(classes[i]) + classes[i].index(text[i])
        value = getattr(_net(key, f"{kind}{shape}{at}", size), way)(value) if size > 1 else value
        for i in reversed(block):
            value, k = divmod(value, len(classes[i]))
            out[i] = classes[i][k]
    return "".join(out)


def email(text: str, key: bytes, way: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_classes(local, key, 'email:' + domain.lower(), way)}@{domain}"


@lru_cache(maxsize=1)
def _ambiguous() -> tuple[list[datetime.date], dict[datetime.date, int], list[datetime.date], dict[datetime.date, int]]:
    """Days up to the 12th of a month, which have two readings with '/', and the other days; each with its ranks."""
    days = [FIRST_DAY + datetime.timedelta(n) for n in range(DAYS)]
    early, late = [d for d in days if d.day <= 12], [d for d in days if d.day > 12]
    return early, {d: i for i, d in enumerate(early)}, late, {d: i for i, d in enumerate(late)}


def date(text: str, key: bytes, way: str) -> str | None:
    """Year first (2024-03-09) or last (09.03.2024, 03/09/2024: with '/' the month comes first unless it is above 12).

    With '/', days above the 12th are permuted among themselves, so a value keeps the one reading that it has.  A day or month
    of one digit gets one where the new one has one: its width is the new value's own.
    """
    sep = re.search(r"\D", text)[0]
    a, b, c = text.split(sep)
    year_first = len(a) == 4
    swapped = not year_first and sep == "/" and int(a) <= 12
    y, m, d = (a, b, c) if year_first else (c, a, b) if swapped else (c, b, a)
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    if sep == "/" and not year_first:
        early, early_rank, late, late_rank = _ambiguous()
        days, rank, tweak = (early, early_rank, "date/early") if day.day <= 12 else (late, late_rank, "date/late")
        new = days[getattr(_net(key, tweak, len(days)), way)(rank[day])]
    else:
        new = FIRST_DAY + datetime.timedelta(getattr(_net(key, "date", DAYS), way)((day - FIRST_DAY).days))
    short = any(len(p) == 1 for p in (m, d))
    y, m, d = f"{new.year:04d}", f"{new.month}" if short else f"{new.month:02d}", f"{new.day}" if short else f"{new.day:02d}"
    return sep.join((y, m, d) if year_first else (m, d, y) if swapped else (d, m, y))


#: A candidate is the first alternative that fits; it counts if its kind validates it.
_PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
    r"|(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"
    r"|(?<![0-9A-Za-z./-])(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?:(?=T[0-9])|(?![0-9A-Za-z]|[-/.][0-9]))"
    r"|(?<![0-9A-Za-z-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])"
    r"|(?<![0-9A-Za-z+])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<s3>[ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{4}(?:(?P=s3)[0-9]{3})?|[0-9]{4}(?P<s4>[ -])[0-9]{6}(?P=s4)[0-9]{5})(?![0-9A-Za-z])"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|(?<![0-9A-Za-z+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
)
_BY_KIND = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}
#: Every value holds a digit or an '@', and no more than a run of these characters stands before the first one.
_SEED = re.compile(r"[0-9@]")
_BEFORE = re.compile(r"[A-Za-z._%+(-]*\Z")
_DIGITS = re.compile(r"[0-9]*")
_LOCAL = 64  # most characters of an e-mail address before its first digit or '@'


def pseudonymise(text: str, key: bytes, way: str = "to") -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each replaced value in the old text."""
    found, parts = [], []
    done = look = 0  # copied up to, searched up to
    while (seed := _SEED.search(text, look)) is not None:
        at = seed.start()
        first = at - len(_BEFORE.search(text[max(look, at - _LOCAL) : at])[0])
        m = next((m for p in range(first, at + 1) if (m := _PATTERN.match(text, p)) is not None), None)
        kind = m and next(k for k in _BY_KIND if m.group(k) is not None)
        new = m and _BY_KIND[kind](m.group(kind), key, way)
        if new is None:
            look = max(at + 1, _DIGITS.match(text, at).end())
            continue
        parts += [text[done : m.start()], new]
        found.append((kind, m.start(), m.end()))
        done = look = m.end()
    if not found:
        return text, found
    parts.append(text[done:])
    return "".join(parts), found


def batches(source: Iterator[pa.RecordBatch], key: bytes, text: str, counts: bool) -> Iterator[pa.RecordBatch]:
    for batch in source:
        at = batch.schema.get_field_index(text)
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            pairs = [pseudonymise(t, key) if t else (t, []) for t in part.column(at).to_pylist()]
            columns, names = part.columns, list(part.schema.names)
            columns[at] = pa.array([t for t, _ in pairs], pa.string())
            if counts:
                for k in KINDS:
                    columns.append(pa.array([sum(f[0] == k for f in found) for _, found in pairs], pa.int64()))
                    names.append(f"n_{k}")
                columns.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in found) for _, found in pairs], pa.string()))
                names.append("pii_spans")
            yield pa.RecordBatch.from_arrays(columns, names)


def apply(docs: DataFrame, key: bytes, *, text: str = "text", counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text``, then ``n_<kind>`` (long) and ``pii_spans`` of the old text.

    Columns of the input that clash with the added ones are replaced; without ``counts`` none are added.
    """
    if not key:
        raise ValueError("a key is needed")
    added = [*(f"n_{k}" for k in KINDS), "pii_spans"] if counts else []
    kept = docs.drop(*added)
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(c, T.LongType() if c != "pii_spans" else T.StringType()) for c in added])
    return kept.mapInArrow(workers.batches(__name__, "batches", key, text, counts), schema)


def n_chars(frame: DataFrame, text: str = "text") -> DataFrame:
    """Set ``n_chars`` to the length of the text as it is now."""
    return frame.withColumn("n_chars", F.char_length(text).cast("long"))
