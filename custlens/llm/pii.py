"""Personal data replaced by pseudonyms of the same format.

Values are found by pattern and validated; then a keyed Feistel network permutes them within their format: a card number
becomes another valid card number of that length, a date another date, an address another address. The permutation
depends on the key and the format only, so equal values get equal pseudonyms in all documents, whatever their
separators, and the holder of the key can turn them back (``restored``). There is no default key.

Formats: card (13 to 19 digits, Luhn), iban (mod 97), ssn (issued ranges), phone, ip (four octets), date (ISO, dotted,
slashed), email (the local part; letters stay letters, digits digits). Numbers that fail their check are left alone. The
order and the widths of a date's fields are part of its format: ``1.2.2024`` becomes a date whose day and month have one digit,
``25/12/2024``, which only the day can begin, one that the day begins, too.

Each document is handled on its own, in Arrow batches; a pattern match picks the documents that need a closer look, and
nothing is shuffled.

Defined results: a missing text counts as empty and holds nothing; rows are handled one by one, so repeated rows and
repeated or missing ids each get their own, equal result; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import slices

ROUNDS = 10
KINDS = ("card", "date", "email", "iban", "ip", "phone", "ssn")

#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: Smallest day, and the digits of day and month, of dates that are written in full.
FULL = (1, 2, 2)


@lru_cache(16)
def days_of_format(first: int, day_width: int, month_width: int) -> list[int]:
    """Ordinals of all dates with a day from ``first`` on whose day and month have so many digits; two digits may begin with 0."""
    every = (FIRST_DAY + timedelta(days=k) for k in range((LAST_DAY - FIRST_DAY).days + 1))
    most = {1: 9, 2: 99}
    return [d.toordinal() for d in every if first <= d.day <= most[day_width] and d.month <= most[month_width]]


class Feistel:
    """A keyed permutation of the numbers below ``size``, by a balanced network and cycle walking."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.width = (self.half + 7) // 8
        self.state = hashlib.blake2b(f"{name}/{size}".encode(), key=hashlib.sha256(key).digest(), digest_size=32)

    def _mix(self, step: int, right: int) -> int:
        h, out = self.state.copy(), b""
        h.update(bytes([step]) + right.to_bytes(self.width, "little"))
        out = h.digest()
        while len(out) < self.width:
            out += hashlib.blake2b(out).digest()
        return int.from_bytes(out[: self.width], "little") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        if back:
            for step in reversed(range(ROUNDS)):
                left, right = right ^ self._mix(step, left), left
        else:
            for step in range(ROUNDS):
                left, right = right, left ^ self._mix(step, right)
        return left << self.half | right

    def __call__(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


class Pseudonyms:
    """Permutations by format under one key; ``back`` turns pseudonyms into the values again."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self._network = lru_cache(4096)(lambda name, size: Feistel(key, name, size))

    def number(self, name: str, x: int, size: int) -> int:
        return self._network(name, size)(x, self.back)

    def card(self, digits: str) -> str:
        body = digits[:-1]
        new = str(self.number("card", int(body), 10 ** len(body))).zfill(len(body))
        return new + str(luhn_digit(new))

    def iban(self, value: str) -> str:
        country, body = value[:2], value[4:]
        new = self.mixed("iban" + country, body)
        return country + f"{98 - _mod97(new + country + '00'):02d}" + new

    def ssn(self, digits: str) -> str:
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        k = (area - 1 if area < 666 else area - 2) * 99 * 9999 + (group - 1) * 9999 + serial - 1
        k = self.number("ssn", k, 898 * 99 * 9999)
        area, rest = divmod(k, 99 * 9999)
        group, serial = divmod(rest, 9999)
        return f"{area + 1 if area < 665 else area + 2:03d}{group + 1:02d}{serial + 1:04d}"

    def digits(self, name: str, digits: str) -> str:
        return str(self.number(name, int(digits), 10 ** len(digits))).zfill(len(digits))

    def ip(self, value: str) -> str:
        k = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, self.number("ip", k, 1 << 32).to_bytes(4, "big")))

    def day(self, value: date, form: tuple[int, int, int] = FULL) -> date:
        """Another date of the same form (see :func:`days_of_format`)."""
        days = days_of_format(*form)
        name = "date" if form == FULL else "date/{}/{}/{}".format(*form)
        return date.fromordinal(days[self.number(name, bisect_left(days, value.toordinal()), len(days))])

    def mixed(self, name: str, value: str) -> str:
        """Letters and digits permuted together, each within its class; other characters stay."""
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in value]
        k, size = 0, 1
        for c, n in zip(value, sizes):
            k, size = k * n + (int(c) if n == 10 else ord(c) - ord("A" if c.isupper() else "a") if n == 26 else 0), size * n
        shape = "".join("9" if n == 10 else c if n == 1 else "A" if c.isupper() else "a" for c, n in zip(value, sizes))
        k = self.number(f"{name}/{shape}", k, size)
        out = []
        for c, n in zip(reversed(value), reversed(sizes)):
            k, r = divmod(k, n)
            out.append(str(r) if n == 10 else c if n == 1 else chr(ord("A" if c.isupper() else "a") + r))
        return "".join(reversed(out))


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value)) % 97


def _refill(shape: str, characters: str) -> str:
    """The characters in the places of letters and digits of ``shape``."""
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _only(value: str) -> str:
    return "".join(c for c in value if c.isalnum())


def _card(found: re.Match, p: Pseudonyms) -> str | None:
    digits = _only(found[0])
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    return _refill(found[0], p.card(digits))


def _iban(found: re.Match, p: Pseudonyms) -> str | None:
    value = _only(found[0])
    if not 15 <= len(value) <= 34 or _mod97(value[4:] + value[:4]) != 1:
        return None
    return _refill(found[0], p.iban(value))


def _ssn(found: re.Match, p: Pseudonyms) -> str | None:
    digits = _only(found[0])
    if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
        return None
    return _refill(found[0], p.ssn(digits))


def _phone(found: re.Match, p: Pseudonyms) -> str | None:
    """The country code stays; the other digits are permuted."""
    code, rest = found["code"] or "", found[0][len(found["code"] or ""):]
    digits = _only(rest)
    if not 7 <= len(digits) <= 12:
        return None
    return code + _refill(rest, p.digits("phone", digits))


def _ip(found: re.Match, p: Pseudonyms) -> str | None:
    parts = found[0].split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    return p.ip(found[0])


def _date(found: re.Match, p: Pseudonyms) -> str | None:
    """ISO and dotted dates have one reading; slashed ones are month first unless that is impossible."""
    value = found[0]
    mark = next(c for c in value if not c.isdigit())
    fields = value.split(mark)
    month_first = mark == "/" and int(fields[0]) <= 12
    year, month, day = fields if mark == "-" else (fields[2], *fields[:2]) if month_first else (fields[2], fields[1], fields[0])
    try:
        given = date(int(year), int(month), int(day))
    except ValueError:
        return None
    if not FIRST_DAY <= given <= LAST_DAY:
        return None
    # a slashed date that the day begins is read so because the day is beyond 12, and its pseudonym must be, too
    new = p.day(given, (13 if mark == "/" and not month_first else 1, len(day), len(month)))
    d, m, y = f"{new.day:0{len(day)}d}", f"{new.month:0{len(month)}d}", f"{new.year:04d}"
    return mark.join((y, m, d) if mark == "-" else (m, d, y) if month_first else (d, m, y))


def _email(found: re.Match, p: Pseudonyms) -> str | None:
    local, at, domain = found[0].rpartition("@")
    return p.mixed("email", local) + at + domain


#: Tried in this order at each place; patterns of later kinds see only what earlier ones left.
FORMATS: tuple[tuple[str, re.Pattern, Callable[[re.Match, Pseudonyms], str | None]], ...] = (
    ("email", re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("iban", re.compile(
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(
        r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
        r"(?![0-9/-]|\.[0-9])"), _date),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _ip),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn),
    ("card", re.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"), _card),
    ("phone", re.compile(
        r"(?<![0-9A-Za-z+])(?P<code>\+[0-9]{1,3}(?=[ (.-]))?[ .-]?(?:\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}"
        r"|(?<=[0-9][ .-])[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"), _phone),
)

#: What a text must hold for any format.
GATE = r"@|[0-9][ -]?[0-9][ -]?[0-9][ .)-]{0,2}[0-9]|[0-9][./-][0-9]"


def replaced(text: str, p: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans (start, end, kind) of the values in the text given."""
    found: list[tuple[int, int, str, str]] = []
    rest = text
    for kind, pattern, change in FORMATS:
        here = []
        for m in pattern.finditer(rest):
            new = change(m, p)
            if new is not None:
                here.append((m.start(), m.end(), kind, new))
        if here:  # hide them from the later kinds, keeping all places
            parts, at = [], 0
            for start, end, _, _ in here:
                parts += [rest[at:start], "\0" * (end - start)]
                at = end
            rest = "".join([*parts, rest[at:]])
            found += here
    found.sort()
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [(s, e, kind) for s, e, kind, _ in found]


def pseudonymized(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """One row per document: the text with pseudonyms, how many values of each kind, and their spans in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, back)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                texts = batch.column("text")
                counts = {k: [0] * batch.num_rows for k in KINDS}
                spans, new = [""] * batch.num_rows, []
                near = pc.match_substring_regex(texts, GATE)
                for i in pc.indices_nonzero(near).to_pylist():
                    text, found = replaced(texts[i].as_py(), p)
                    new.append(text)
                    for _, _, kind in found:
                        counts[kind][i] += 1
                    spans[i] = ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.replace_with_mask(texts, near, pa.array(new, texts.type)),
                     *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(spans, pa.string())],
                    names=["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return texts.mapInArrow(run, f"doc_id bigint, text string, {counts}, spans string")


def restored(docs: DataFrame, key: bytes) -> DataFrame:
    """The texts before ``pseudonymized``, for the holder of the key."""
    return pseudonymized(docs, key, back=True)
