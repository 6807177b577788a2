"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Card numbers, IBANs, social security numbers, telephone numbers, IP addresses, dates, mail
addresses and secrets are found by pattern and, where their kind allows, validated (check
digits, ranges, calendar).  Each value is permuted among the values of its own format with
a key: digits stay digits, letters stay letters of the same case, check digits are computed
anew, dates stay dates.  Equal values get equal pseudonyms everywhere, so they stay linked
across documents, and whoever holds the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textblock import plain

#: For tests and reports only; a production run passes its own.
DEFAULT_KEY = b"an example key"
ROUNDS = 10
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")


class Feistel:
    """A keyed permutation of the numbers below left * right, whatever the two sizes."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, number: int, half: int, below: int) -> int:
        size = below.bit_length() // 8 + 9
        data = f"{tweak}\0{number}\0{half}".encode()
        out = b"".join(hashlib.blake2b(data, digest_size=64, key=self.key, salt=k.to_bytes(4, "little")).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "little") % below

    def permute(self, value: int, left: int, right: int, tweak: str, back: bool = False) -> int:
        a, b = divmod(value, right)
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if number % 2:
                b = (b + sign * self._round(tweak, number, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, number, b, left)) % left
        return a * right + b

    def stream(self, tweak: str, number: int, half: list[int], n: int) -> tuple[int, ...]:
        """n numbers of 32 bits drawn from one half of the places."""
        data = b"".join((tweak.encode(), b"\0", number.to_bytes(2, "little"), array("H", half).tobytes()))
        seed = hashlib.blake2b(data, digest_size=64, key=self.key).digest()
        out = seed if n <= 16 else hashlib.shake_256(seed).digest(4 * n)
        return struct.unpack(f"<{n}I", out[: 4 * n])

    def below(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """Permutes the numbers below ``size`` by walking the cycle of a slightly larger domain."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            value = self.permute(value, side, side, tweak, back)
            if value < size:
                return value


#: The characters of each ASCII class are permuted among themselves.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


@lru_cache(4096)
def _class(c: str) -> str:
    """The characters that ``c`` is permuted among: those of its ASCII class, else letters or digits of its kind in the same 256 code points; empty if ``c`` is neither."""
    for s in CLASSES:
        if c in s:
            return s
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return ""
    first = ord(c) & ~255
    return "".join(x for x in map(chr, range(first, first + 256)) if x > "\x7f" and unicodedata.category(x) == kind)


def characters(f: Feistel, text: str, tweak: str, only: str = "", back: bool = False) -> str:
    """Permutes a string among those with the same class of character at each place.

    The places are halved, and each round adds to one half, place by place, numbers drawn from the
    other half with the key; so the work is proportional to the length.  ``only`` is the class of
    all characters where the string is of one class, as hexadecimal ones are.
    """
    classes = [only or _class(c) for c in text]
    at = [k for k, s in enumerate(classes) if len(s) > 1]
    if not at:
        return text
    radix = [len(classes[k]) for k in at]
    value = [classes[k].index(text[k]) for k in at]
    frame = "".join(c for c, s in zip(text, classes, strict=True) if len(s) < 2)
    tweak = f"{tweak}\0{frame}\0{hashlib.blake2b(','.join(map(str, radix)).encode(), digest_size=8).hexdigest()}"
    middle = len(at) // 2
    halves = ((0, middle), (middle, len(at)))
    sign = -1 if back else 1
    for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
        (begin, end), other = halves[number % 2], halves[1 - number % 2]
        move = f.stream(tweak, number, value[slice(*other)], end - begin)
        for k in range(begin, end):
            value[k] = (value[k] + sign * move[k - begin]) % radix[k]
    out = list(text)
    for k, v in zip(at, value, strict=True):
        out[k] = classes[k][v]
    return "".join(out)


def _fill(frame: str, digits: str) -> str:
    """Puts new digits in the places of the old ones."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in frame)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> int:
    """The sum that is divisible by ten for a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total


def card(f: Feistel, text: str, back: bool = False) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = characters(f, digits[:-1], "card", back=back)
    return _fill(text, body + str(-luhn(body + "0") % 10))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(f: Feistel, text: str, back: bool = False) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = characters(f, flat[4:], f"iban {flat[:2]}", back=back)
    check = 98 - _mod97(body + flat[:2] + "00")
    new = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(" " if c == " " else next(new) for c in text)


def ssn(f: Feistel, text: str, back: bool = False) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _digits(text)
    if not valid(digits):
        return None
    value = int(digits)
    while True:
        value = f.permute(value, 10**4, 10**5, "ssn", back)
        if valid(f"{value:09d}"):
            return _fill(text, f"{value:09d}")


#: Country codes of one and two digits (all others have three), and how many digits follow some of them.
_CODE = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
_NATIONAL = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10, "351": 9}


def phone(f: Feistel, text: str, back: bool = False) -> str | None:
    """The digits after the country code are permuted, whatever stands between them; without one, the code is that of the pattern, 1."""
    digits = _digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = _CODE.match(digits)[0] if text.startswith("+") else ""
    return _fill(text, code + characters(f, digits[len(code) :], f"phone {code or '1'}", back=back))


def ip(f: Feistel, text: str, back: bool = False) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or parts in ([0, 0, 0, 0], [127, 0, 0, 1], [255, 255, 255, 255]):
        return None
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, f.permute(value, 1 << 16, 1 << 16, "ip", back).to_bytes(4, "big")))


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_DATE = re.compile(r"([0-9]+)([-/.])([0-9]+)\2([0-9]+)")


def date(f: Feistel, text: str, back: bool = False) -> str | None:
    """Year first, or day first, or (with slashes, where day first is impossible) month first; years 1900 to 2099."""
    m = _DATE.fullmatch(text)
    orders = ("ymd",) if len(m[1]) == 4 else ("dmy", "mdy") if m[2] == "/" else ("dmy",)
    parts = [m[1], m[3], m[4]]
    for order in orders:
        at = {k: int(p) for k, p in zip(order, parts, strict=True)}
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        new = datetime.date.fromordinal(_FIRST + f.below(day, _DAYS, "date", back))
        # Month first must read as such again, so it keeps to days after the 12th.
        while order == "mdy" and new.day <= 12:
            new = datetime.date.fromordinal(_FIRST + f.below(new.toordinal() - _FIRST, _DAYS, "date", back))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return m[2].join(values[k] for k in order)
    return None


def email(f: Feistel, text: str, back: bool = False) -> str | None:
    name, _, host = text.rpartition("@")
    host, dot, top = host.rpartition(".")
    return characters(f, f"{name}@{host}", "email", back=back) + dot + top


def secret(f: Feistel, text: str, back: bool = False) -> str | None:
    for hexadecimal in _HEX:
        if not text.strip(hexadecimal):
            return characters(f, text, "secret", hexadecimal, back)
    return characters(f, text, "secret", back=back)


_FIND: tuple[tuple[str, re.Pattern[str], Callable[..., str | None]], ...] = (
    # Kind, pattern (its first group if it has one named `v`, else all of it), pseudonym.
    ("secret", re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?)(?P<v>[A-Za-z0-9+/_\-]{16,})"), secret),
    ("secret", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})\b"), secret),
    ("email", re.compile("@"), email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"), phone),
    ("phone", re.compile(r"(?<![\w+])(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4})(?![0-9])"), phone),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])"), card),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ssn),
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"), ip),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9/-]|\.[0-9])"), date),
)
_MAYBE = re.compile(r"[0-9@=:]|AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-")
#: Length of an IBAN by country.
_IBAN = dict(
    zip(
        "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split(),
        map(int, "24 23 28 20 28 20 16 22 22 29 28 21 22 28 24 22 18 28 20 29 24 18 18 27 22 22 23 18 27 28 21 28 22 23 23 26 27 30 30 20 28 32 21 20 20 21 25 27 24 22 19 27 31 30 18 15 24 28 29 25 29 24 22 24 31 24 19 24 27 25 28 23 24 26 29 22 24 20".split()),
        strict=True,
    )
)
_LOCAL = re.compile(r"[\w.+%\-]")
_HOST = re.compile(r"(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,}")
_LATER = {kind: next(p for k, p, _ in _FIND if k == kind) for kind in ("ip", "date")}


def _iban_ends(text: str, start: int, end: int) -> list[int]:
    """Ends of groups within a match, the likeliest first: that of the country's length, the whole match, shorter ones."""
    ends = [end, *(k for k in range(end - 1, start, -1) if text[k] == " ")]
    length = _IBAN.get(text[start : start + 2])
    right = [k for k in ends if len(text[start:k].replace(" ", "")) == length]
    return [*right, *([end] if length else ends)]


def _phone_ends(text: str, start: int, end: int) -> list[int]:
    """Ends of groups within a match, the likeliest first: that of the country's length, then the longest before an IP or a date, then the others."""
    ends = [end, *(k for k in range(end - 1, start, -1) if text[k - 1] in "0123456789" and text[k] not in "0123456789)")]
    digits = _digits(text[start:end])
    code = _CODE.match(digits)[0] if text[start] == "+" else ""
    right = [k for k in ends if code in _NATIONAL and len(_digits(text[start:k])) == len(code) + _NATIONAL[code]]
    stop = end
    for k in range(end - 1, start, -1):
        if text[k - 1] == " ":
            # The pattern looks at what stands before it, which is a space here.
            later = (("ip", ip), ("date", date))
            if any((m := _LATER[kind].match(text, k)) and check(_PLAIN, m[0]) is not None for kind, check in later):
                stop = k - 1
    return [*right, *(k for k in ends if k <= stop), *ends]


#: Only says whether a value passes its check.
_PLAIN = Feistel(b"")
_ENDS = {"iban": _iban_ends, "phone": _phone_ends}


def _address(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    """Where the mail address around the @ at ``sign`` begins and ends; it does not begin before ``floor``."""
    start = sign
    while start > floor and _LOCAL.match(text, start - 1):
        start -= 1
    while start < sign and not (text[start].isalnum()):
        start += 1
    host = _HOST.match(text, sign + 1)
    if start == sign or host is None or not (text[sign - 1].isalnum() or text[sign - 1] == "_"):
        return None
    return start, host.end()


class Pseudonyms:
    """Replaces what is private in a text."""

    #: Longer values are not put into the table of known ones.
    KNOWN = 200

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.cached = lru_cache(100_000)(self.pseudonym)

    def pseudonym(self, k: int, value: str) -> str | None:
        return _FIND[k][2](self.feistel, value)

    def _found(self, text: str, k: int) -> Iterator[tuple[int, int]]:
        """Matches of one kind; the receiver may send where to go on."""
        kind, pattern, _ = _FIND[k]
        at = 0
        if kind == "email":
            # Neither part of an address holds another @, so no character is looked at twice.
            while (sign := text.find("@", at)) >= 0:
                span = _address(text, sign, at)
                at = sign + 1
                if span:
                    yield span
                    at = max(at, span[1])
            return
        group = "v" if "v" in pattern.groupindex else 0
        while m := pattern.search(text, at):
            again = yield m.span(group)
            at = m.end() if again is None else again

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), in order; of overlapping finds the first kind in the list wins."""
        if not _MAYBE.search(text):
            return []
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))
        for k, (kind, _, _) in enumerate(_FIND):
            matches = self._found(text, k)
            span = next(matches, None)
            while span:
                start, end = span
                again = None
                for stop in _ENDS[kind](text, start, end) if kind in _ENDS else [end]:
                    if taken.find(1, start, stop) >= 0:
                        continue
                    value = text[start:stop]
                    new = (self.cached if len(value) <= self.KNOWN else self.pseudonym)(k, value)
                    if new is not None:
                        found.append((start, stop, kind, new))
                        taken[start:stop] = b"\1" * (stop - start)
                        again = stop if kind in _ENDS else None
                        break
                else:
                    # What a match has swallowed may hold a value of its own.
                    again = start + 1 if kind in _ENDS else None
                try:
                    span = matches.send(again)
                except StopIteration:
                    break
        return sorted(found)

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds that were found."""
        spans = self.spans(text)
        parts, at = [], 0
        for start, end, _, new in spans:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]]) if spans else text, [s[2] for s in spans]


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """Replaces private values in the column text; adds n_private and private_kinds.

    All other columns stay.  A null text stays null with no finds, an empty one empty.  Every row
    gives one row: equal rows give equal rows, and an empty table gives none.  A column named
    n_private or private_kinds in the input is replaced.  The work on a text is proportional to
    its length, whatever it holds.
    """
    carry = [c for c in docs.columns if c not in ("n_private", "private_kinds")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in carry)), "n_private int, private_kinds string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hide = Pseudonyms(key)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = table["text"].combine_chunks()
            for begin in range(0, len(texts), 512):
                part = table.slice(begin, 512)
                some = texts.slice(begin, 512)
                done = [hide(t) for t in plain(some).to_pylist()]
                new = pa.array([x[0] if ok else None for x, ok in zip(done, some.is_valid().to_pylist(), strict=True)], pa.string())
                part = part.set_column(part.column_names.index("text"), "text", new)
                part = part.append_column("n_private", pa.array([len(x[1]) for x in done], pa.int32()))
                yield from part.append_column("private_kinds", pa.array([",".join(sorted(set(x[1]))) for x in done], pa.string())).to_batches()

    return docs.select(*carry).mapInArrow(run, schema)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
