"""Format-preserving pseudonyms for personal data in whole texts.

Found values are validated (check digits, ranges, calendar) and encrypted by a keyed Feistel permutation of the set of
all valid values of their format: a card number becomes another one with a right check digit, a date another date.
Equal values get equal pseudonyms in all documents, different values different ones, and the key's owner can go back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MAX_REMEMBERED = 100_000
#: Characters of a secret that are permuted at once; a network's half takes at most 512 bits.
SECRET_PART = 128


class Feistel:
    """A keyed permutation of range(size) for any size: a balanced network on the next even number of bits, walked until
    the value is in range."""

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{i}|{size}|{tweak}".encode(), key=hashlib.sha256(key).digest()).digest()[:32] for i in range(ROUNDS)]

    def _f(self, i: int, x: int) -> int:
        data = x.to_bytes(max(64, -(-self.half // 8)), "big")
        out = hashlib.blake2b(data, key=self.keys[i]).digest()
        # a wider half takes further digests, by counter
        for n in range(1, -(-self.half // 512)):
            out += hashlib.blake2b(data + n.to_bytes(8, "big"), key=self.keys[i]).digest()
        return int.from_bytes(out, "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._f(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._f(i, right)
        return (left << self.half) | right

    def apply(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The permutation restricted to valid values: x must be one, and so is the result."""
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def _alphabets(text: str, hexadecimal: bool = False) -> list[str]:
    """For each character what it may become; a character alone stays."""
    if hexadecimal and not set(text) - set(_HEX):
        return [_HEX] * len(text)
    if hexadecimal and not set(text) - set(_HEX_UPPER):
        return [_HEX_UPPER] * len(text)
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), c) for c in text]


def _permute(key: bytes, kind: str, text: str, back: bool, valid: Callable[[str], bool] = lambda _: True, hexadecimal: bool = False) -> str:
    """Permutes the texts of this text's format (its characters' classes and what stays)."""
    return _permute_by(key, kind, text, _alphabets(text, hexadecimal), back, valid)


def _permute_by(key: bytes, kind: str, text: str, alphabets: list[str], back: bool, valid: Callable[[str], bool] = lambda _: True) -> str:
    size, number = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        size *= len(a)
        number = number * len(a) + (a.index(c) if len(a) > 1 else 0)
    if size < 2:
        return text

    def spell(x: int) -> str:
        out = []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    form = "".join(a[0] if len(a) > 1 else a for a in alphabets)
    return spell(Feistel(key, size, f"{kind}|{form}").apply(number, back, lambda x: valid(spell(x))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _fill(mask: str, digits: str) -> str:
    """Puts digits in the place of the mask's digits."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in mask)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _card(key: bytes, text: str, back: bool) -> str | None:
    digits = _only_digits(text)
    if not luhn(digits):
        return None
    head = _permute(key, "card", digits[:-1], back)
    return _fill(text, next(head + c for c in _DIGITS if luhn(head + c)))


def _ssn(key: bytes, text: str, back: bool) -> str | None:
    def valid(t: str) -> bool:
        d = _only_digits(t)
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    return _permute(key, "ssn", text, back, valid) if valid(text) else None


def _ip(key: bytes, text: str, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
        return None
    x = Feistel(key, 1 << 32, "ip").apply(int.from_bytes(bytes(parts), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ipv6(key: bytes, text: str, back: bool) -> str | None:
    plain = text.replace(":", "")
    plain = plain if plain in (plain.lower(), plain.upper()) else plain.lower()
    short = "::" in text
    if short and (len([g for g in text.split(":") if g]) > 7 or not re.search(r"\d", plain)):
        return None
    # a short one keeps a digit, as words like dead::beef are left, and capitals stay capitals: so the way back is clear
    capital = bool(re.search("[A-F]", plain))
    valid = lambda t: not short or (bool(re.search(r"\d", t)) and (not capital or bool(re.search("[A-F]", t))))
    new = iter(_permute(key, f"ipv6{[len(g) for g in text.split(':')]}", plain, back, valid, hexadecimal=True))
    return "".join(c if c == ":" else next(new) for c in text)


def _iban_check(country: str, rest: str) -> str:
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _iban(key: bytes, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "").upper()
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != check:
        return None
    rest = _permute(key, f"iban{country}", rest, back)
    out = iter(country + _iban_check(country, rest) + rest)
    new = "".join(c if c == " " else next(out) for c in text)
    return new.lower() if text[0].islower() else new


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(key: bytes, text: str, back: bool) -> str | None:
    numbers = re.findall(r"\d+", text)
    at = 0 if len(numbers[0]) == 4 else 2
    year, a, b = int(numbers[at]), int(numbers[1 if at == 0 else 0]), int(numbers[2 if at == 0 else 1])
    month_first = at == 0 or ("/" in text and not (a > 12))
    try:
        x = date(year, *((a, b) if month_first else (b, a))).toordinal()
    except ValueError:
        return None
    if not _FIRST <= x <= _LAST:
        return None

    def spell(y: int) -> str:
        d = date.fromordinal(y + _FIRST)
        parts = (d.month, d.day) if month_first else (d.day, d.month)
        values = iter((d.year, *parts) if at == 0 else (*parts, d.year))
        return re.sub(r"\d+", lambda m: str(next(values)).zfill(len(m[0])), text)

    # a field of one digit stays one
    form = [len(n) for n in numbers]
    kept = lambda y: 1 not in form or [len(n) for n in re.findall(r"\d+", spell(y))] == form
    tweak = f"date{at}{month_first}" + (str(form) if 1 in form else "")
    # a day over 12 shows that the day comes first: such dates stay among themselves, so the way back is clear
    shows = "/" in text and at == 2 and not month_first
    return spell(Feistel(key, _LAST - _FIRST + 1, tweak).apply(x - _FIRST, back, lambda y: kept(y) and (not shows or date.fromordinal(y + _FIRST).day > 12)))


def _phone(key: bytes, text: str, back: bool) -> str | None:
    digits = _only_digits(text)
    marks = sum(text.count(c) for c in " .-") + 2 * text.count("(") + 2 * text.startswith("+")
    # a national number is known by its leading 0, which stays; others don't get one
    zero = not text.startswith("+") and digits.startswith("0")
    if not 9 <= len(digits) <= 15 or marks + text.count("/") + zero < 2 or (zero and marks + text.count("/") < 1):
        return None
    # the country's code or the leading 0 stays; all other digits are one number, whatever stands between them
    head = _country_code(digits) if text.startswith("+") else "0" if zero else ""
    valid = lambda t: bool(head) or not t.startswith("0")
    return _fill(text, head + _permute(key, f"phone{'+' * text.startswith('+')}{head}", digits[len(head) :], back, valid))


#: The country codes of one and of two digits; all others have three.
_ONE_DIGIT = "1 7".split()
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _country_code(digits: str) -> str:
    return digits[: 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3]


def _by_parts(key: bytes, kind: str, text: str, alphabets: list[str], back: bool, valid: Callable[[str], bool] = lambda _: True) -> str:
    """Long texts by parts, each under a key of its own from the parts before it in clear; ``valid`` is for a short one."""
    out, clear = [], hashlib.sha256(b"")
    for i in range(0, len(text), SECRET_PART):
        part = text[i : i + SECRET_PART]
        whole = valid if len(text) <= SECRET_PART else lambda _: True
        new = _permute_by(key, f"{kind}{clear.hexdigest() if i else ''}", part, alphabets[i : i + SECRET_PART], back, whole)
        clear.update((new if back else part).encode())
        out.append(new)
    return "".join(out)


def _email(key: bytes, text: str, back: bool) -> str | None:
    name, _, top = text.rpartition(".")
    # an address is the same in any case; each place keeps its own
    low = "".join(c.lower() if c in _UPPER else c for c in name)
    new = _by_parts(key, "email", low, _alphabets(low), back)
    return "".join(n.upper() if c in _UPPER else n for c, n in zip(name, new, strict=True)) + "." + top


def _mixed(text: str) -> bool:
    """Twelve characters or more in parts that mix letters and digits: prose with hyphens and a year has none."""
    parts = re.split(r"[_\-]", text)
    return sum(len(p) for p in parts if re.search(r"\d", p) and re.search(r"[A-Za-z]", p)) >= 12


def _secret(key: bytes, text: str, back: bool) -> str | None:
    return _by_parts(key, "secret", text, _alphabets(text, True), back, _mixed) if _mixed(text) else None


#: Kinds in the order in which they are tried at a place.
KINDS: dict[str, tuple[str, Callable[[bytes, str, bool], str | None]]] = {
    "email": (r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}(?![\w\-])", _email),
    "iban": (r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])", _iban),
    "secret": (r"(?<![A-Za-z0-9])(?<![_\-]{2})(?=[A-Za-z_\-]*\d)(?=[\d_\-]*[A-Za-z])[A-Za-z0-9_\-]{20,}", _secret),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)", _ip),
    "ipv6": (r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?!\.\d))(?![\w:])", _ipv6),
    "date": (r"(?<![\d\-/.])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d\-/]|\.\d)", _date),
    "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    "card": (r"(?<![\d])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)", _card),
    # unspaced; international, the first group of one digit too; with a leading 0, groups of two or more; three groups or more
    "phone": (r"(?<![\w+])\+\d{9,15}(?!\w|\.\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-/]\d(?=[ .\-/]))?(?:[ .\-/](?=\d\d)\d|\d){5,12}(?!\w|\.\d)|(?<![\w+])(?<!\d[.,\-/])(?=\(?0\d)(?!\d\d[.\-/]\d\d[.\-/]\d{4}(?!\d))\(?\d(?:\)?[ .\-/](?=\d\d)\d|\)?\d){8,14}(?!\w|\.\d)|(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])(?:\d{2,4}[ .\-]){0,4}\d{3,4}(?!\w|\.\d)", _phone),
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
_HINT = re.compile(r"[0-9@]")
_EACH = {k: re.compile(p) for k, (p, _) in KINDS.items()}


class Pseudonymiser:
    """Replaces what it finds; remembers a bounded number of values."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("the key is empty")
        self.key, self.back = key, back
        self.known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a found text, None if it isn't a valid value of the kind."""
        if (kind, text) not in self.known:
            if len(self.known) >= MAX_REMEMBERED:
                self.known.clear()
            self.known[kind, text] = KINDS[kind][1](self.key, text, self.back)
        return self.known[kind, text]

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind. A place that fails one kind is tried for the next."""
        found: dict[str, int] = {}
        if not text or not _HINT.search(text):
            return text, found
        out, at = [], 0
        m = _ANY.search(text)
        while m:
            order = list(KINDS)
            for kind in order[order.index(m.lastgroup) :]:
                own = m if kind == m.lastgroup else _EACH[kind].match(text, m.start())
                new = self.value(kind, own[0]) if own else None
                if new is not None:
                    out += [text[at : own.start()], new]
                    at = own.end()
                    found[kind] = found.get(kind, 0) + 1
                    break
            else:
                out.append(text[at : m.start() + 1])
                at = m.start() + 1
            m = _ANY.search(text, at)
        return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Rows (id, text, n_<kind> for each kind): whole texts with pseudonyms. One row per input row, in no shuffle.

    A null text stays null, an empty one empty, with zero counts; null ids stay. Rows that repeat an id or everything are
    replaced each for itself, alike for equal texts; an empty table gives no rows. Other columns are ignored, whatever
    their names. ``back`` undoes it.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, back)
        for batch in batches:
            done = [worker.text(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([f.get(k, 0) for _, f in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *counts], names=["doc", "text", *[f"n_{k}" for k in KINDS]])

    schema = f"doc {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnsRenamed({"doc": id_col, "text": text_col})
