"""Operator 6: format-preserving pseudonyms for personal data.

Validated values are replaced by a keyed permutation of their own format: a
Feistel network over the smallest even number of bits that holds the format's
values, walked again while it leaves them. So a pseudonym is as valid as the
value (Luhn and mod-97 check digits, calendar dates, number plans, address
octets), equal values stay equal in every document, different ones different,
and the holder of the key can undo it (`restore`).

Kinds: email (letters and digits of the local part within their own classes),
iban, card, ssn, ipv4, ipv6 (global unicast; the first group stays), phone, date
(1900 to 2099, in figures or with an English month). Separators, lengths, domains,
country codes and a card's first digit stay; names of months change their length.
What doesn't validate is left alone; a phone with a country code is replaced also
outside the number plan, and stays outside; one without needs the North American
plan, or a trunk 0 and 10 or 11 digits in groups other than that plan's. Letters of an ipv6 address in
both cases become lower case, which restore() can't undo.

Null texts stay null with no findings. Offsets in `spans` are code points of the
input. Repeated rows are handled row by row. One narrow pass; no shuffle.
"""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .textops import sliced

ROUNDS = 10
KINDS = ["email", "iban", "card", "ssn", "ipv4", "ipv6", "phone", "date"]
# English names of months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS)


PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?@(?:(?u:[^\W_])(?:(?u:[^\W_]|-)*(?u:[^\W_]))?\.)+(?:[A-Za-z]{{2,}}|(?u:[^\W\d_A-Za-z]{{2,}}))(?![A-Za-z0-9_]))
  | (?P<iban>\b[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?\b)
  | (?P<date>(?<![\w./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}})(?![\w/-]|\.[0-9])
      |(?<![\w./-])(?:[0-9]{{1,2}}\x20(?i:{_MONTH})\.?,?\x20[0-9]{{4}}|(?i:{_MONTH})\.?\x20[0-9]{{1,2}},?\x20[0-9]{{4}})(?![\w-]))
  | (?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
  | (?P<ipv4>(?<![\w.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\w|\.[0-9]))
  | (?P<ipv6>(?<![\w:.])[23][0-9A-Fa-f]{{3}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![\w:]))
  | (?P<card>(?<![\w+-])[0-9](?:[\x20-]?[0-9]){{12,18}}(?![\w-]))
  | (?P<phone>(?<![\w+])\+[0-9]{{8,15}}(?!\w|\.[0-9])|(?<![\w+])(?:\+[0-9]{{1,3}}[\x20.-]?)?(?:\([0-9]{{2,4}}\)[\x20.-]?|[0-9]{{2,4}}[\x20.-])(?:[0-9]{{2,4}}[\x20.-]?){{1,3}}[0-9]{{2,4}}(?!\w))
    """,
    re.X | re.A,
)


class Pseudonyms:
    """Keyed permutations of each kind's format."""

    def __init__(self, key: bytes):
        self.key = key
        self.walk = lru_cache(maxsize=100_000)(self._walk)

    def _round(self, label: str, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        raw = blake2b(half.to_bytes(size, "big") + bytes([i]) + label.encode(), digest_size=min(64, size + 8), key=self.key).digest()
        while len(raw) < size:
            raw += blake2b(raw, key=self.key).digest()
        return int.from_bytes(raw, "big") & ((1 << bits) - 1)

    def _feistel(self, label: str, x: int, bits: int, back: bool) -> int:
        """A permutation of 2 * bits bits."""
        left, right = x >> bits, x & ((1 << bits) - 1)
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(label, i, left, bits), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(label, i, right, bits)
        return left << bits | right

    def _walk(self, label: str, x: int, size: int, valid=None, back: bool = False) -> int:
        """A permutation of those of 0 to size - 1 that are valid."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self._feistel(label, x, bits, back)
            if x < size and (valid is None or valid(x)):
                return x

    def replace(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if the value isn't valid."""
        return getattr(self, f"_{kind}")(value, back)

    def _digits(self, label: str, digits: str, back: bool, valid=None) -> str:
        return str(self.walk(f"{label}{len(digits)}", int(digits), 10 ** len(digits), valid, back)).zfill(len(digits))

    def _email(self, value: str, back: bool) -> str:
        local, at, domain = value.partition("@")
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in local]
        x, size = 0, 1
        for c, r in zip(local, radix):
            if r > 1:
                x, size = x * r + (ord(c.lower()) - (48 if r == 10 else 97)), size * r
        x = self.walk("email" + "".join("d" if r == 10 else "a" if r == 26 else c for c, r in zip(local, radix)), x, size, None, back)
        out = []
        for c, r in zip(reversed(local), reversed(radix)):
            if r > 1:
                x, k = divmod(x, r)
                new = chr(k + (48 if r == 10 else 97))
                c = new.upper() if c.isupper() else new
            out.append(c)
        return "".join(reversed(out)) + at + domain

    def _card(self, value: str, back: bool) -> str | None:
        digits = only_digits(value)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._digits("card" + digits[0], digits[1:-1], back)
        return refill(value, body + str((10 - luhn(body + "0")) % 10))

    def _iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return None
        numbers = only_digits(plain[4:])
        if not numbers:
            return None
        shape = "".join("0" if c.isdigit() else c for c in plain[4:])
        body = refill(plain[4:], self._digits(f"iban{plain[:2]}{shape}", numbers, back))
        check = 98 - mod97(body + plain[:2] + "00")
        new = iter(plain[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _ssn(self, value: str, back: bool) -> str | None:
        digits = only_digits(value)
        return refill(value, self._digits("ssn", digits, back, social)) if social(int(digits)) else None

    def _ipv4(self, value: str, back: bool) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        x = int.from_bytes(bytes(parts), "big")
        if not routable(x):
            return None
        return ".".join(map(str, self.walk("ipv4", x, 1 << 32, routable, back).to_bytes(4, "big")))

    def _ipv6(self, value: str, back: bool) -> str | None:
        try:
            IPv6Address(value)
        except ValueError:
            return None
        head, rest = value[:4], value[4:]
        digits = rest.replace(":", "")
        if not digits:
            return None
        upper = rest == rest.upper() and rest != rest.lower()
        # a pseudonym in capitals must show it
        valid = (lambda x: not f"{x:x}".isdigit()) if upper else None
        x = self.walk(f"ipv6{'A' if upper else 'a'}{head.lower()}{len(digits)}", int(digits, 16), 16 ** len(digits), valid, back)
        new = f"{x:0{len(digits)}x}"
        filled = iter(new.upper() if upper else new)
        return head + "".join(c if c == ":" else next(filled) for c in rest)

    def _phone(self, value: str, back: bool) -> str | None:
        digits = only_digits(value)
        if not 8 <= len(digits) <= 15:
            return None
        if value[0] != "+" and digits[0] == "0" and digits[1] != "0" and [len(x) for x in re.findall("[0-9]+", value)] != [3, 3, 4]:
            # a national number with its trunk prefix; the beginning of the area code stays
            return refill(value, digits[:2] + self._digits("trunk" + digits[:2], digits[2:], back)) if len(digits) in (10, 11) else None
        code = re.match(r"\+([0-9]{1,3})", value)
        country = code[1] if code else ""
        if country.startswith("1") and len(digits) == 11:
            country = "1"
        rest = digits[len(country) :]
        north_american = len(rest) == 10 and country in ("", "1")
        within = None
        if north_american:
            within = subscriber if subscriber(int(rest)) else unplanned
        # a country code marks a phone also where the plan has no such number; without one the plan decides
        if len(rest) < 6 or (not country and within is not subscriber):
            return None
        return refill(value, country + self._digits("phone" + ("1" if north_american else country), rest, back, within))

    def _named(self, value: str, back: bool) -> str | None:
        """A date with a month's name."""
        name, (day, year) = re.search("[A-Za-z]+", value)[0], re.findall("[0-9]+", value)
        month = next(i for i, m in enumerate(MONTHS) if m[:3].lower() == name[:3].lower())
        short, padded = name.lower() != MONTHS[month].lower(), day[0] == "0"
        try:
            when = date(int(year), month + 1, int(day))
        except ValueError:
            return None
        if not FIRST_DAY <= when.toordinal() <= LAST_DAY:
            return None
        # what a style can't show (a short May, a padded day of two digits) isn't among its pseudonyms
        of = lambda x: date.fromordinal(FIRST_DAY + x)
        valid = (lambda x: (not short or of(x).month != 5) and (not padded or of(x).day < 10)) if short or padded else None
        new = of(self.walk("date" + "s" * short + "p" * padded, when.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, valid, back))
        called = MONTHS[new.month - 1][: 3 if short else None]
        called = called.upper() if name.isupper() else called.lower() if name.islower() else called
        shown = iter([f"{new.day:02d}" if padded else str(new.day), f"{new.year:04d}"])
        return re.sub("[A-Za-z]+|[0-9]+", lambda m: called if m[0][0].isalpha() else next(shown), value)

    def _date(self, value: str, back: bool) -> str | None:
        if re.search("[A-Za-z]", value):
            return self._named(value, back)
        if value[4:5] in ("-", "/"):
            order = (0, 1, 2)
            parts = re.split("[-/]", value)
        else:
            parts = re.split(r"[/.]", value)
            order = (2, 1, 0)
        for o in (order, (2, 0, 1)) if value[2:3] == "/" else (order,):
            try:
                day = date(*(int(parts[i]) for i in o))
            except ValueError:
                continue
            if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
                return None
            new = date.fromordinal(FIRST_DAY + self.walk("date", day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, None, back))
            out = list(parts)
            for i, n in zip(o, (new.year, new.month, new.day)):
                out[i] = f"{n:0{len(parts[i])}d}"
            return refill(value, "".join(out))
        return None

    def rewrite(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with every valid value replaced, and (kind, start, end) in the given text."""
        found, out, done = [], [], 0
        at = 0
        while m := PATTERN.search(text, at):
            value = one_phone(m[0]) if m.lastgroup == "phone" else m[0]
            at = m.start() + len(value)
            new = self.replace(m.lastgroup, value, back)
            if new is not None:
                out += [text[done : m.start()], new]
                done = at
                found.append((m.lastgroup, m.start(), at))
        return "".join([*out, text[done:]]) if found else text, found


FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def only_digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def refill(value: str, digits: str) -> str:
    """value with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in value)


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value)) % 97


def social(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def subscriber(x: int) -> bool:
    """Area code and exchange of the North American plan begin with 2 to 9."""
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def unplanned(x: int) -> bool:
    return not subscriber(x)


def one_phone(value: str) -> str:
    """A candidate without the groups of digits after a whole North American number, which are another value's."""
    wanted = 11 if value.startswith("+1") else 0 if value[0] == "+" else 10
    for m in re.finditer(r"[0-9]+", value):
        wanted -= len(m[0])
        if wanted == 0:
            return value[: m.end()]
    return value


def routable(x: int) -> bool:
    return 1 <= x >> 24 <= 223 and x >> 24 not in (10, 127)


#: The key of the registered query; a deployment passes its own.
QUERY_KEY = b"quillon-demonstration-key"


def pseudonymise(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """One row per document: doc_id, text (rewritten), n_<kind> for each kind, spans (kind:start:end, comma-joined, of the input)."""
    prepare(docs.sparkSession)
    columns = ", ".join(f"n_{k} long" for k in KINDS)

    def run(batches):
        p = Pseudonyms(key)
        for part in sliced(batches, text):
            texts, counts, spans = [], {k: [] for k in KINDS}, []
            for t in part.column(text).to_pylist():
                new, found = p.rewrite(t, back) if t and has_values(t) else (t, [])
                texts.append(new)
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
                for k in KINDS:
                    counts[k].append(sum(f[0] == k for f in found))
            yield pa.RecordBatch.from_arrays(
                [part.column(id).cast(pa.int64()), pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(spans, pa.string())],
                names=["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"],
            )

    return docs.select(id, text).mapInArrow(run, f"doc_id long, text string, {columns}, spans string")


def restore(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns with the values that pseudonymise() replaced under this key."""
    return pseudonymise(docs, key, id, text, back=True)


_SOME = re.compile(r"[0-9@]")


def has_values(text: str) -> bool:
    """Whether a text can hold any value: each kind has a digit or an at sign."""
    return _SOME.search(text) is not None
