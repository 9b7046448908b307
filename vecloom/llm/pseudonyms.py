"""Operator 2: format-preserving Feistel pseudonyms for personal data.

Numbers and dates that pass their format's validation, and e-mail addresses and credentials, are
replaced by a keyed permutation of all values of the same format: digits stay digits, check
digits stay right, separators, widths and domains stay. So equal values get equal pseudonyms in every
document, and whoever holds the key can undo them. A date has one pseudonym however it is
written: days stay 1-9, 10-12 or 13-31 and months 1-9 or 10-12, so every notation still fits it.

Permutation: a ten-round Feistel network over the bits of the value's rank, with keyed BLAKE2b
as round function, walked on until the result is again a rank of the format.

Defined results: a null text stays null with nothing found; an empty one stays empty. Numbers of
13 to 19 digits that fail the Luhn test, impossible dates, addresses and numbers stay as they are.
Repeated rows and null ids keep a row each. Other columns stay as they are; where one has the name of
a column that is added, the added one's gets underscores.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read, small_batches, turn_to

#: The setting of a session that holds the key of the registered queries.
KEY_SETTING = "spark.vecloom.pseudonyms.key"
#: Their key where the setting is absent: for demonstrations and tests, as everybody can undo it.
DEMO_KEY = b"vecloom demonstration key"
ROUNDS = 10
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = "0123456789abcdef"

_FIND = regex.compile(
    r"""
    (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,4})?(?!\w))
  | (?P<email>(?<![\w.%+\-])[\w.%+\-]{1,64}@(?:[\w\-]{1,63}\.)+[^\W\d_]{2,24}(?![\w@]))
  | (?P<secret>(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*["']?)\K[A-Za-z0-9_\-./+=]{7,}[A-Za-z0-9_\-/+=])
  | (?P<phone>(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)|(?<![\w(+.\-])\(?[2-9]\d\d\)?[ .\-]\ ?[2-9]\d\d[ .\-]\d{4}(?![\w\-])|(?<![\w+])\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\w))
  | (?P<card>(?<![\w.\-])\d{13,19}(?!\w)|(?<![\w.\-])\d{4}(?P<a>[ \-])\d{4}(?P=a)\d{4}(?P=a)\d{4}(?![\w\-])|(?<![\w.\-])\d{4}(?P<b>[ \-])\d{6}(?P=b)\d{5}(?![\w\-]))
  | (?P<date>(?<![\w.\-/])\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}|(?![\w\-/]))|(?<![\w.\-/])\d{1,2}(?P<c>[./])\d{1,2}(?P=c)\d{4}(?![\w\-/]))
  | (?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))
  | (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\w))
    """,
    regex.VERBOSE,
)
_MAY = regex.compile(r"[0-9@=:]")
#: Characters of an IBAN without spaces, by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = {c: n for n, names in _LENGTHS.items() for c in names.split()}
#: Characters of a secret that are permuted at once.
_AT_ONCE = 128


class Pseudonyms:
    """Keyed permutations of formats. invert=True undoes them."""

    def __init__(self, key: bytes, invert: bool = False, limit: int = 100_000):
        self.key, self.invert, self.limit = hashlib.blake2b(key, digest_size=32).digest(), invert, limit
        self.memo: dict[tuple[str, str], str | None] = {}

    def permute(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of 0 .. size - 1."""
        if size < 2:
            return x
        half = max(1, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        digest = min(64, half + 7 >> 3)

        def f(i: int, r: int) -> int:
            h = hashlib.blake2b(b"%s|%d|%d|%d" % (tweak.encode(), size, i, r), key=self.key, digest_size=digest).digest()
            while len(h) * 8 < half:
                h += hashlib.blake2b(h, key=self.key).digest()
            return int.from_bytes(h, "big") & mask

        while True:
            left, right = x >> half, x & mask
            if self.invert:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ f(i, left), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ f(i, right)
            x = left << half | right
            if x < size:
                return x

    def by_class(self, s: str, tweak: str, fixed: int = 0) -> str:
        """Permute the letters and digits of s within their classes; the first `fixed` characters stay."""
        whole_hex = len(s) >= 8 and all(c in _HEX for c in s) and not s.isdigit()
        alphabet = [None if i < fixed else _HEX if whole_hex else _CLASS.get(c) for i, c in enumerate(s)]
        size, rank = 1, 0
        for c, a in zip(s, alphabet, strict=True):
            if a:
                size, rank = size * len(a), rank * len(a) + a.index(c)
        shape = "".join("x" if whole_hex else str(_ALPHABETS.index(a)) if a else "." for a in alphabet)
        rank = self.permute(rank, size, f"{tweak}:{shape}")
        out = []
        for c, a in zip(reversed(s), reversed(alphabet), strict=True):
            if a:
                rank, r = divmod(rank, len(a))
                c = a[r]
            out.append(c)
        return "".join(reversed(out))

    def card(self, s: str) -> str | None:
        digits = _digits(s)
        if int(digits[-1]) != _luhn(digits[:-1]):
            return None
        body = self.by_class(digits[:-1], "card", fixed=1)
        return _put(s, body + str(_luhn(body)))

    def phone(self, s: str) -> str | None:
        digits = _digits(s)
        code = regex.match(r"\+(\d{1,3}?)(?=\D|\d{6})", s)
        if s[0] == "+" and not code and len(digits) < 7:  # no country code can be told: a percentage or a score
            return None
        fixed = 0 if s[0] != "+" else 1 if digits[0] == "1" or not code else len(code[1])
        own = digits[fixed:]
        if len(own) == 10 and own[0] > "1" and own[3] > "1":
            rank = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
            rank = self.permute(rank, 800 * 800 * 10_000, "phone")
            rank, line = divmod(rank, 10_000)
            area, exchange = divmod(rank, 800)
            return _put(s, f"{digits[:fixed]}{area + 200}{exchange + 200}{line:04}")
        while True:  # walked on so that other numbers stay other numbers
            own = self.by_class(own, f"phone{digits[:fixed]}")
            if len(own) != 10 or own[0] < "2" or own[3] < "2":
                return _put(s, digits[:fixed] + own)

    def ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank, serial = divmod(self.permute(rank, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(rank, 99)
        return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"

    def ip(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        low, high = (1, 224) if 1 <= parts[0] < 224 else (224, 256) if parts[0] >= 224 else (0, 1)
        rank = (((parts[0] - low) * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
        rank = self.permute(rank, (high - low) << 24, "ip") + (low << 24)
        return ".".join(str(rank >> k & 255) for k in (24, 16, 8, 0))

    def date(self, s: str) -> str | None:
        try:
            if s[4:5] == "-":
                day, order = date.fromisoformat(s), "ymd"
            else:
                a, b, y = (int(x) for x in regex.split("[./]", s))
                order = "mdy" if "/" in s and a <= 12 else "dmy"
                day = date(y, a, b) if order == "mdy" else date(y, b, a)
        except ValueError:
            return None
        # a date stays within its 200 years, of which 1900 to 2099 are one span, and within its class of days and months
        start = max(1, 1900 + (day.year - 1900) // 200 * 200)
        end = min(10_000, 1900 + ((day.year - 1900) // 200 + 1) * 200)
        days = next(r for r in _DAYS if day.day in r)
        months = next(r for r in _MONTHS if day.month in r)
        size = (end - start) * len(months) * len(days)
        rank = ((day.year - start) * len(months) + day.month - months[0]) * len(days) + day.day - days[0]
        while True:  # walked on past the 31st of short months
            rank = self.permute(rank, size, f"date{start} {months[0]} {days[0]}")
            ym, d = divmod(rank, len(days))
            y, m = divmod(ym, len(months))
            try:
                new = date(start + y, m + months[0], d + days[0])
                break
            except ValueError:
                continue
        if order == "ymd":
            return new.isoformat()
        first, second = (new.month, new.day) if order == "mdy" else (new.day, new.month)
        fields = iter((first, second, new.year))
        return regex.sub(r"\d+", lambda m: f"{next(fields):0{len(m[0])}}", s)

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.by_class(plain[4:], f"iban{plain[:2]}")
        check = 98 - _mod97(body + plain[:2] + "00")
        kept = iter(f"{plain[:2]}{check:02}{body}")
        return "".join(c if c == " " else next(kept) for c in s)

    def email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        new = self.by_class(local.lower(), f"email@{domain.lower()}")
        return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + "@" + domain if len(new) == len(local) else s

    def secret(self, s: str) -> str:
        head = self.by_class(s[:_AT_ONCE], "secret", fixed=4 if s.startswith("AKIA") else 0)
        return head + "".join(self.by_class(s[i : i + _AT_ONCE], f"secret{i}") for i in range(_AT_ONCE, len(s), _AT_ONCE))

    def replace(self, kind: str, value: str) -> str | None:
        """The pseudonym of a found value; None: it fails its format's validation."""
        at = (kind, value)
        if at not in self.memo:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[at] = getattr(self, kind)(value)
        return self.memo[at]

    def text(self, text: str) -> tuple[str, Counter]:
        found: Counter = Counter()
        if not _MAY.search(text):
            return text, found

        out, done = [], 0
        while m := _FIND.search(text, done):
            kind, value = next(k for k in _KINDS if m[k] is not None), m.group()
            if kind == "iban":
                value = _own_length(value)
            new = self.replace(kind, value)
            found.update([kind] if new is not None else [])
            out += [text[done : m.start()], value if new is None else new]
            done = m.start() + len(value)
        return "".join([*out, text[done:]]), found


_DAYS, _MONTHS = (range(1, 10), range(10, 13), range(13, 32)), (range(1, 10), range(10, 13))
_KINDS = ("iban", "email", "secret", "phone", "card", "date", "ssn", "ip")


def _own_length(s: str) -> str:
    """s up to its country's IBAN length if a group ends there: what follows are words of the text."""
    end, left = 0, _IBAN.get(s[:2], len(s))
    while left and end < len(s):
        left -= s[end] != " "
        end += 1
    return s[:end] if s[end : end + 1] == " " else s


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _put(s: str, digits: str) -> str:
    kept = iter(digits)
    return "".join(next(kept) if c.isdigit() else c for c in s)


def _luhn(body: str) -> int:
    """The check digit of a number's other digits."""
    total = sum(int(c) if i % 2 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(body)))
    return -total % 10


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def key_of(spark: SparkSession) -> bytes:
    """The session's key for the registered queries."""
    return (spark.conf.get(KEY_SETTING, None) or "").encode() or DEMO_KEY


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", found: str = "n_found", kinds: str = "kinds", invert: bool = False) -> DataFrame:
    """docs with text replaced, and columns for the number found and their kinds ("email:2,ip:1")."""
    small_batches(docs.sparkSession)
    names = docs.columns
    found = free_name(found, names)
    kinds = free_name(kinds, [*names, found])
    at = names.index(text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to()
        own = Pseudonyms(key, invert)
        for b in batches:
            done = [(None, Counter()) if x is None else own.text(x) for x in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([x for x, _ in done], pa.string())
            n = pa.array([sum(c.values()) for _, c in done], pa.int64())
            k = pa.array([",".join(f"{a}:{c[a]}" for a in sorted(c)) for _, c in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, n, k], names=[*names, found, kinds])

    return docs.select(*names).mapInArrow(run, f"{schema}, `{found}` bigint, `{kinds}` string")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
