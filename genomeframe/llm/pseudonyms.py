"""Format-preserving pseudonyms: validated numbers and dates under a keyed Feistel permutation.

Every found value is replaced by another valid value of the same format, chosen
by a permutation of that format's values under a secret key, so equal values
have equal pseudonyms in all documents and different values different ones.
The permutation is a balanced Feistel network over a numbered domain with
HMAC-SHA-256 rounds and cycle walking; the domain number and its size are part
of the round input, so formats do not share a permutation.

Kinds: card numbers of 13 to 19 digits with a valid Luhn digit, telephone numbers with country code,
IPv4 addresses, social-security numbers, IBANs (check digits renewed), dates
(ISO, year first with . or /, day or month first with . / -; between 1900 and 2099), letters and digits of the
local part of mail addresses. Two kinds have no check and can be switched on or off (``others``):
hexadecimal tokens of 16 to 128 characters (on), which keys and digests are, and runs of 13 to 19 digits
without a Luhn digit (off), which stay without. Separators, lengths, letter case and leading signs stay. A date has one
pseudonym, however it is written, so it stays linked across formats.

Cases: null texts stay null, empty ones empty; a value that fails its check
(an impossible date, an address part over 255) is left as it is; repeated rows
get equal results; other columns pass through. An IBAN ends where its country's
length says, so what follows it does not hide it, and a match that is no IBAN is
searched for other kinds. A narrow pass over whole texts.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from genomeframe.llm.common import replaced, small_batches, with_fields

ROUNDS = 8
#: First and number of days of the date domain.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

#: How the kinds are written.
PATTERNS = {
    "mail": r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)",
    "iban": r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "phone": r"(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]))",
    "ip": r"(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))",
    "ssn": r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    "iso": r"(?P<iso>(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9]))",
    "year": r"(?P<year>(?<![0-9./-])(?:19|20)[0-9]{2}(?P<ysep>[./])[0-9]{2}(?P=ysep)[0-9]{2}(?![0-9]))",
    "day": r"(?P<day>(?<![0-9./-])[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)(?:19|20)[0-9]{2}(?![0-9]))",
    "hex": r"(?P<hex>\b(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{16,128}|[0-9A-F]{16,128})\b)",
    "card": r"(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9]))",
}
FINDER = re.compile("|".join(PATTERNS.values()), re.ASCII)
#: What is searched where a match of the IBAN pattern is none.
OTHERS = re.compile("|".join(p for k, p in PATTERNS.items() if k != "iban"), re.ASCII)
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Of the two kinds that no check confirms ("hex" and "run") those that are replaced unless a caller says otherwise.
OTHER_KINDS = frozenset({"hex"})
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = re.compile(r"[0-9]")


class Feistel:
    """A keyed permutation of ``range(size)`` for every named domain."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, domain: str, size: int, number: int, value: int, width: int) -> int:
        message = f"{domain}|{size:x}|{number}|{value:x}".encode()
        out = b""
        while len(out) * 8 < width + 64:
            out += hmac.digest(self.key, message + bytes([len(out) % 251]), hashlib.sha256)
        return int.from_bytes(out, "big") & ((1 << width) - 1)

    def _once(self, domain: str, size: int, value: int, half: int, back: bool) -> int:
        left, right = value >> half, value & ((1 << half) - 1)
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(domain, size, number, left, half), left
            else:
                left, right = right, left ^ self._round(domain, size, number, right, half)
        return left << half | right

    def permute(self, domain: str, size: int, value: int, back: bool = False) -> int:
        """The pseudonym of ``value`` (or, with ``back``, the value of a pseudonym)."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:  # cycle walking: on average under four steps
            value = self._once(domain, size, value, half, back)
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    """The digit that makes ``body`` and it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refilled(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    source = iter(digits)
    return _DIGIT.sub(lambda _: next(source), text)


class Pseudonymiser:
    """Replaces the values of a text; ``back`` undoes it with the same key."""

    def __init__(
        self, key: bytes, back: bool = False, others: frozenset[str] = OTHER_KINDS, most_known: int = 100_000
    ):
        self.feistel, self.back, self.others, self.most = Feistel(key), back, others, most_known
        self.known: dict[tuple[str, str], str] = {}
        self.kinds: dict[str, Callable[[str], str]] = {
            k: getattr(self, f"_{k}") for k in PATTERNS
        }

    def _permute(self, domain: str, size: int, value: int) -> int:
        return self.feistel.permute(domain, size, value, self.back)

    def _digits(self, domain: str, digits: str) -> str:
        n = len(digits)
        return f"{self._permute(f'{domain}{n}', 10**n, int(digits)):0{n}d}" if n else ""

    def _card(self, text: str) -> str:
        digits = re.sub("[ -]", "", text)
        body, check = digits[:-1], digits[-1]
        if luhn_digit(body) == check:
            made = self._digits("card", body)
            return _refilled(text, made + luhn_digit(made))
        if "run" not in self.others:
            return text
        # a number without the check digit stays without: its last digit is told from the valid one
        shift = (int(check) - int(luhn_digit(body))) % 10 - 1
        at = self._permute(f"run{len(body)}", 9 * 10 ** len(body), int(body) * 9 + shift)
        made, shift = f"{at // 9:0{len(body)}d}", at % 9 + 1
        return _refilled(text, made + str((int(luhn_digit(made)) + shift) % 10))

    def _phone(self, text: str) -> str:
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text).group()
        rest = text[len(country) :]
        digits = "".join(_DIGIT.findall(rest))
        return country + _refilled(rest, self._digits(f"phone{country}/", digits))

    def _ip(self, text: str) -> str:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return text
        number = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self._permute("ip", 1 << 32, number).to_bytes(4, "big")))

    def _ssn(self, text: str) -> str:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return text
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        at = self._permute("ssn", 898 * 99 * 9999, at)
        area, rest = divmod(at, 99 * 9999)
        area += 1 + (area >= 665)
        return f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"

    def _date(self, value: datetime.date) -> datetime.date:
        """One permutation for all ways to write a date. The first twelve days of months keep among
        themselves, so a day that can not be taken for a month stays one."""
        if value.day <= 12:
            at = ((value.year - FIRST_DAY.year) * 12 + value.month - 1) * 12 + value.day - 1
            at = self._permute("date to 12", 144 * (LAST_DAY.year - FIRST_DAY.year + 1), at)
            return datetime.date(FIRST_DAY.year + at // 144, at // 12 % 12 + 1, at % 12 + 1)
        long = self._long_days()
        return long[self._permute("date from 13", len(long), bisect.bisect_left(long, value))]

    def _iso(self, text: str) -> str:
        try:
            return self._date(datetime.date.fromisoformat(text)).isoformat()
        except ValueError:
            return text

    def _year(self, text: str) -> str:
        try:
            made = self._date(datetime.date.fromisoformat(re.sub("[./]", "-", text)))
        except ValueError:
            return text
        return made.isoformat().replace("-", text[4])

    def _day(self, text: str) -> str:
        sep = re.search("[./-]", text).group()
        a, b, year = map(int, text.split(sep))
        # with slashes the month is first, as long as that is a date
        for first in ("md", "dm") if sep == "/" else ("dm", "md"):
            month, day = (a, b) if first == "md" else (b, a)
            try:
                made = self._date(datetime.date(year, month, day))
            except ValueError:
                continue
            parts = (made.month, made.day) if first == "md" else (made.day, made.month)
            return self._like(text, sep, parts, made.year)
        return text

    def _long_days(self) -> list[datetime.date]:
        if not hasattr(self, "_long"):
            days = (LAST_DAY - FIRST_DAY).days + 1
            every = (FIRST_DAY + datetime.timedelta(i) for i in range(days))
            self._long = [d for d in every if d.day > 12]
        return self._long

    @staticmethod
    def _like(text: str, sep: str, parts: tuple[int, int], year: int) -> str:
        padded = text.startswith("0") or text.split(sep)[1].startswith("0") or len(text) == 10
        form = "{:02d}" if padded else "{}"
        return sep.join([form.format(parts[0]), form.format(parts[1]), str(year)])

    @staticmethod
    def _iban_part(text: str) -> str:
        """The beginning of a match that is an IBAN (nothing if none is).

        Other countries than those of ``IBAN_LENGTHS`` and other lengths: the longest
        whole groups that pass the check.
        """
        ends = [m.start() for m in re.finditer(r" |$", text)]
        size = IBAN_LENGTHS.get(text[:2])
        for end in sorted(ends, key=lambda e: (len(text[:e].replace(" ", "")) != size, -e)):
            plain = text[:end].replace(" ", "")
            if 15 <= len(plain) <= 34:
                if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                    return text[:end]
        return ""

    def _iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        body = plain[4:]
        places = [i for i, c in enumerate(body) if c.isdigit()]
        made = self._digits(f"iban{plain[:2]}", "".join(body[i] for i in places))
        letters = list(body)
        for i, c in zip(places, made):
            letters[i] = c
        body = "".join(letters)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        source = iter(plain[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(source) for c in text)

    def _mail(self, text: str) -> str:
        local, _, host = text.partition("@")
        return self._lettered("mail", local) + "@" + host

    def _lettered(self, domain: str, text: str) -> str:
        """Letters and digits permuted together, each place keeping its kind."""
        alphabets = [next((a for a in _ALPHABETS if c in a), "") for c in text]
        size, value = 1, 0
        for c, alphabet in zip(text, alphabets):
            if alphabet:
                size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(c)
        form = "".join(a[0] if a else c for c, a in zip(text, alphabets))
        value = self._permute(f"{domain}{form}", size, value)
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if alphabets[i]:
                value, at = divmod(value, len(alphabets[i]))
                out[i] = alphabets[i][at]
        return "".join(out)

    def _hex(self, text: str) -> str:
        if "hex" not in self.others:
            return text
        # tokens of digits alone are numbers, tokens of letters alone words: both stay out of the domain
        n = len(text)
        made = text
        while True:
            made = f"{self._permute(f'hex{n}', 16**n, int(made, 16)):0{n}x}"
            if re.search("[a-f]", made) and _DIGIT.search(made):
                return made.upper() if text.isupper() else made

    def value(self, kind: str, text: str) -> str:
        got = self.known.get((kind, text))
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[kind, text] = self.kinds[kind](text)
        return got

    def text(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many values were replaced."""
        count = 0

        def line_of(line: str) -> str:
            nonlocal count
            out, done, at = [], 0, 0
            while match := FINDER.search(line, at):
                found = match.group()
                if match["iban"] is not None:
                    found = self._iban_part(found)
                    if not found:  # the place may begin something else, and so may the rest
                        at = match.start() + 4
                        match = OTHERS.match(line, match.start())
                        if not match:
                            continue
                        found = match.group()
                kind = next(k for k in self.kinds if k in match.groupdict() and match[k] is not None)
                got = self.value(kind, found)
                count += got != found
                out += [line[done : match.start()], got]
                done = at = match.start() + len(found)
            return "".join([*out, line[done:]])

        lines = text.split("\n")  # no value goes over a line end; most lines have neither digit nor @
        for i, line in enumerate(lines):
            if "@" in line or _DIGIT.search(line):
                lines[i] = line_of(line)
        return "\n".join(lines), count


def pseudonymised(
    docs: DataFrame,
    key: bytes,
    text: str = "text",
    count: str | None = None,
    length: str | None = None,
    back: bool = False,
    others: frozenset[str] = OTHER_KINDS,
) -> DataFrame:
    """``docs`` with pseudonyms in ``text``.

    ``others`` are the unchecked kinds to replace, ``back`` gives the values of pseudonyms. ``count`` names a column for the number of replaced values; ``length`` names a
    column of code points that is set anew.
    """
    added = [(text, "string")] + [(n, "long") for n in (count, length) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, back, others)
        for batch in small_batches(batches):
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = [(None, 0) if v is None else worker.text(v) for v in values]
            columns = {text: pa.array([m[0] for m in made], pa.string())}
            if count:
                columns[count] = pa.array([m[1] for m in made], pa.int64())
            if length:
                sizes = [None if m[0] is None else len(m[0]) for m in made]
                columns[length] = pa.array(sizes, pa.int64())
            yield replaced(batch, **columns)

    return docs.mapInArrow(run, with_fields(docs.schema, *added))
