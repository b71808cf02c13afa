"""Format-preserving pseudonyms: validated values are permuted within their format by a keyed Feistel network.

The same value gets the same pseudonym in every document, however it is written, so values stay linked: what is permuted is
the day of a date and the national digits of a phone number, and the result is written in the shape that the value had.
Numbers with check digits keep valid ones, dates stay dates, addresses stay addresses. What does not validate is left alone.
Where a value ends follows from the shape of the text alone, never from its digits, so that a pseudonym ends where its value did.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from incidentlens.llm.frames import fresh, map_arrow

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NAMES = "|".join(MONTHS + [m[:3] for m in MONTHS if m != "may"])

PATTERN = re.compile(
    r"(?P<email>(?:(?<![\w.+-])[\w.+-]*|[\w.+-]{0,63})[\w+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})"
    r"|(?P<secret>(?<![A-Za-z0-9])(?i:(?:[a-z0-9]{1,16}[_-]){0,3}(?:token|password|passwd|secret|api[_-]?key)(?:[_-][a-z0-9]{1,16}){0,2})"
    r"[\"']?[ \t]*[=:][ \t]*[\"']?)"
    r"(?P<secret_value>(?=[A-Za-z0-9_\-./+~@!#$%^*]*?[0-9])[A-Za-z0-9_\-]+(?:[./+~@!#$%^*]+[A-Za-z0-9_\-]+)*)"
    r"|(?P<access_key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b)"
    r"|(?P<ip>(?<![\d.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\d))"
    r"|(?P<iso>(?<![\d-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![\d-])|(?<![\d/])[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?![\d/]))"
    r"|(?P<dotted>(?<![\d./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![\d/]))"
    rf"|(?P<named>(?<![\w.])[0-9]{{1,2}} (?i:{NAMES})\.? [0-9]{{4}}(?!\w)|(?<!\w)(?i:{NAMES})\.? [0-9]{{1,2}},? [0-9]{{4}}(?!\w))"
    r"|(?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4})(?!\.?\d)"
    r"|(?<![\w)])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\d)|(?<![\w.+-])(?<!\d )[0-9]{3} [0-9]{3} [0-9]{4}(?![ .-]?\d)"
    r"|(?<![\w.+-])(?<!\d )0[0-9]{2,3} [0-9]{3,4} [0-9]{4}(?![ .-]?\d)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
    r"|[0-9](?:[ -]?[0-9]){12,18})(?![\d-]))"
)
SIGN, BLANK = re.compile(r"[0-9@]"), re.compile(r"[ \n]")
BEFORE, AFTER = 128, 64  # characters around a digit or at sign that a value with blanks in it can take
PIECE = 256  # characters of an address or secret that are permuted together


class Permutation:
    """A keyed permutation of 0..n-1 for any n: a balanced Feistel network, walked until it lands below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, turn: int, half: int, side: int) -> int:
        data = f"{kind}|{n}|{turn}|{half}".encode()
        size = min(64, side.bit_length() // 8 + 9)
        out = b""
        while len(out) < side.bit_length() // 8 + 9:
            out += hashlib.blake2b(data + len(out).to_bytes(4, "big"), key=self.key, digest_size=size).digest()
        return int.from_bytes(out, "big") % side

    def _pass(self, kind: str, n: int, x: int, back: bool) -> int:
        side = math.isqrt(max(n - 1, 0)) + 1
        left, right = divmod(x, side)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - self._round(kind, n, turn, left, side)) % side, left
            else:
                left, right = right, (left + self._round(kind, n, turn, right, side)) % side
        return left * side + right

    def apply(self, kind: str, n: int, x: int, back: bool = False) -> int:
        while True:
            x = self._pass(kind, n, x, back)
            if x < n:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


# The country codes of one and two digits in the international numbering plan; all others have three.
COUNTRY_CODES = {
    "1", "7",
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}


def country_code(digits: str) -> int:
    """The number of digits of the country code that an international number begins with."""
    return next((n for n in (1, 2) if digits[:n] in COUNTRY_CODES), 3)


class Pseudonyms:
    """Replaces the values of a text; ``back=True`` restores them."""

    def __init__(self, key: bytes, back: bool = False):
        self.permute, self.back = Permutation(key), back
        self.known: dict[tuple[str, str], str | None] = {}

    def characters(self, kind: str, text: str) -> str:
        """Permute the letters and digits of a text in place; case and other characters stay.

        Texts of more than ``PIECE`` characters are permuted in pieces, each by its place.
        """
        if len(text) > PIECE:
            pieces = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
            return "".join(self.characters(f"{kind}/{i}", p) for i, p in enumerate(pieces))
        sets = ["" if not c.isascii() else LETTERS if c.lower() in LETTERS else DIGITS if c in DIGITS else "" for c in text]
        n = math.prod(len(s) for s in sets if s)
        if n <= 1:
            return text
        x = 0
        for c, s in zip(text, sets):
            if s:
                x = x * len(s) + s.index(c.lower())
        x = self.permute.apply(f"{kind}:{''.join(str(len(s)) for s in sets)}", n, x, self.back)
        out = []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                x, at = divmod(x, len(s))
                out.append(s[at].upper() if c.isupper() else s[at])
            else:
                out.append(c)
        return "".join(reversed(out))

    def digits(self, kind: str, digits: str) -> str:
        x = self.permute.apply(f"{kind}:{len(digits)}", 10 ** len(digits), int(digits), self.back)
        return f"{x:0{len(digits)}d}"

    def email(self, v: str) -> str:
        body, _, top = v.rpartition(".")
        # Letters beyond a-z stand for themselves as far as they are lower-cased: the rest of the address changes.
        return self.characters("email", body) + "." + top

    def secret_value(self, v: str) -> str | None:
        return self.characters("secret", v) if len(v) >= 6 else None

    def access_key(self, v: str) -> str:
        return v[:4] + self.characters("access", v[4:])

    def iban(self, v: str) -> str | None:
        plain = v.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = self.characters(f"iban{plain[:2]}", plain[4:])
        return refill(v, plain[:2] + iban_check(plain[:2], rest) + rest)

    def ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = self.permute.apply("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def day(self, y: str, m: str, d: str) -> date | None:
        """Permute a date among all days from 1900 to 2099, however it was written."""
        try:
            at = date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        return date.fromordinal(FIRST_DAY + self.permute.apply("date", LAST_DAY - FIRST_DAY + 1, at - FIRST_DAY, self.back))

    def iso(self, v: str) -> str | None:
        y, m, d = re.split("[-/]", v)
        new = self.day(y, m, d)
        return new and f"{new.year:04d}{v[4]}{new.month:0{len(m)}d}{v[4]}{new.day:0{len(d)}d}"

    def dotted(self, v: str) -> str | None:
        """Day first; month first if that is no date. A day that month first could not be told by is written year first."""
        (a, b, y), (sign, other) = re.split("[./]", v), re.findall("[./]", v)
        if sign != other:
            return None
        late = int(b) > 12
        new = self.day(y, a, b) if late else self.day(y, b, a)
        if new is None:
            return None
        if late and new.day <= 12:
            return new.isoformat()
        first, second = (new.month, new.day) if late else (new.day, new.month)
        return f"{first:0{len(a)}d}{sign}{second:0{len(b)}d}{sign}{new.year:04d}"

    def named(self, v: str) -> str | None:
        name, (d, y) = re.search("[A-Za-z]+", v)[0], re.findall("[0-9]+", v)
        case = next((c for c in (str.lower, str.upper, str.capitalize) if c(name) == name), None)
        if case is None:
            return None
        month = 1 + [m[:3] for m in MONTHS].index(name[:3].lower())
        new = self.day(y, f"{month:02d}", d)
        if new is None:
            return None
        short = name.lower() not in MONTHS
        other = case(MONTHS[new.month - 1][:3] if short else MONTHS[new.month - 1])
        parts = iter([f"{new.day:0{len(d)}d}", f"{new.year:04d}"])
        return re.sub("[A-Za-z]+|[0-9]+", lambda m: other if m[0] == name else next(parts), v)

    def ssn(self, v: str) -> str | None:
        area, group, serial = (int(p) for p in v.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = area - 1 - (area > 666)
        x = (areas * 99 + group - 1) * 9999 + serial - 1
        x = self.permute.apply("ssn", 898 * 99 * 9999, x, self.back)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, v: str) -> str | None:
        digits = "".join(c for c in v if c in DIGITS)
        if not 7 <= len(digits) <= 15:
            return None
        # The country code and a zero that stands for it, or for calls within the country, belong to the shape.
        head = country_code(digits) if v[0] == "+" else 0
        if re.match(r"\+[0-9]+[ .-]?\(0\)|0[0-9]{2} [0-9]{4}|0[0-9]{3} ", v):
            head += digits[head] == "0"
        return refill(v, digits[:head] + self.digits("phone", digits[head:]))

    def card(self, v: str) -> str | None:
        digits = "".join(c for c in v if c in DIGITS)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.digits("card", digits[:-1])
        return refill(v, body + luhn_digit(body))

    def value(self, kind: str, v: str) -> str | None:
        """The pseudonym of a value, None if it does not validate."""
        if (kind, v) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, v] = getattr(self, kind)(v)
        return self.known[kind, v]

    def text(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many values were replaced."""
        replaced = 0

        def put(m: re.Match) -> str:
            nonlocal replaced
            kind = m.lastgroup
            new = self.value(kind, m[kind])
            if new is None:
                return m[0]
            replaced += 1
            return (m["secret"] + new) if kind == "secret_value" else new

        out, done = [], 0
        for lo, hi in regions(text):
            out += [text[done:lo], PATTERN.sub(put, text[lo:hi])]
            done = hi
        return "".join(out) + text[done:], replaced


def regions(text: str):
    """The parts of a text, cut at blanks, in which values can be: around its digits and at signs."""
    done, hit = 0, SIGN.search(text)
    while hit:
        lo, hi = max(done, hit.start() - BEFORE), hit.end() + AFTER
        if lo > done:
            lo = max(done, text.rfind(" ", done, lo) + 1, text.rfind("\n", done, lo) + 1)
        while (hit := SIGN.search(text, hit.end(), hi)) is not None:
            hi = hit.end() + AFTER
        cut = BLANK.search(text, min(hi, len(text)))
        done = cut.start() if cut else len(text)
        yield lo, done
        hit = SIGN.search(text, done)


def refill(shape: str, characters: str) -> str:
    """Put characters in the places of the letters and digits of ``shape``."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def pseudonymize(docs: DataFrame, key: str | bytes, text_col: str = "text", count_col: str | None = "n_replaced",
                 back: bool = False) -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text_col``, and the number of replaced values in ``count_col``.

    Covered are e-mail addresses, card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, phone
    numbers, dates from 1900 to 2099, and secrets: access keys and values assigned to names like password (quoted or
    part of a longer name too). Dates are year first, day first, month first where the day is after the 12th, or with an
    English month name. One date has one pseudonym in all of these, and one phone number with and without its country code
    (or the zero in its place). A day or month of one digit gets two where its pseudonym needs them, and a date with its
    month first is written year first where the new day is before the 13th; the date, not that way of writing it,
    then comes back.
    Not covered: years of two digits, ordinals (3rd), months in other languages, phone numbers without + other than 3-3-4
    digits in groups or 0 and groups of 2-3, 3-4 and 4 digits (so no ten digits in a row), IPv6 addresses, IBANs in lower case,
    tokens that no such name is assigned to (``ghp_...``, ``Bearer ...``), values of secrets without any digit, and what
    follows a sign other than ``_-./+~@!#$%^*`` in them, or stands before their first letter or digit.
    Null and empty texts stay as they are with 0 replacements; repeated rows get equal results; if a column has
    the name of ``count_col``, the count's name gets a leading ``_``; an empty table gives an empty result.
    ``back`` turns pseudonyms into the values they stand for.
    """
    key = key.encode() if isinstance(key, str) else key
    at, names = docs.columns.index(text_col), list(docs.columns)
    schema = docs.schema
    if count_col:
        names.append(fresh(docs, count_col)[0])
        schema = StructType([*schema, StructField(names[-1], LongType())])

    def run(batches):
        made = Pseudonyms(key, back)
        for rows in batches:
            texts = rows.column(at)
            out, counts = [], []
            may = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]"), False)
            for text, look in zip(texts.to_pylist(), may.to_pylist()):
                new, n = made.text(text) if look else (text, 0)
                out.append(new)
                counts.append(n)
            columns = list(rows.columns)
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(counts, pa.int64())] * bool(count_col), names=names)

    return map_arrow(docs, run, schema)
