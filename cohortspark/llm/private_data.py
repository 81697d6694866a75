"""Personal data by anchor expansion: Aho-Corasick finds at-signs, schemes, plus signs, digits and the cues of identifiers in one
pass over a text; local parsers then expand each anchor, check what they find and set its boundaries.

Parsers look only at the characters beside their anchor and never at the same ones twice for the same kind, so that the time is
linear in the text. A span is (kind, start, end, base): base spans follow the patterns of their kinds to the letter; the others are
what the parsers find beyond them. Positions are code points, ends exclusive."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from .textbytes import byte_column, chunks, releasing

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "url")
BASE_KINDS = KINDS[:4]
NUMBERS = ("ip", "card", "phone")
#: Lengths of account numbers by country.
IBAN = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27,
    "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}
#: Cues in the test tables' languages; they also stand capitalised and in capitals.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "kontonr", "cuenta", "compte", "customer no", "kundennummer", "iban")
PHONE_CUES = ("phone", "tel", "telephone", "telefon", "mobile", "fax", "teléfono", "téléphone")
#: Layouts of card numbers: digits of each group.
CARDS = {(16,), (15,), (14,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY_DOMAIN = re.compile(r"[^\W_](?:[\w-]{0,61}[^\W_])?(?:\.[^\W_](?:[\w-]{0,61}[^\W_])?)*\.[^\W\d_]{2,24}")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"[ ().0-9-]+")
_AFTER_CUE = re.compile(r"(?i:\s?(?:number|no|nr|num|n°|º|#))?\.?\s{0,2}[:#=]?\s{0,2}(?=[+(0-9A-Z])")
_NUMBER = re.compile(r"[0-9](?:[ ./-]?[0-9])*")
_CALL = re.compile(r"\+?(?:\([0-9]{1,5}\)|[0-9])(?:[ ./-]?(?:\([0-9]{1,5}\)|[0-9]))*")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_AUTHORITY = re.compile(r"[^\s/?#<>\"'@]+@(?:\[[0-9A-Fa-f:.]+\]|[^\s/?#<>\"'@:\[\]]+)(?::[0-9]{1,5})?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors: what follows decides the parser."""
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word("+" + digit, ("plus", 2))
        for country in IBAN:
            found.add_word(country + digit, ("iban", 3))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word(":", ("colon", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("phone", PHONE_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(quad: str) -> bool:
    """Whether a part of an address is at most 255, whatever zeros stand before it."""
    part = quad.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


class Expander:
    """The parsers of one text. Spans are kept by kind, so that parsers can see what others of the kind have taken."""

    def __init__(self, text: str):
        self.text = text
        self.base: set[tuple[str, int, int]] = set()
        self.more: list[tuple[str, int, int]] = []
        #: up to where each kind's anchors have been read
        self.done = dict.fromkeys(("email", "digit", "quad", "colon"), 0)

    def spans(self) -> list[tuple[str, int, int, bool]]:
        for end, (kind, length) in automaton().iter(self.text):
            getattr(self, kind)(end + 1 - length, end + 1)
        # base spans of a kind don't overlap: their ends have the order of their starts
        known = {k: sorted((s, e) for x, s, e in self.base if x == k) for k in BASE_KINDS}
        out = [(k, s, e, True) for k, s, e in self.base]
        for kind, start, end in set(self.more) - self.base:
            rivals = NUMBERS if kind in (*NUMBERS, "iban", "account") else (kind,)
            if not any(_cut(known.get(k, []), start, end, k == kind) for k in rivals):
                out.append((kind, start, end, False))
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    # email

    def at(self, start: int, end: int) -> None:
        text, left = self.text, start
        while left > self.done["email"] and text[left - 1] in _LOCAL:
            left -= 1
        found = _DOMAIN.match(text, end) if left < start else None
        if found:
            self.base.add(("email", left, found.end()))
        self._any_address(start, end)
        if found:
            self.done["email"] = found.end()

    def _any_address(self, start: int, end: int) -> None:
        """Addresses with letters beyond ASCII: a local part of letters, digits and single marks, and a domain of labels."""
        text, left = self.text, start
        while left > max(start - 64, self.done["email"]) and (text[left - 1].isalnum() or text[left - 1] in "._%+-"):
            left -= 1
        while left < start and text[left] in ".%+-":
            left += 1
        found = _ANY_DOMAIN.match(text, end) if left < start and text[start - 1] != "." else None
        if found and not text[left : found.end()].isascii():
            self.more.append(("email", left, found.end()))

    # numbers

    def digit(self, start: int, end: int) -> None:
        text = self.text
        if start >= self.done["quad"]:
            self.done["quad"] = _QUADS.match(text, start).end()
            self._quads(start, self.done["quad"])
        if start >= self.done["digit"]:
            found = _CHAIN.match(text, start)
            self.done["digit"] = found.end() if found else end
            if found:
                self._chain(start, found.end())

    def _quads(self, start: int, end: int) -> None:
        """A run of numbers with single dots: four at a time from its start are addresses where each is small enough."""
        parts = self.text[start:end].split(".")
        at = start
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                self.base.add(("ip", at, at + size))
            at += size + 1

    def _chain(self, start: int, end: int) -> None:
        """Digits with single spaces or hyphens: a card where all of it is one, else the groups in it that are laid out as one."""
        digits = _digits(self.text[start:end])
        if 14 <= len(digits) <= 19 and luhn(digits):
            self.base.add(("card", start, end))
        elif len(digits) > 14:
            groups = [(m.start() + start, m.end() + start) for m in re.finditer("[0-9]+", self.text[start:end])]
            k = 0
            while k < len(groups):
                step = 1
                for many in (1, 3, 4):
                    part = groups[k : k + many]
                    if len(part) == many and tuple(e - s for s, e in part) in CARDS and self.text[part[0][0]] in "3456" and luhn(_digits(self.text[part[0][0] : part[-1][1]])):
                        self.more.append(("card", part[0][0], part[-1][1]))
                        step = many
                        break
                k += step

    def plus(self, start: int, end: int) -> None:
        """A plus sign and a digit: what is dialled goes to the last digit of its characters."""
        run = _DIALLED.match(self.text, end)
        stop = run.end() if run else end
        while stop > end and not "0" <= self.text[stop - 1] <= "9":
            stop -= 1
        if stop < end + 2:
            return
        n = len(_digits(self.text[start:stop]))
        if 10 <= n <= 15:
            self.base.add(("phone", start, stop))
        elif n > 15:
            self._shorter(start, stop)

    def _shorter(self, start: int, stop: int) -> None:
        """Of a number with too many digits, the longest part from its start to a space that has 10 to 15."""
        count, best = 0, 0
        for at in range(start, stop):
            c = self.text[at]
            if c == " " and 10 <= count <= 15 and "0" <= self.text[at - 1] <= "9":
                best = at
            count += "0" <= c <= "9"
            if count > 15:
                break
        if best:
            self.more.append(("phone", start, best))

    def phone(self, start: int, end: int) -> None:
        """After a cue, 7 to 15 digits in groups."""
        text = self.text
        if self._inside_word(start, end):
            return
        gap = _AFTER_CUE.match(text, end)
        found = _CALL.match(text, gap.end(), gap.end() + 40) if gap else None
        if found and 7 <= len(_digits(found[0])) <= 15 and not text[found.end() : found.end() + 1].isalnum():
            self.more.append(("phone", found.start(), found.end()))

    # accounts

    def _inside_word(self, start: int, end: int) -> bool:
        return (start > 0 and self.text[start - 1].isalnum()) or self.text[end : end + 1].isalpha()

    def iban(self, start: int, end: int) -> None:
        """A country and check digits: as many characters as the country's numbers have, in groups of four or in one, whose remainder
        by 97 is 1."""
        text = self.text
        if start > 0 and text[start - 1].isalnum():
            return
        size, at, own = IBAN[text[start : start + 2]], start, []
        while len(own) < size and at < len(text):
            c = text[at]
            if c == " " and len(own) % 4 == 0 and text[at - 1] != " ":
                at += 1
                continue
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            own.append(c)
            at += 1
        if len(own) == size and not text[at : at + 1].isalnum() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
            self.more.append(("iban", start, at))

    def account(self, start: int, end: int) -> None:
        """After a cue, a number of 6 to 18 digits."""
        text = self.text
        if self._inside_word(start, end):
            return
        gap = _AFTER_CUE.match(text, end)
        found = _NUMBER.match(text, gap.end(), gap.end() + 40) if gap else None
        if found and 6 <= len(_digits(found[0])) <= 18 and not text[found.end() : found.end() + 1].isalnum():
            self.more.append(("account", found.start(), found.end()))

    # addresses

    def colon(self, start: int, end: int) -> None:
        """Hexadecimal groups around a colon: an address of version 6 with three groups at least."""
        if start < self.done["colon"]:
            return
        text, left, right = self.text, start, end
        while left > max(start - 8, self.done["colon"]) and text[left - 1] in _HEX:
            left -= 1
        while right < min(len(text), start + 48) and text[right] in _HEX:
            right += 1
        self.done["colon"] = right
        while right > left and text[right - 1] == "." or text[left:right].endswith(":") and not text[left:right].endswith("::"):
            right -= 1
        own = text[left:right]
        if own.count(":") < 2 or (left > 0 and text[left - 1].isalnum()) or text[right : right + 1].isalnum():
            return
        try:
            ipaddress.IPv6Address(own)
        except ValueError:
            return
        if sum(map(bool, own.split(":"))) >= 3:
            self.more.append(("ip", left, right))

    def scheme(self, start: int, end: int) -> None:
        """Addresses of resources that name a user before the host."""
        text, left = self.text, start
        while left > start - 16 and left > 0 and text[left - 1] in _SCHEME:
            left -= 1
        while left < start and not text[left].isalpha():
            left += 1
        found = _AUTHORITY.match(text, end, end + 512) if left < start else None
        if found:
            self.more.append(("url", left, found.end()))


def _cut(known: list[tuple[int, int]], start: int, end: int, same: bool) -> bool:
    """Whether one of the spans shares a character with start..end; one of the same kind may lie in it as a whole."""
    k = bisect_left(known, (end, 0)) - 1
    while k >= 0 and known[k][1] > start:
        if not (same and start <= known[k][0] and known[k][1] <= end):
            return True
        k -= 1
    return False


def find_private(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by start, then in the order of KINDS."""
    return Expander(text).spans() if text else []


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a bounded number of bytes at a time."""
    for lo, hi in chunks(byte_column(column)[1]):
        yield from column.slice(lo, hi - lo).to_pylist()


def private_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `private_spans`: an array of (kind string, start int, end int, base boolean) for each whole text.

    Base kinds, leftmost and without overlap in a kind: email, ip (four numbers up to 255), card (14 to 19 digits that pass Luhn's
    test) and phone (a plus sign and 10 to 15 digits); a match that fails its test is dropped as it is. Beyond them: emails with
    letters beyond ASCII, addresses of version 6, cards between other digits, phone numbers that others follow or after a cue, iban,
    account numbers after a cue, urls with a user. Of these, numbers that share digits with a base span aren't listed.

    Null and empty texts have no spans; repeated rows stay; a column of docs with the result's name is replaced. The text column
    is a string."""
    docs = docs.drop("private_spans")
    place = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find_private(t)] for t in _texts(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "private_spans"])

    span = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("base", BooleanType())
    schema = StructType([*docs.schema.fields]).add("private_spans", ArrayType(span))
    return docs.mapInArrow(releasing(run), schema)


def masked(text: str | None) -> str | None:
    """A text with each span as its kind in brackets; of spans that overlap, the first stands for all."""
    parts, at = [], 0
    for kind, start, end, _ in find_private(text):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return text and "".join([*parts, text[at:]])


def mask_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with masked() texts. Null and empty texts stay as they are, and so do all other columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([masked(t) for t in _texts(batch.column(place))], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(releasing(run), docs.schema)
