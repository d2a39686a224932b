"""Personal data with its exact place, plain or disguised.

Two transducers rewrite a text from left to right. The first one maps characters: look-alikes to the ASCII ones that
they imitate, other digits, spaces and dashes to the plain ones, invisible ones to nothing. The second one maps words:
spelled digits to digits, "[at]", " at ", "_dot_" and the like to signs. Each keeps, for every stretch that it emits,
the stretch of its input that this came from, so what the detectors find in the rewritten text maps back to the source.
Both take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import parcels, prepared, released, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the lookbehind changes no match: a match that begins inside a run of digits begins at the run as well
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, left to right, in linear time: a match has one @."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and _LOCAL.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            done = m.end()
            yield begin, done
        at = max(at + 1, done)
        if not m:
            done = max(done, at)  # no later match may begin at or before this @


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """The identifiers that stand plainly in the text: by kind, then place."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Letters that look like a Latin one (Cyrillic, Greek, Armenian, Cherokee).
_LOOK_ALIKES = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "m": "м", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟ", "E": "ЕΕᎬ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀİ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "Ꮩ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "ΖᏃ",
}
_SIGNS = frozenset("@.+-_%()[]{}<>,")


@cache
def _glyphs() -> dict[str, str]:
    """What each disguised character stands for: compatibility forms, digits, spaces, dashes, invisible ones, look-alikes."""
    table = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        kind = unicodedata.category(c)
        if kind in ("Cn", "Lo", "So") and not 0x2460 <= ord(c) < 0x2500 and not 0x1F100 <= ord(c) < 0x1F200:
            continue
        x = unicodedata.normalize("NFKC", c)
        if kind == "Cf":
            table[c] = ""
        elif kind == "Zs":
            table[c] = " "
        elif kind == "Pd" or c == "\u2212":
            table[c] = "-"
        elif (d := unicodedata.digit(c, None)) is not None:
            table[c] = str(d)
        elif x.isascii() and (x in _SIGNS or (x.isalnum() and (len(x) == 1 or kind in ("Nl", "No")))):
            table[c] = x
    return table | {"\u3002": ".", "\uff61": "."} | {c: latin for latin, alike in _LOOK_ALIKES.items() for c in alike}


@cache
def _glyph_set() -> frozenset[str]:
    return frozenset(_glyphs())


class Rewritten:
    """A text under rewriting: what is emitted, and by stretch of it the stretch of the source."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.parts: list[str] = []
        self.size = self.done = 0
        self.at: list[int] = []  # where a stretch begins
        self.begin: list[int] = []  # where its source begins
        self.end: list[int] = []  # where that ends; -1 for a stretch that is copied

    def _add(self, text: str, begin: int, end: int) -> None:
        if text:
            self.parts.append(text)
            self.at.append(self.size)
            self.begin.append(begin)
            self.end.append(end)
            self.size += len(text)

    def copy(self, until: int) -> None:
        """Emit the source as it is, from where we are."""
        self._add(self.source[self.done : until], self.done, -1)
        self.done = max(self.done, until)

    def put(self, text: str, until: int) -> None:
        """Emit this for the source up to there."""
        self._add(text, self.done, until)
        self.done = until

    def text(self) -> str:
        self.copy(len(self.source))
        return "".join(self.parts)

    def place(self, a: int, b: int) -> tuple[int, int]:
        """The source of what is emitted from a to b."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        begin = self.begin[i] + (a - self.at[i] if self.end[i] < 0 else 0)
        return begin, self.begin[j] + b - self.at[j] if self.end[j] < 0 else self.end[j]


_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "|".join(_DIGITS)
_NUMBERS = re.compile(_NUMBER, re.I)
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
#: Where the second transducer may have something to do; nothing is looked at twice, whatever surrounds it.
_ANCHOR = re.compile(
    rf"{_OPEN}(?:(?P<at>at|@)|dot|point|\.){_CLOSE}"
    rf"|(?<![^\W\d_])(?P<digits>(?:{_NUMBER})+)(?![^\W\d_])"
    r"|(?<![^\W_])(?:(?P<word_at>at)|(?P<word_dot>dot))(?![^\W_])"
    rf"|(?<![^\W_])(?P<plus>plus)(?=[\s-]++(?:[0-9]|{_NUMBER}))"
    r"|(?P<sign>@)",
    re.I,
)
_BETWEEN = re.compile(r"[\s,-]*+")
_BLANK = re.compile(r"\s*+")
_PLUS_GAP = re.compile(r"[\s-]*+")
# A domain has labels of 63 characters and 253 in all at most.
_LABEL = re.compile(r"[A-Za-z0-9]++(?:-(?!dot[-\s])[A-Za-z0-9]++)*+", re.I)
_DOT = re.compile(rf"(?P<plain>\.(?=[A-Za-z0-9]))|\s*+{_OPEN}(?:dot|point|\.){_CLOSE}\s*+|\s++(?:dot|\.)\s++|\s*+_dot_\s*+|\s*+-dot-\s*+", re.I)
_LABEL_MAX, _DOMAIN_MAX = 63, 253


def _domain(text: str, at: int) -> tuple[list[tuple[int, int]], bool]:
    """From here, what stands for the dots of a domain, with the last one's label behind it; whether one is disguised."""
    dots: list[tuple[int, int]] = []
    disguised, length = False, 0
    while (m := _LABEL.match(text, at, min(len(text), at + _LABEL_MAX + 1))) and m.end() - at <= _LABEL_MAX and length <= _DOMAIN_MAX:
        if dots:
            dots[-1] = (dots[-1][0], at)
        length += m.end() - at + 1
        dot = _DOT.match(text, m.end())
        if not dot:
            return dots, disguised
        dots.append((m.end(), dot.end()))
        disguised |= not dot["plain"]
        at = dot.end()
    if dots:  # what looked like one more dot is none
        last = dots.pop()
        disguised = any(text[a:b] != "." for a, b in dots) if last else disguised
    return dots, disguised


def _signs(text: str) -> Rewritten:
    """The second transducer."""
    r = Rewritten(text)
    digits_end = -1
    for m in _ANCHOR.finditer(text):
        a, b = m.span()
        if a < r.done:
            continue
        if m["digits"]:
            # spelled digits in a row belong together
            if r.done == digits_end and _BETWEEN.match(text, digits_end, a).end() == a:  # type: ignore[union-attr]
                r.done = a
            else:
                r.copy(a)
            for w in _NUMBERS.finditer(m[0]):
                r.put(_DIGITS[w[0].lower()], a + w.end())
            digits_end = r.done
            continue
        if m["plus"]:
            r.copy(a)
            r.put("+", _PLUS_GAP.match(text, b).end())  # type: ignore[union-attr]
            continue
        bracket = not (m["word_at"] or m["word_dot"] or m["sign"])
        left, right = a, b
        around = text[a - 1 : a], text[b : b + 1]
        if around in (("_", "_"), ("-", "-")):
            left, right = a - 1, b + 1
        elif not (bracket or m["sign"] or (around[0].isspace() and around[1].isspace())):
            continue
        while left > r.done and text[left - 1].isspace():
            left -= 1
        right = _BLANK.match(text, right).end()  # type: ignore[union-attr]
        if left <= 0 or left < r.done or not (text[left - 1].isascii() and text[right : right + 1].isascii() and text[right : right + 1].isalnum()):
            continue
        if m["at"] or m["word_at"] or m["sign"]:
            if not _LOCAL.match(text[left - 1]):
                continue
            dots, disguised = _domain(text, right)
            if (m["sign"] and not (dots and (disguised or b - a < right - left))) or (m["word_at"] and not disguised):
                continue
            r.copy(left)
            r.put("@", right)
            for x, y in dots:
                r.copy(x)
                r.put(".", y)
            if dots:  # the last label isn't looked at for spelled digits
                r.copy(_LABEL.match(text, dots[-1][1]).end())  # type: ignore[union-attr]
        elif text[left - 1].isalnum():
            r.copy(left)
            r.put(".", right)
    return r


def _steps(text: str) -> tuple[str, list[Rewritten]]:
    """The text without disguises, and what led to it."""
    steps, plain = [], text
    if not text.isascii() and not _glyph_set().isdisjoint(text):
        table, r = _glyphs(), Rewritten(text)
        for i, c in enumerate(text):
            if c in table:
                r.copy(i)
                r.put(table[c], i + 1)
        plain = r.text()
        steps.append(r)
    r = _signs(plain)
    if r.at:
        plain = r.text()
        steps.append(r)
    return plain, steps


def _source(steps: list[Rewritten], a: int, b: int) -> tuple[int, int]:
    for r in reversed(steps):
        a, b = r.place(a, b)
    return a, b


def rewrite(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises, and by character of it, where its source begins and ends."""
    plain, steps = _steps(text)
    places = [_source(steps, k, k + 1) for k in range(len(plain))]
    return plain, [a for a, _ in places], [b for _, b in places]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans added from disguises that no plain one of their kind covers wholly), in code points of the text."""
    base = detect(text)
    plain, steps = _steps(text)
    if plain == text:
        return base, []
    added = []
    for kind, a, b in detect(plain):
        a, b = _source(steps, a, b)
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            added.append((kind, a, b))
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with a placeholder for each span; of overlapping ones the union gets the first one's."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < done:
            if b > done:
                done = b
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256, spans (all), n_added by row.

    Null and empty texts have none. Repeated rows are searched row by row. An empty table gives no rows; other columns
    are not looked at. Offsets are code points, ends exclusive.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[] for _ in KINDS]
            sha, spans, more = [], [], []
            for part in parcels(b.column(1)):
                for t in part:
                    base, added = find(t)
                    for k, kind in enumerate(KINDS):
                        n[k].append(sum(s[0] == kind for s in base))
                    sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(base + added))
                    more.append(len(added))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The same rows and columns, the text with <EMAIL>, <IP>, <CARD>, <PHONE> for what was found.

    Null texts stay null and empty ones empty; texts of any length are searched whole, repeated rows each; an empty
    table gives no rows; other columns, whatever their names, are passed on.
    """
    prepared(docs.sparkSession)
    name = docs.select(text_column).columns[0]
    place = next(k for k, c in enumerate(docs.columns) if c == name or c.lower() == name.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = 0
            for part in parcels(b.column(place)):
                some = b.slice(k, len(part))
                k += len(part)
                new = [mask(t, [s for x in find(t) for s in x]) if valid else None for t, valid in zip(part, some.column(place).is_valid().to_pylist(), strict=True)]
                cols = list(some.columns)
                cols[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
        released()

    return docs.mapInArrow(run, docs.schema)
