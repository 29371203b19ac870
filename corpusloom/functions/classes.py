"""Character classes of the rule dialect as sets of code points.

A class is parsed to a tree of unions, nested classes, negations and the operations ``&&``
(intersection), ``--`` (difference) and ``~~`` (symmetric difference), worked out as a set of
intervals, and written out as ranges, which every engine reads alike. Operations are taken from left
to right and bind less than putting items next to each other. Under ``(?i)`` every item takes the
other cases of its characters in before it is negated or combined.

This runs on the driver, once per pattern.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterable

import regex

LAST = sys.maxunicode
_SURROGATES = ((0xD800, 0xDFFF),)

# Named ASCII classes of the rule dialect.
NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\x00-\x7f", "blank": "\t ", "cntrl": "\x00-\x1f\x7f",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@[-`{-~",
    "space": "\t-\r ", "upper": "A-Z", "word": "0-9A-Z_a-z", "xdigit": "0-9A-Fa-f",
}
# What the one-letter classes stand for, by Unicode and by ASCII.
LETTERS = {"d": r"\p{Nd}", "s": r"\p{White_Space}", "w": r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"}
ASCII_LETTERS = {"d": "digit", "s": "space", "w": "word"}
# Escapes of control characters.
CONTROLS = {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}

Ranges = tuple[tuple[int, int], ...]


class ClassError(ValueError):
    """Not a class of the rule dialect."""


def union(ranges: Iterable[tuple[int, int]]) -> Ranges:
    """Sorted, apart and not touching."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return tuple(out)


def complement(ranges: Ranges) -> Ranges:
    """All other code points, but for the surrogates, which are no characters."""
    out, at = [], 0
    for low, high in union((*ranges, *_SURROGATES)):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    return tuple(out) if at > LAST else (*out, (at, LAST))


def intersection(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        low, high = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if low <= high:
            out.append((low, high))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def difference(a: Ranges, b: Ranges) -> Ranges:
    return intersection(a, complement(b))


def either(a: Ranges, b: Ranges) -> Ranges:
    """What is in one of them only."""
    return difference(union((*a, *b)), intersection(a, b))


def _runs(points: Iterable[int]) -> Ranges:
    return union((p, p) for p in points)


@functools.cache
def matched(pattern: str) -> Ranges:
    """Every character that a one-character pattern (a property) matches."""
    try:
        test = regex.compile(pattern)
    except regex.error as e:
        raise ClassError(f"{e}: {pattern}") from None
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, LAST + 1))))
    return _runs(ord(c) for c in test.findall(everything))


@functools.cache
def _cases() -> dict[int, tuple[int, ...]]:
    """Other characters of the same case folding, for characters that have any."""
    groups: dict[str, list[int]] = {}
    for point in (*range(0xD800), *range(0xE000, LAST + 1)):
        char = chr(point)
        folded = char.casefold()
        if len(folded) > 1:
            folded = char.lower()
        if folded != char or char.upper() != char:
            groups.setdefault(folded, []).append(point)
    for folded in list(groups):
        if len(folded) == 1 and ord(folded) not in groups[folded]:
            groups[folded].append(ord(folded))
    return {p: tuple(group) for group in groups.values() for p in group if len(group) > 1}


def folded(ranges: Ranges, unicode: bool = True) -> Ranges:
    """With all cases of its characters."""
    if not unicode:
        both = [(a ^ 32, b ^ 32) for a, b in (*intersection(ranges, ((65, 90),)), *intersection(ranges, ((97, 122),)))]
        return union((*ranges, *both))
    cases = _cases()
    more = [q for low, high in ranges for p in (range(low, high + 1) if high - low < len(cases) else (c for c in cases if low <= c <= high)) for q in cases.get(p, ())]
    return union((*ranges, *((q, q) for q in more)))


def named(name: str) -> Ranges:
    """A class between ``[:`` and ``:]``."""
    inverse = name.startswith("^")
    body = NAMED.get(name.removeprefix("^"))
    if body is None:
        raise ClassError(f"there is no class [:{name}:]")
    out, i = [], 0
    while i < len(body):
        span = 3 if body[i + 1 : i + 2] == "-" and i + 2 < len(body) else 1
        out.append((ord(body[i]), ord(body[i + span - 1])))
        i += span
    ranges = union(out)
    return complement(ranges) if inverse else ranges


def letter(char: str, unicode: bool = True) -> Ranges:
    """What ``\\d``, ``\\s``, ``\\w`` or an upper-case one matches."""
    base = matched(LETTERS[char.lower()]) if unicode else named(ASCII_LETTERS[char.lower()])
    return complement(base) if char.isupper() else base


def escape(text: str, at: int) -> tuple[int, int] | None:
    """The code point that the backslash at ``at`` stands for, and where it ends; None if it is no character."""
    rest = text[at + 1 :]
    braced = re.match(r"[xuU]\{\s*([0-9A-Fa-f]+)\s*\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})", rest)
    if braced:
        point = int(next(g for g in braced.groups() if g), 16)
        if point > LAST or 0xD800 <= point <= 0xDFFF:
            raise ClassError(f"no character has this number: \\{braced[0]}")
        return point, at + 1 + braced.end()
    if rest[:1] in CONTROLS:
        return ord(CONTROLS[rest[0]]), at + 2
    if rest and (not rest[0].isalnum() or not rest[0].isascii()) and rest[0] not in "<>":
        return ord(rest[0]), at + 2
    return None


class _Parser:
    def __init__(self, text: str, at: int, fold: bool, blank: bool, unicode: bool):
        self.text, self.at, self.fold, self.blank, self.unicode = text, at, fold, blank, unicode

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def skip(self) -> None:
        """White space and comments, under the flag ``x``."""
        while self.blank and self.peek():
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            else:
                break

    def ready(self, ranges: Ranges) -> Ranges:
        return folded(ranges, self.unicode) if self.fold else ranges

    def char(self) -> int | None:
        """One character, plain or escaped; None (and nothing read) before a class."""
        if self.peek() == "\\":
            found = escape(self.text, self.at)
            if found:
                self.at = found[1]
                return found[0]
            return None
        self.at += 1
        return ord(self.text[self.at - 1])

    def special(self) -> Ranges:
        """A class that is written with a backslash."""
        prop = re.compile(r"\\([pP])(?:\{(\^?)([^}]*)\}|(\w))").match(self.text, self.at)
        if prop:
            self.at = prop.end()
            ranges = matched(rf"\p{{{(prop[3] or prop[4]).strip()}}}")
            return complement(ranges) if (prop[1] == "P") != bool(prop[2]) else ranges
        if self.peek(2)[1:] and self.peek(2)[1] in "dDsSwW":
            self.at += 2
            return letter(self.text[self.at - 1], self.unicode)
        raise ClassError(f"{self.peek(2)} is no member of a class")

    def item(self) -> Ranges:
        """A range, a character or a class in a class."""
        if self.peek() == "[":
            inner = re.compile(r"\[:(\^?[a-z]+):\]").match(self.text, self.at)
            if inner:
                self.at = inner.end()
                return self.ready(named(inner[1]))
            return self.bracketed()
        low = self.char()
        if low is None:
            return self.ready(self.special())
        self.skip()
        if self.peek() == "-" and self.peek(2) != "--" and self.peek(2) != "-]":
            self.at += 1
            self.skip()
            high = self.char() if self.peek() not in ("", "[") else None
            if high is None or high < low:
                raise ClassError("a range runs backwards or has no end")
            return self.ready(union([(low, high)]))
        return self.ready(((low, low),))

    def bracketed(self) -> Ranges:
        """A class from ``[`` to its ``]``."""
        self.at += 1
        self.skip()
        negated = self.peek() == "^"
        self.at += negated
        self.skip()
        items: list[tuple[int, int]] = []
        while self.peek() == "-":  # hyphens that come first are plain
            items.append((45, 45))
            self.at += 1
            self.skip()
        if self.peek() == "]" and not items:  # as is a bracket
            items.append((93, 93))
            self.at += 1
        held, operation = None, None

        def combined() -> Ranges:
            right = union(items)
            return right if operation is None else operation(held, self.ready(right))

        while True:
            self.skip()
            if not self.peek():
                raise ClassError("a class isn't closed")
            if self.peek() == "]":
                self.at += 1
                break
            follows = {"&&": intersection, "--": difference, "~~": either}.get(self.peek(2))
            if follows:
                held, operation, items = combined(), follows, []
                self.at += 2
                continue
            items += self.item()
        out = combined()
        return complement(self.ready(out)) if negated else out


def parse(text: str, at: int, fold: bool = False, blank: bool = False, unicode: bool = True) -> tuple[Ranges, int]:
    """The set of the class that opens at ``at``, and where it ends."""
    parser = _Parser(text, at, fold, blank, unicode)
    return parser.bracketed(), parser.at


def written(ranges: Ranges) -> str:
    """A class of ranges by number, for RE2 and Java alike."""
    if not ranges:
        return r"[^\x{0}-\x{10FFFF}]"
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
