"""Rule patterns are written in a linear-time regex dialect.

Texts are searched with RE2, which is of the same family: :func:`to_re2` spells out what RE2 takes
for ASCII (``\\d``, ``\\s``, ``\\w``) and refuses what it would misread. Paths are tested inside
Spark's plans with Java's engine: :func:`to_java`. Classes with set operations, classes in classes
and classes under the flags ``x`` or ``-u`` are worked out as sets of code points and written as
ranges (:mod:`.classes`); those flags then go. Look-around, back-references and possessive repeats do
not exist in the dialect; the ``\\<``, ``\\>`` and ``\\b{...}`` assertions do, but not on both
sides, and are refused as well, so that a pattern that is taken means what it says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from . import classes

_LOOK = re.compile(r"\(\?(?:<?[=!]|>)")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])")
# Named ASCII classes of the rule dialect.
_NAMED_CLASS = {
    "[:alnum:]": "0-9A-Za-z",
    "[:alpha:]": "A-Za-z",
    "[:blank:]": r"\t ",
    "[:cntrl:]": r"\x00-\x1F\x7F",
    "[:digit:]": "0-9",
    "[:graph:]": "!-~",
    "[:lower:]": "a-z",
    "[:print:]": " -~",
    "[:punct:]": r"!-/:-@\[-`{-~",
    "[:space:]": r"\t\n\x0B\f\r ",
    "[:upper:]": "A-Z",
    "[:word:]": "0-9A-Za-z_",
    "[:xdigit:]": "0-9A-Fa-f",
}
# Members of the Unicode classes behind \s and \w, and the ranges outside white space.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NO_SPACE = (
    r"\x{0}-\x{8}\x{E}-\x{1F}!-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
)
_WORD = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{24B6}-\x{24E9}\x{200C}\x{200D}"
_RE2_CLASS = {r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\s": _SPACE, r"\S": _NO_SPACE, r"\w": _WORD}


class PatternError(ValueError):
    """The pattern is not valid in the rule dialect."""


@dataclass(frozen=True)
class _Flags:
    """The flags that the scan itself acts upon; the engines see to the others."""

    i: bool = False
    x: bool = False
    u: bool = True


@dataclass(frozen=True)
class _Token:
    """A piece of a pattern: text as it stands, in a plain class or not, or a class as a set."""

    text: str
    inside: bool = False
    ranges: classes.Ranges | None = None
    flags: _Flags = _Flags()


def _plain_class(pattern: str, start: int) -> int | None:
    """Where the class that opens at ``start`` ends, if engines read it alike; None if it must be worked out."""
    at = start + 1 + pattern.startswith("^", start + 1)
    at += pattern.startswith("]", at)
    while at < len(pattern):
        named = next((n for n in _NAMED_CLASS if pattern.startswith(n, at)), None)
        if named:
            at += len(named)
        elif pattern[at] == "[" or pattern[at : at + 2] in ("&&", "--", "~~", r"\W"):
            return None
        elif pattern[at] == "]":
            return at + 1
        else:
            at += len(_escape(pattern, at)) if pattern[at] == "\\" else 1
    return None


def _escape(pattern: str, at: int) -> str:
    braced = re.compile(r"\\[pPx]\{[^}]*\}").match(pattern, at)
    return braced[0] if braced else pattern[at : at + 2]


def _plain_tokens(text: str) -> Iterator[_Token]:
    """The pieces of a plain class from its bracket to the other one."""
    head = re.match(r"\[\^?\]?", text)[0]
    yield _Token("[")
    for char in head[1:]:
        yield _Token("\\]" if char == "]" else char, True)
    at = len(head)
    while at < len(text) - 1:
        named = next((n for n in _NAMED_CLASS if text.startswith(n, at)), None)
        token = named or (_escape(text, at) if text[at] == "\\" else text[at])
        yield _Token(token, True)
        at += len(token)
    yield _Token("]", True)


def _scan(pattern: str) -> Iterator[_Token]:
    """The pieces of a pattern; flags that engines don't share are acted upon and left out."""
    at, flags, outer = 0, _Flags(), []
    while at < len(pattern):
        char = pattern[at]
        if flags.x and char.isspace():
            at += 1
        elif flags.x and char == "#":
            end = pattern.find("\n", at)
            at = len(pattern) if end < 0 else end + 1
        elif char == "[":
            end = _plain_class(pattern, at) if flags.u and not flags.x else None
            if end:
                yield from _plain_tokens(pattern[at:end])
                at = end
            else:
                ranges, at = classes.parse(pattern, at, flags.i, flags.x, flags.u)
                yield _Token("[]", False, ranges, flags)
        elif char == "\\":
            token = _escape(pattern, at)
            yield _Token(token, flags=flags)
            at += len(token)
        elif char == "(":
            setting = _FLAGS.match(pattern, at)
            if _LOOK.match(pattern, at):
                raise PatternError(f"look-around is not supported: {pattern}")
            if not setting:
                outer.append(flags)
                yield _Token("(")
                at += 1
                continue
            on, off = setting[1], setting[2] or ""
            if set(on + off) - set("imsUxu"):
                raise PatternError(f"a flag of {setting[0]} is not supported: {pattern}")
            if setting[3] == ":":
                outer.append(flags)
            for f in "ixu":
                flags = replace(flags, **{f: f in on or f not in off and getattr(flags, f)})
            on, off = ("".join(c for c in part if c not in "xu") for part in (on, off))
            if on or off or setting[3] == ":":
                yield _Token(f"(?{on}{'-' * bool(off)}{off}{setting[3]}")
            at = setting.end()
        else:
            if char == ")" and outer:
                flags = outer.pop()
            yield _Token(char, flags=flags)
            at += 1


def _checked(pattern: str) -> list[_Token]:
    """The pattern's pieces, once it holds nothing that an engine would misread."""
    try:
        tokens = list(_scan(pattern))
    except classes.ClassError as e:
        raise PatternError(f"{e}: {pattern}") from None
    previous = ""
    for at, token in enumerate(tokens):
        text, following = token.text, tokens[at + 1].text if at + 1 < len(tokens) else ""
        if token.inside:
            previous = ""
            continue
        if text[0] == "\\" and text[1:].isdigit() or text == "\\k":
            raise PatternError(f"backreferences are not supported: {pattern}")
        if text in ("\\<", "\\>", "\\C", "\\Q", "\\E") or text == "\\b" and following == "{":
            raise PatternError(f"{text}{following if text == '\\b' else ''} is not supported: {pattern}")
        if text == "+" and previous in ("*", "+", "?", "}"):
            raise PatternError(f"possessive repeats are not supported: {pattern}")
        if not token.flags.u and (text in (".", r"\D", r"\S", r"\W") or token.ranges and token.ranges[-1][1] > 0x7F):
            raise PatternError(f"without Unicode, {'a class' if token.ranges else text} would match parts of characters: {pattern}")
        previous = text
    return tokens


def _spelt(token: _Token) -> str | None:
    """Pieces that no engine is left to read by its own rules; None for all others."""
    if token.ranges is not None:
        text = classes.written(token.ranges)
    elif token.inside or token.flags.u:
        return None
    elif token.text in (r"\d", r"\s", r"\w"):
        text = classes.written(classes.letter(token.text[1], unicode=False))
    elif token.flags.i and len(token.text) == 1 and (token.text in "kKsS" or not token.text.isascii()):
        text = classes.written(classes.folded(((ord(token.text),) * 2,), unicode=False))
    else:
        return None
    # Cases are in the set already; without Unicode, an engine would add some that don't belong.
    return f"(?-i:{text})" if token.flags.i else text


def _code_points(pattern: str) -> str:
    """Escapes of a code point by four or eight digits in the form that both engines have."""
    return re.sub(
        r"(\\\\)|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\[uU](\{[0-9A-Fa-f]+\})",
        lambda m: m[1] or (rf"\x{m[4]}" if m[4] else rf"\x{{{(m[2] or m[3])}}}"),
        pattern,
    )


def to_re2(pattern: str) -> str:
    """The same pattern for RE2. Word boundaries go by ASCII words there."""
    out = []
    for token in _checked(_code_points(pattern)):
        text, spelt = token.text, _spelt(token)
        if spelt is not None:
            out.append(spelt)
        elif text == r"\W":
            out.append(f"[^{_WORD}]")
        elif text in _RE2_CLASS:
            out.append(_RE2_CLASS[text] if token.inside else f"[{_RE2_CLASS[text]}]")
        elif token.inside:
            out.append(_NAMED_CLASS.get(text, text))
        else:
            out.append(text)
    return "".join(out)


def to_java(pattern: str) -> str:
    """The same pattern for ``java.util.regex``, for paths.

    Java is told to be Unicode-aware (``U``), to treat only a line feed as a line end (``d``), and
    to let ``$`` mean the very end of the text.
    """
    tokens = _checked(_code_points(pattern))
    flags = "".join(on for on, *_ in _FLAGS.findall("".join(t.text for t in tokens if not t.inside)))
    if "U" in flags:
        raise PatternError(f"swapped greed is not supported for paths: {pattern}")
    out = []
    for token in tokens:
        text, spelt = token.text, _spelt(token)
        if spelt is not None:
            out.append(spelt)
        elif token.inside:
            out.append(_NAMED_CLASS.get(text, text))
        elif text == "$" and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(text)
    return "(?Ud)" + "".join(out).replace("(?P<", "(?<")
