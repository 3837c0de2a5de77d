"""Rewriting Python regular expressions for the engine's Java dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass
# Widths of groups tell empty from absent ones; without this module the import fails, as results would change.
from re import _parser as _regex_parser

from ..errors import StudyError

# Only "\n" ends a line, as in Python.
_LINES = "(?d)"
# Unicode word characters and case folding, where a pattern has any: they are slow.
_UNICODE = "(?Ud)"
# The characters Python counts as white space. Single ones come first,
# as Java looks those up in one table.
_SPACES = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\p{Z}"
_ASCII_FLAG = re.compile(r"\(\?[iLmsux]*a")
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


@dataclass(frozen=True)
class JavaPattern:
    """``groups`` maps the named groups to their numbers. ``nonempty`` are those that
    cannot match empty text, ``optional`` those of them that may take no part."""

    pattern: str
    groups: dict[str, int]
    nonempty: frozenset[str]
    optional: frozenset[str]


def to_java(pattern: str) -> JavaPattern:
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise StudyError(f"bad pattern {pattern!r}: {error}") from None
    if compiled.flags & re.VERBOSE:
        raise StudyError("verbose patterns are not supported")
    nonempty, optional = _group_facts(pattern, dict(compiled.groupindex))
    rewriter = _Rewriter(pattern, compiled.groupindex)
    body = rewriter.run()
    return JavaPattern((_UNICODE if rewriter.unicode else _LINES) + body, dict(compiled.groupindex), nonempty, optional)


def _group_facts(pattern: str, groups: dict[str, int]) -> tuple[frozenset[str], frozenset[str]]:
    if _regex_parser is None:
        return frozenset(), frozenset()
    names = {number: name for name, number in groups.items()}
    nonempty, optional = set(), set()

    def visit(items, may_skip: bool) -> None:
        for op, arg in items:
            kind = str(op)
            if kind == "SUBPATTERN":
                number, inner = arg[0], arg[-1]
                if number in names and inner.getwidth()[0] > 0:
                    nonempty.add(names[number])
                    if may_skip:
                        optional.add(names[number])
                visit(inner, may_skip)
            elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                visit(arg[2], may_skip or arg[0] == 0)
            elif kind == "BRANCH":
                for branch in arg[1]:
                    visit(branch, True)
            elif kind in ("ASSERT", "ASSERT_NOT"):
                visit(arg[1], may_skip or kind == "ASSERT_NOT")
            elif kind == "ATOMIC_GROUP":
                visit(arg, may_skip)

    visit(_regex_parser.parse(pattern), False)
    return frozenset(nonempty), frozenset(optional)


class _Rewriter:
    """Walks a valid Python pattern and spells the differing parts the Java way."""

    def __init__(self, pattern: str, groups):
        self.pattern, self.groups, self.at = pattern, groups, 0
        # Classes that change their meaning within the pattern are left to the flags.
        self.flagged = bool(_ASCII_FLAG.search(pattern))
        self.unicode = self.flagged

    def run(self) -> str:
        out = []
        while self.at < len(self.pattern):
            char = self.pattern[self.at]
            if char == "\\":
                out.append(self.escape(in_class=False))
            elif char == "[":
                out.append(self.char_class())
            elif char == "(":
                out.append(self.opening())
            elif char == "{":
                out.append(self.brace())
            else:
                out.append(char)
                self.at += 1
        return "".join(out)

    def take(self, length: int) -> str:
        text = self.pattern[self.at : self.at + length]
        self.at += length
        return text

    def escape(self, in_class: bool) -> str:
        rest = self.pattern[self.at + 1 :]
        char = rest[0]
        if char == "Z" and not in_class:
            self.take(2)
            return r"\z"
        if char == "v":
            self.take(2)
            return r"\x0b"
        if char == "b" and in_class:
            self.take(2)
            return r"\x08"
        if char in "wWbB" and not (char == "b" and in_class):
            self.unicode = True
        elif char in "sd" and not self.flagged:
            self.take(2)
            plain = _SPACES if char == "s" else r"\p{Nd}"
            return plain if in_class or char == "d" else f"[{plain}]"
        elif char in "SD" and not self.flagged:
            self.take(2)
            return rf"[^{_SPACES}]" if char == "S" else r"\P{Nd}"
        if char == "U":
            return r"\x{" + self.take(10)[2:] + "}"
        octal = re.match(r"0[0-7]{0,2}|[1-3][0-7]{2}", rest)
        if octal and (char == "0" or in_class or len(octal[0]) == 3):
            self.take(1 + len(octal[0]))
            return r"\x{%x}" % int(octal[0], 8)
        number = re.match(r"[1-9]\d?", rest)
        if number and not in_class:
            self.take(1 + len(number[0]))
            return rf"(?:\{number[0]})"
        return self.take(2)

    def char_class(self) -> str:
        out = [self.take(1)]
        if self.pattern[self.at] == "^":
            out.append(self.take(1))
        first = True
        while first or self.pattern[self.at] != "]":
            first = False
            char = self.pattern[self.at]
            if char == "\\":
                out.append(self.escape(in_class=True))
            elif char in "[]&^":
                # Plain characters in Python; sets and intersections in Java.
                out.append("\\" + self.take(1))
            else:
                out.append(self.take(1))
        return "".join(out) + self.take(1)

    def opening(self) -> str:
        rest = self.pattern[self.at :]
        if rest.startswith("(?P<"):
            self.at += rest.index(">") + 1
            return "("
        if rest.startswith("(?P="):
            name = rest[4 : rest.index(")")]
            self.at += len(name) + 5
            return rf"(?:\{self.groups[name]})"
        if rest.startswith("(?#"):
            self.at += rest.index(")") + 1
            return ""
        if rest.startswith("(?("):
            raise StudyError("conditional groups are not supported in patterns")
        flags = re.match(r"\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])", rest)
        if flags and (flags[1] or flags[2]):
            self.at += len(flags[0])
            self.unicode = self.unicode or "i" in flags[1]
            turned_on = flags[1].replace("u", "").replace("a", "")
            turned_off = ("U" if "a" in flags[1] else "") + (flags[2] or "")
            if not turned_on and not turned_off:
                return "(?:" if flags[3] == ":" else ""
            return f"(?{turned_on}{'-' if turned_off else ''}{turned_off}{flags[3]}"
        return self.take(1)

    def brace(self) -> str:
        quantifier = _QUANTIFIER.match(self.pattern, self.at)
        if quantifier and (quantifier[1] or quantifier[2]):
            self.at = quantifier.end()
            return f"{{{quantifier[1] or 0}{quantifier[2]}{quantifier[3]}}}"
        return "\\" + self.take(1)
