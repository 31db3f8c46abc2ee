"""Protected blocks of a text (fences, archived text), found from opening to closing mark by two searches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Where str.splitlines ends lines, \r\n being one end.
ENDS = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
LINE = rf"(?:(?<=[{ENDS}])(?<!\r(?=\n))|\A)"
BLANK = rf"[^\S{ENDS}]*"
END = rf"(?:\r\n|[{ENDS}]|\Z)"
FENCE = rf"{LINE} {{0,3}}(?P<fence>`{{3,}}(?![^{ENDS}]*`)|~{{3,}})"
REST = rf"[^{ENDS}]*{END}"


@dataclass(frozen=True)
class Grammar:
    """``archive``: how an archived text begins and ends, the name in place of {}; ``fence_end``: how a closing fence's line
    may end."""

    begin: str
    end: str
    fence_end: str

    def opening(self) -> re.Pattern:
        return re.compile(rf"(?:{self.begin}|{FENCE})")

    def closing(self, mark: re.Match) -> re.Pattern:
        if name := mark["name"]:
            return re.compile(self.end.format(re.escape(name)))
        fence = mark["fence"]
        return re.compile(rf"{LINE} {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*{self.fence_end}")


#: The reader wants archive marks on lines of their own; the writer takes them anywhere in a line.
READER = Grammar(
    rf"{LINE}{BLANK}<!-- ARCHIVED_TEXT_BEGIN (?P<name>\S+) -->{BLANK}{END}",
    rf"{LINE}{BLANK}<!-- ARCHIVED_TEXT_END {{}} -->{BLANK}{END}",
    r"(?:\r\n|[\n\r]|\Z)",
)
WRITER = Grammar(rf"{LINE}[^{ENDS}]*?<!-- ARCHIVED_TEXT_BEGIN (?P<name>\S+) -->{REST}", rf"<!-- ARCHIVED_TEXT_END {{}} -->{REST}", r"(?:\n|\Z)")
_OPENING = {g: g.opening() for g in (READER, WRITER)}


def protected(text: str, grammar: Grammar) -> Iterator[tuple[int, int, bool]]:
    """(start, end, closed) of the blocks, whole lines; what is left open reaches to the end."""
    at = 0
    while mark := _OPENING[grammar].search(text, at):
        shut = grammar.closing(mark).search(text, mark.end())
        at = shut.end() if shut else len(text)
        yield mark.start(), at, shut is not None
        if shut is None:
            return


def outside(text: str, spans: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between the blocks."""
    at = 0
    for a, b, _ in [*spans, (len(text), len(text), True)]:
        if a > at:
            yield at, a
        at = b
