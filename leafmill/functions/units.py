"""Lines and units of normalised texts in batches of strings, as functions.text has them as columns."""

from __future__ import annotations

import re

from . import text as T

_NUMBERED = re.compile(rf"\d+(?:\.\d+)*[{T.SPACE}]+[^{T.SPACE}]")
_SMALL, _CAPITAL = re.compile("[a-z]"), re.compile("[A-Z]")
_END = re.compile(rf"(?<=[.!?])[{T.SPACE}]+")


def lines(text: str) -> list[str]:
    """Without white space at both ends, those that are blank left out."""
    return [x for line in text.split("\n") if (x := line.strip(T.SPACES))]


def is_heading(line: str) -> bool:
    """Of one of lines()."""
    if line[-1] == ":" and len(line) <= 80:
        return True
    if _SMALL.search(line) is None and len(_CAPITAL.findall(line)) >= 6:
        return True
    return line[0].isdecimal() and _NUMBERED.match(line) is not None


def units(text: str) -> list[str]:
    """Headings, and the sentences of every other line."""
    found: list[str] = []
    for line in lines(text):
        if is_heading(line):
            found.append(line)
        else:
            found += [x for part in _END.split(line) if (x := part.strip(T.SPACES))]
    return found
