"""Cutting a text into units that a byte-level splitter never joins.

The splitter of byte-level vocabularies cuts a text with the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and encodes each piece alone.  ``UNIT`` cuts only where that pattern cuts whatever the
Unicode version of its tables: around runs of Latin letters that end before an ASCII
non-letter, around a single line break between other characters, around ASCII symbol runs
that end before an ASCII letter, digit or space, and before a single space between other
characters.  A text is the concatenation of its units, and its ids are the concatenation
of the units' ids, so ids can be remembered per unit.
"""

from __future__ import annotations

import re

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
UNIT = re.compile(
    rf" ?[{LATIN}]+(?=[\x00-@\[-`{{-\x7f]|\Z)"
    r"|(?<=\S)\n(?=\S)"
    r"| ?[!-&(-/:-@\[-`{-~]+(?=[A-Za-z0-9 \t-\r]|\Z)"
    r"|(?s:.)(?:[^ ]|(?<=\s) | (?!\S))*"
)

#: Entries and longest unit that a worker remembers; longer units are encoded each time.
MEMO_ENTRIES = 1 << 19
MEMO_UNIT = 64


class Memo(dict):
    """unit -> value, computed when missing, emptied when full (bounded memory)."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, unit):
        value = self.compute(unit)
        if len(unit) <= MEMO_UNIT:
            if len(self) >= self.entries:
                self.clear()
            self[unit] = value
        return value


def special_pattern(contents) -> re.Pattern | None:
    """Pattern of the special strings that a vocabulary takes out of a text before anything else."""
    found = sorted(contents, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
