"""Encoding texts through a memory of their space-led segments.

The split pattern of byte-level BPE always begins a new piece at a space that is followed by another character than
white space, and a line end between two other characters is a piece of its own, so a text's ids are those of its segments
one after the other. Words recur, so most segments are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_LOOSE = re.compile(r" (?:\s|\Z)")
_LOOSE_LINE = re.compile(r"\n(?:(?<=\s\n)|\s|\Z)")
#: Letters or digits and then signs alone: a new piece begins between them.
_TAILED = re.compile(r"([^\W_]+)([^\w\s]+)")
_SPACE = re.compile(r" (?=\S)")

#: Longer segments are encoded anew each time. A memory that holds so many segments becomes the older one and a new one
#: is begun; what is found in the older one comes over, so segments that recur stay and the others go.
LONGEST, MOST = 64, 200_000


class SegmentMemory(dict):
    """Segment without its leading space -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[str], bytes], lead: str):
        super().__init__()
        self.encode, self.lead, self.older = encode, lead, {}
        self.tails = self if not lead else SegmentMemory(encode, "")

    def __missing__(self, segment: str) -> bytes:
        if tailed := _TAILED.fullmatch(segment):
            return self[tailed[1]] + self.tails[tailed[2]]
        if (ids := self.older.get(segment)) is None:
            ids = self.encode(self.lead + segment)
            if len(segment) > LONGEST:
                return ids
        if len(self) >= MOST:
            self.older = dict(self)
            self.clear()
        self[segment] = ids
        return ids


class SegmentEncoder:
    """encode: ids of any text on its own, as bytes."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.first, self.later = SegmentMemory(encode, ""), SegmentMemory(encode, " ")
        self.line_end = encode("\n")

    def line(self, text: str) -> bytes:
        # the part before the first space may be empty: the text then begins with a space
        parts = text.split(" ")
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.later.__getitem__, parts[1:]))

    def __call__(self, text: str) -> bytes:
        """The whole text's ids; an empty text has none."""
        if not text:
            return b""
        if _LOOSE.search(text):
            parts = _SPACE.split(text)
            head = self.first[parts[0]] if parts[0] else b""
            return head + b"".join(map(self.later.__getitem__, parts[1:]))
        if "\n" in text and not _LOOSE_LINE.search(text):
            return self.line_end.join(map(self.line, text.split("\n")))
        return self.line(text)
