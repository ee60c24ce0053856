"""Where chunks may end, as sorted positions: a text is read once for any number of sizes.

The rules are those of :mod:`gleanframe.functions.chunking`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# White space as code points, the Unicode class and U+001C to U+001F.
SPACES = np.array(
    [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    np.uint32,
)
NEWLINE = 10
SENTENCE = np.array([ord(c) for c in ".!?"], np.uint32)


class Breaks(NamedTuple):
    """Ends of breaks with the beginning that a window must hold, and sentence marks by place."""

    paragraph_ends: np.ndarray
    paragraph_starts: np.ndarray
    line_ends: np.ndarray
    sentence_ends: np.ndarray
    marks: np.ndarray

    @property
    def length(self) -> int:
        return len(self.marks)


def breaks(text: str) -> Breaks:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.isin(codes, SPACES)
    marks = np.isin(codes, SENTENCE)
    lines = np.flatnonzero(codes == NEWLINE)
    solid = np.concatenate([[0], np.cumsum(~space)])
    # Two newlines with nothing but white space between them.
    blank = np.flatnonzero(solid[lines[1:]] == solid[lines[:-1]]) if len(lines) else lines
    ends = np.flatnonzero(marks[:-1] & space[1:]) + 2
    return Breaks(lines[blank + 1] + 1, lines[blank], lines + 1, ends, marks)


def next_cuts(index: Breaks, starts: np.ndarray, size: int) -> np.ndarray:
    """The end of the chunk that begins at each of ``starts``; all are inside the text."""
    limit = np.minimum(starts + size, index.length)
    cut = limit.copy()

    def last(ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last end up to the window's and whether it begins inside the window."""
        at = np.searchsorted(ends, limit, side="right") - 1
        some = at >= 0
        at = np.maximum(at, 0)
        return ends[at], some & (begins[at] >= starts)

    # From the weakest break to the strongest, each over the one before.
    for ends, begins in (
        (index.sentence_ends, index.sentence_ends - 2),
        (index.line_ends, index.line_ends - 1),
        (index.paragraph_ends, index.paragraph_starts),
    ):
        if len(ends):
            end, holds = last(ends, begins)
            if ends is index.sentence_ends:
                # A mark at the window's very end is an end too.
                holds &= ~index.marks[limit - 1]
            cut = np.where(holds, end, cut)
    return cut


def cuts(index: Breaks, size: int) -> list[int]:
    """The ends of all chunks of the text, one after the other."""
    if index.length <= size:
        return [index.length] if index.length else []
    ends, at = [], 0
    while at < index.length:
        at = int(next_cuts(index, np.array([at]), size)[0])
        ends.append(at)
    return ends


def jumps(index: Breaks, size: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start before ``stop`` where its chain of chunks first reaches ``stop``, and the chunks till then.

    Chains are followed by pointer doubling, all at a time.
    """
    after = next_cuts(index, np.arange(stop), size)
    count = np.ones(stop, np.int64)
    while True:
        going = np.flatnonzero(after < stop)
        if not len(going):
            return after, count
        count[going] += count[after[going]]
        after[going] = after[after[going]]
