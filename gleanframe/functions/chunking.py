"""Boundary-aware chunking as one native expression per document.

A text longer than ``size`` is cut window by window.  Each window of at most ``size``
characters ends after its last paragraph break; without one, after its last newline;
without one, after its last sentence end; otherwise it is kept whole.  Cutting is
sequential inside a document and independent across documents, so it is a fold over
the document's own text: no shuffle, no Python, no lookups.

Windows are read from fixed-length blocks of the text instead of from the whole text, and
the list of ends grows in segments, so the cost is linear in the document's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.lambdas import bind
from gleanframe.functions.text import SPACE

# What counts as a break, strongest first.
PARAGRAPH_BREAK = rf"\n{SPACE}*\n"
LINE_BREAK = "\n"
SENTENCE_END = rf"[.!?](?:{SPACE}|\z)"

# A text yields at most 4 chunks per full window: ends inside one window fall in break
# strength, so three can be early before one passes the window's end.
CHUNKS_PER_WINDOW = 4
# Ends collected per inner fold before they are appended to the outer list.
SEGMENT = 64
# Texts up to this length are sliced directly, longer ones through blocks.
BLOCK = 16384

BOUNDS_TYPE = "array<struct<chunknumber:int,start:int,end:int>>"


def blocks_of(text: Column, length: int) -> Column:
    """The text as an array of ``length``-character blocks, in one linear pass.

    The possessive quantifier keeps the matcher iterative on any mix of characters.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}+"), F.lit(0))


def break_length(window: Column, has_paragraphs: Column) -> Column:
    """Length of the window up to and including its preferred break."""

    def up_to_last(pattern: str) -> Column:
        return F.length(F.regexp_extract(window, f"(?s)\\A(.*{pattern})", 1))

    whole = F.length(window)
    return F.coalesce(
        F.when(has_paragraphs, F.nullif(up_to_last(PARAGRAPH_BREAK), F.lit(0))),
        F.when(
            F.contains(window, F.lit(LINE_BREAK)),
            whole - F.length(F.substring_index(window, LINE_BREAK, -1)),
        ),
        F.nullif(up_to_last(SENTENCE_END), F.lit(0)),
        whole,
    )


def _chunk_ends(text: Column, length: Column, size: int) -> Column:
    """End positions of the chunks of a text longer than ``size``."""

    def ends(doc: Column) -> Column:
        n, blocks, paragraphs = doc["n"], doc["blocks"], doc["paragraphs"]

        def window_at(pos: Column) -> Column:
            block = F.floor(pos / F.lit(size)).cast("int")
            pair = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
            return F.substring(pair, pos - block * size + 1, F.lit(size))

        def cut(positions: Column, pos: Column) -> Column:
            kept = bind(window_at(pos), lambda w: break_length(w, paragraphs))
            return F.concat(positions, F.array(pos + kept))

        def cut_until_end(positions: Column) -> Column:
            pos = F.element_at(positions, -1)
            return F.when(pos >= n, positions).otherwise(cut(positions, pos))

        def segment(segments: Column) -> Column:
            # A segment starts with the position it continues from.
            pos = F.coalesce(
                F.element_at(F.try_element_at(segments, F.lit(-1)), F.lit(-1)), F.lit(0)
            )
            return F.when(pos >= n, segments).otherwise(
                F.aggregate(
                    F.sequence(F.lit(1), F.least(most, F.lit(SEGMENT))),
                    F.array(pos),
                    lambda positions, _: cut_until_end(positions),
                    lambda positions: F.concat(segments, F.array(positions)),
                )
            )

        most = (CHUNKS_PER_WINDOW * F.ceil(n / F.lit(size))).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), F.ceil(most / F.lit(SEGMENT)).cast("int")),
            F.array().cast("array<array<int>>"),
            lambda segments, _: segment(segments),
            lambda segments: F.flatten(
                F.transform(segments, lambda s: F.slice(s, F.lit(2), F.size(s)))
            ),
        )

    doc = F.struct(
        length.alias("n"),
        blocks_of(text, size).alias("blocks"),
        F.regexp_like(text, F.lit(PARAGRAPH_BREAK)).alias("paragraphs"),
    )
    return bind(doc, ends)


def chunk_bounds(text: Column, size: int) -> Column:
    """Half-open ranges that tile the text, numbered from 0; none for an empty text."""
    if not isinstance(size, int) or size <= 0:
        raise ValueError("chunk size must be a positive integer")
    length = F.length(text)
    ends = (
        F.when(length.isNull() | (length == 0), F.array().cast("array<int>"))
        .when(length <= size, F.array(length))
        .otherwise(_chunk_ends(text, length, size))
    )
    return bind(
        ends,
        lambda all_ends: F.transform(
            all_ends,
            lambda end, i: F.struct(
                i.alias("chunknumber"),
                F.coalesce(F.get(all_ends, i - 1), F.lit(0)).alias("start"),
                end.alias("end"),
            ),
        ),
    )


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``: a range past the end gives a shorter or empty text."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def slice_all(text: Column, bounds: Column, carry: Sequence[str] = ()) -> Column:
    """Attach the text of every range in ``bounds``; linear in the text's length.

    Fields of a bound named in ``carry`` are kept beside its text.
    """

    def with_text(bound: Column, sliced: Column) -> Column:
        return F.struct(
            bound["chunknumber"].alias("chunknumber"),
            bound["start"].alias("start"),
            bound["end"].alias("end"),
            sliced.alias("chunk_text"),
            *[bound[name].alias(name) for name in carry],
        )

    def from_blocks(blocks: Column, bound: Column) -> Column:
        first = F.floor(bound["start"] / F.lit(BLOCK)).cast("int")
        last = F.floor(bound["end"] / F.lit(BLOCK)).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        offset = bound["start"] - first * BLOCK
        return slice_text(part, offset, offset + bound["end"] - bound["start"])

    def sliced(ranges: Column) -> Column:
        direct = F.transform(ranges, lambda b: with_text(b, slice_text(text, b["start"], b["end"])))
        blocked = bind(
            blocks_of(text, BLOCK),
            lambda blocks: F.transform(ranges, lambda b: with_text(b, from_blocks(blocks, b))),
        )
        return F.when(F.length(text) <= BLOCK * 4, direct).otherwise(blocked)

    return bind(bounds, sliced)
