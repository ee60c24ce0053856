"""Text expressions: whitespace rules, newline normalisation, excerpts.

Positions are code points throughout.  Java's ``\\s`` is ASCII only, so the Unicode
white space class is spelled out and used in every pattern of the package.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a Java regex class body.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_CLASS}]"
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space becomes one space, ends stripped."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``, as a text-mode read does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def log_excerpt(message: Column, length: int) -> Column:
    """First ``length`` characters plus a note of how much was left out."""
    if length <= 0:
        raise ValueError("excerpt length must be positive")
    size = F.length(message)
    note = F.concat(
        F.substring(message, 1, length),
        F.lit(f"\n...\n(first {length} out of "),
        size.cast("string"),
        F.lit(" characters shown)\n"),
    )
    return F.when(size > length, note).otherwise(message)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")
