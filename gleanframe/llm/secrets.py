"""Secret scan: keyword automaton, anchored regular expressions near hits, checksums.

One Aho-Corasick pass per text finds every place where a secret can begin; a regular
expression is tried only there, anchored; and kinds that carry a checksum are kept only
if it holds.  Map-only, so nothing is shuffled and memory follows one batch of texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import map_batches

Span = tuple[int, int, str]

# The base kinds of the contract, in its order, and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")

# Alphabet of base-62 checksums, and prefixes of tokens that end in one.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", re.ASCII)
# The first and the last line of a private key block, and what can't stand between.
KEY_LINE = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----", re.ASCII)
NOT_IN_KEY = re.compile(r"[^A-Za-z0-9+/=\s:,-]", re.ASCII)


def base62_crc(body: str) -> str:
    value, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


@dataclass(frozen=True)
class Kind:
    """What may begin at a keyword: an anchored pattern and a test of the match.

    ``folded`` keywords are looked up in the text with A-Z lower-cased.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    folded: bool = False


KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        ASSIGN,
        lambda m: len(m[2]) >= ASSIGN_VALUE,
        folded=True,
    ),
    Kind("access", ("akia",), ACCESS, lambda m: len(m[0]) >= ACCESS_LENGTH, folded=True),
    Kind("checked", CHECKED_PREFIXES, CHECKED, lambda m: base62_crc(m[1]) == m[2], folded=True),
    Kind("key_block", ("-----begin ", "-----end "), KEY_LINE, lambda m: True, folded=True),
)
ORDER = {name: i for i, name in enumerate((*BASE_KINDS, "checked", "key_block"))}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Characters of a hexadecimal run become "h", so that a run long enough is a keyword too.
_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
_RUN = b"h" * HEX_LENGTH


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind in KINDS:
        for word in kind.keywords:
            found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def key_blocks(text: str, lines: list[re.Match]) -> list[Span]:
    """Blocks from each first line to the next last line of the same label, if only key text is between.

    A place where key text stops is looked up once for all first lines before it, so the
    work is linear in the text, whatever lines it has.
    """
    ends: dict[str, list[re.Match]] = {}
    for line in lines:
        if line[1] == "END":
            ends.setdefault(line[2], []).append(line)
    blocks, over, stop = [], 0, -1
    for line in lines:
        if line[1] == "END" or line.start() < over or line[2] not in ends:
            continue
        last = ends[line[2]]
        at = bisect_left(last, line.end(), key=re.Match.start)
        if stop < line.end():
            other = NOT_IN_KEY.search(text, line.end())
            stop = other.start() if other else len(text)
        if at < len(last) and last[at].start() <= stop:
            over = last[at].end()
            blocks.append((line.start(), over, "key_block"))
    return blocks


def scan(text: str) -> list[Span]:
    """All spans of a text as (start, end, kind), in code points, by start and kind.

    A kind's matches don't overlap: a match that fails its test is dropped but still takes
    its place, as it would in one left-to-right search.
    """
    found: list[Span] = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(_LOWER).decode("utf-8", "surrogatepass")
    over: dict[str, int] = {}
    lines: list[re.Match] = []
    for last, (length, kind) in automaton().iter(low):
        start = last + 1 - length
        if start < over.get(kind.name, 0) or not (match := kind.pattern.match(text, start)):
            continue
        if kind.name == "key_block":
            lines.append(match)
            continue
        over[kind.name] = match.end()
        if kind.valid(match):
            found.append((start, match.end(), kind.name))
    found += key_blocks(text, lines)
    # Every run of 24 hexadecimal characters holds the keyword of the class text.
    if _RUN in raw.translate(_CLASS):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [scan(text) if text else [] for text in batch.column("text").to_pylist()]
    base = [[s for s in spans if s[2] in BASE_KINDS] for spans in rows]
    columns = {"doc_id": batch.column("doc_id")}
    for kind in BASE_KINDS:
        columns[f"n_{kind}"] = pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64())
    digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
    columns["base_sha256"] = pa.array(digest, pa.string())
    columns["spans"] = pa.array([joined(spans) for spans in rows], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Spans per document over its whole text.

    A null or empty text has none (the digest is that of the empty string).  Repeated rows
    and null ids give a row each, other columns are ignored, no rows give no rows.
    """
    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(pairs, _scan_batch, schema)
