"""Token ids in directly addressable files.

Ids are split into chunks of ``CHUNK_BITS``.  Level 0 holds the low chunk of every token
with a bitmap of those that continue; level 1 holds the next chunk of only those, and so
on.  A rank directory over each bitmap tells how many tokens before a place continue, so
any token is read with one look per level and no block is decoded.

A file set is a Parquet table of segments, each a row of byte columns; it lies in the shared
folder and needs no file system besides Spark's.  Documents stand in ascending doc_id
order: the range partitions are in order, and a partition writes its segments in order.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.llm.tables import cut
from gleanframe.llm.words import Words, utf8, word_hashes
from gleanframe.session import shared_folder

CHUNK_BITS = 8
# A rank directory has one count for so many bits.
RANK_BITS = 512
END_ID = 0
# A segment is closed at this many tokens; a longer document has a segment of its own.
SEGMENT_TOKENS = 1 << 20
# Pieces of text whose ids a worker remembers, some 40 MB.
CACHE_PIECES = 1_000_000
# Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 2 << 20
# So many new pieces are encoded as one text.
NEW_PIECES = 16_384

SEGMENT_SCHEMA = (
    "part int, segment int, before long, n_tokens long, doc_ids array<bigint>, ends array<bigint>, "
    "levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
)

LEVELS = pa.list_(pa.struct([(name, pa.binary()) for name in ("chunks", "bitmap", "ranks")]))


# --- the code ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    ranks: np.ndarray


def pack(ids: np.ndarray) -> list[Level]:
    """Chunk levels of ids, of any size up to 64 bits."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK_BITS) != 0
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(bits) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
        whole[: len(bits)] = bits
        per_block = np.bitwise_count(whole).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]) if len(per_block) else np.zeros(0)
        levels.append(Level((rest & np.uint64(2**CHUNK_BITS - 1)).astype(np.uint8), whole, ranks.astype(np.uint32)))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(CHUNK_BITS)


def unpack(levels: list[Level]) -> np.ndarray:
    """All ids of a segment."""
    ids = levels[0].chunks.astype(np.uint64)
    at = np.arange(len(ids))
    for k, level in enumerate(levels[1:], 1):
        more = np.unpackbits(levels[k - 1].bitmap, count=len(at), bitorder="little").astype(bool)
        at = at[more]
        ids[at] |= level.chunks.astype(np.uint64) << np.uint64(CHUNK_BITS * k)
    return ids


def access(levels: list[Level], place: int) -> int:
    """The id at one place, without decoding any other."""
    value = 0
    for k, level in enumerate(levels):
        value |= int(level.chunks[place]) << (CHUNK_BITS * k)
        byte, bit = divmod(place, 8)
        if not level.bitmap[byte] >> bit & 1:
            return value
        block = place // RANK_BITS
        head = level.bitmap[block * RANK_BITS // 8 : byte]
        low = level.bitmap[byte] & ((1 << bit) - 1)
        place = int(level.ranks[block]) + int(np.bitwise_count(head).sum()) + int(np.bitwise_count(low))
    return value


def _from_row(levels: list[dict]) -> list[Level]:
    return [
        Level(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["bitmap"], np.uint8), np.frombuffer(x["ranks"], np.uint32))
        for x in levels
    ]


# --- encoding ---------------------------------------------------------------------------

_SECOND_BASE = np.uint64(0xA0761D6478BD642F)
# What parts pieces when several are encoded as one text.
_PART = "\n"


_ASCII = np.arange(256) < 0x80
_LETTER = np.isin(np.arange(256), np.frombuffer(ascii_letters.encode(), np.uint8))


def pieces(texts: pa.Array, uncut: Sequence[bytes] = ()) -> Words:
    """Cut texts where the tokenizer's own pattern surely begins anew.

    That is before a space that follows a character surely no white space, and behind an
    ASCII letter that other ASCII follows.  The pattern never joins characters across such a
    place and looks only ahead from white space, so the ids of a text are those of its pieces,
    one after the other.  ``uncut`` are the tokens found before the pattern is applied.
    """
    data, offsets = utf8(texts)
    begins = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        before = data[:-1]
        begins[1:] = (data[1:] == 0x20) & (before > 0x20) & (before != 0x7F)
        # Beyond ASCII: not after characters that share their lead bytes with white space.
        begins[2:] &= data[:-2] != 0xC2
        begins[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & np.isin(data[1:-2], (0x80, 0x81, 0x9A)))
        begins[1:] |= _LETTER[before] & (_ASCII & ~_LETTER)[data[1:]]
        raw = data.tobytes() if uncut else b""
        for token in uncut:
            at = raw.find(token)
            while at >= 0:
                begins[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


class Encoder:
    """Ids of texts through a tokenizer file, remembering the ids of pieces.

    Pieces are known by 128 bits of hash and their ids lie in one array, so a remembered
    piece takes some 40 bytes.  A full memory stays as it is and the rest is encoded anew.
    """

    def __init__(self, path: str) -> None:
        # A task has one core; the library would start threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part = np.array(self._ids(_PART), np.uint32)
        self.uncut = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> array:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _encode_new(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where those of each begin and how many it has.

        Pieces without inner white space are encoded as one text with a separator, which is
        a token of its own between them.
        """
        lengths = w.ends - w.starts
        begin = np.cumsum(lengths) - lengths
        data = w.data[np.arange(lengths.sum()) + np.repeat(w.starts - begin, lengths)]
        # Sure of every byte: visible ASCII, and U+00C0 to U+00FF; a space may come first.
        plain = (data > 0x20) & (data < 0x7F) | (data == 0xC3)
        plain[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        plain[begin] |= (data[begin] == 0x20) & (lengths > 1)
        plain = np.logical_and.reduceat(plain, begin)
        new = {i: data[begin[i] : begin[i] + lengths[i]].tobytes().decode("utf-8") for i in np.flatnonzero(~plain)}
        for i, p in new.items():
            plain[i] = p.removeprefix(" ").isalpha()
        starts, sizes, out = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
        together = np.flatnonzero(plain)
        if len(self.part) == 1 and len(together):
            joined = np.insert(data[np.repeat(plain, lengths)], np.cumsum(lengths[together])[:-1], ord(_PART))
            ids = np.array(self._ids(joined.tobytes().decode("utf-8")), np.uint32)
            parts = np.flatnonzero(ids == self.part[0])
            if len(parts) == len(together) - 1:
                upto = np.append(parts, len(ids)) - np.arange(len(together))
                starts[together] = np.append(0, upto[:-1])
                sizes[together] = np.diff(upto, prepend=0)
                out.append(np.delete(ids, parts))
            else:
                plain[:] = False
        else:
            plain[:] = False
        size = sum(map(len, out))
        for i in np.flatnonzero(~plain):
            text = new.get(i) or data[begin[i] : begin[i] + lengths[i]].tobytes().decode("utf-8")
            out.append(np.array(self._ids(text), np.uint32))
            starts[i], sizes[i] = size, len(out[-1])
            size += len(out[-1])
        return np.concatenate(out), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and where those of each row begin."""
        w = pieces(texts, self.uncut)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        keys, first, back = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        some = w._replace(starts=w.starts[first], ends=w.ends[first])
        checks = word_hashes(some, _SECOND_BASE)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        ids, missing = self.ids, np.flatnonzero(~known)
        if len(missing):
            grown = [ids]
            for i in range(0, len(missing), NEW_PIECES):
                new = missing[i : i + NEW_PIECES]
                more, begin, count = self._encode_new(some._replace(starts=some.starts[new], ends=some.ends[new]))
                starts[new], sizes[new] = sum(map(len, grown)) + begin, count
                grown.append(more)
            ids = np.concatenate(grown)
            if len(self.keys) + len(missing) <= CACHE_PIECES:
                self._remember(keys[missing], checks[missing], starts[missing], sizes[missing], ids)
        each = sizes[back]
        upto = np.cumsum(each)
        place = np.arange(upto[-1]) - np.repeat(upto - each, each) + np.repeat(starts[back], each)
        return ids[place], np.concatenate([[0], upto])[w.first]

    def _remember(self, keys, checks, starts, sizes, ids) -> None:
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = all_keys[order]
        self.checks = np.concatenate([self.checks, checks])[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.ids = ids


@cache
def encoder(path: str) -> Encoder:
    """One per worker, which serves many tasks."""
    return Encoder(path)


# --- files ------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write the segments of all documents, in doc_id order.

    A null text is an empty one and holds the end id alone; a null doc_id comes first.  Rows
    with equal ids stand next to each other, ordered by text, each encoded.  Other columns
    are ignored; without rows there are no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = before = number = 0

        def segment() -> pa.RecordBatch:
            nonlocal before, number, size
            values = np.concatenate(ids)
            levels = [
                {"chunks": x.chunks.tobytes(), "bitmap": x.bitmap.tobytes(), "ranks": x.ranks.tobytes()}
                for x in pack(values)
            ]
            row = {
                "part": pa.array([part], pa.int32()),
                "segment": pa.array([number], pa.int32()),
                "before": pa.array([before], pa.int64()),
                "n_tokens": pa.array([len(values)], pa.int64()),
                "doc_ids": pa.array([pa.concat_arrays(names).to_pylist()], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum(np.concatenate(sizes))], pa.list_(pa.int64())),
                "levels": pa.array([levels], LEVELS),
            }
            before, number, size = before + len(values), number + 1, 0
            for kept in (ids, sizes, names):
                kept.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for rows in cut(batch, SLICE_BYTES):
                got, first = encode(rows.column("text"))
                ids.append(np.insert(got, first[1:], end_id))
                sizes.append(np.diff(first) + 1)
                names.append(rows.column("doc_id"))
                size += len(ids[-1])
                if size >= SEGMENT_TOKENS:
                    yield segment()
        if ids:
            yield segment()

    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = pairs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids in the whole set before each.

    Sums per partition, a row each, go through one window.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    per_part = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # One row per range partition of the writing job, a number the session sets.
    return segments.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def token_digest(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(_from_row(row["levels"])).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(starts + row["start"], pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    columns = segments.select("start", "doc_ids", "ends", "levels")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, places: list[int]) -> dict[int, int]:
    """Ids at a few places of the whole set; only the segments that hold them are read."""
    hit = F.lit(False)
    for place in places:
        hit = hit | ((F.col("start") <= place) & (F.col("start") + F.col("n_tokens") > place))
    found = {}
    for row in segments.where(hit).select("start", "n_tokens", "levels").toLocalIterator():
        levels = _from_row([x.asDict() for x in row["levels"]])
        for place in places:
            if row["start"] <= place < row["start"] + row["n_tokens"]:
                found[place] = access(levels, place - row["start"])
    return found


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files of a set of documents, read them back and describe each document."""
    path = shared_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer)
    return token_digest(read_segments(docs.sparkSession, path))
