"""Cut very long documents in parallel, and measure a grid of chunk sizes in one scan.

A document is cut from its beginning, so a cut depends on all before it.  Blocks make that
dependence small: each block's task tabulates, for every place where a chunk could enter
the block, the place where the chain of chunks leaves it and the number of chunks between.
Going through a document's tables in order takes one look-up per block; with its entry known
each block is cut by itself, all at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.breaks import breaks, cuts, jumps, next_cuts
from gleanframe.functions.chunking import blocks_of
from gleanframe.functions.lambdas import bind
from gleanframe.operators.chunks import usable

# Characters of a block: its table has a place for each character of a chunk.
BLOCK = 1 << 20


def _blocks(documents: DataFrame, size: int, block: int) -> DataFrame:
    """``(file, block, n, text, ahead)``, dealt by block; ``ahead`` is what a last chunk may reach."""
    content = F.col("content")
    parts = bind(
        blocks_of(content, block),
        lambda texts: F.transform(
            texts, lambda text, i: F.struct(text.alias("text"), F.substring(F.get(texts, i + 1), 1, size).alias("ahead"))
        ),
    )
    rows = usable(documents).select("file", F.length(content).alias("n"), F.posexplode(parts).alias("block", "part"))
    # A given number of partitions isn't merged by size: the work is by character, not by byte moved.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("file", "block", "n", "part.*").repartition(tasks, "file", "block")


def _whole(n: int, size: int) -> bool:
    """A document no longer than a chunk is one chunk."""
    return n <= size


def cut_in_blocks(documents: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``(file, chunknumber, start, end)``, the same bounds as cutting from the beginning.

    A block has at least ``size`` characters.  The step through a document's tables reads
    ``8 * size`` bytes for each of its blocks and keeps one of them in memory.
    """
    if size <= 0:
        raise ValueError("chunk size must be a positive integer")
    block = max(block, size)
    blocks = _blocks(documents, size, block)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, chunks = [], []
            for at, n, text, ahead in zip(*(batch[c].to_pylist() for c in ("block", "n", "text", "ahead"))):
                stop = len(text)
                if _whole(n, size):
                    leave, count = np.array([stop]), np.array([1])
                else:
                    leave, count = jumps(breaks(text + (ahead or "")), size, stop)
                entries = 1 if at == 0 else size
                leaves.append((leave[:entries] - stop).astype("<i4").tobytes())
                chunks.append(count[:entries].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array(leaves, pa.binary()), pa.array(chunks, pa.binary())],
                names=["file", "block", "leaves", "chunks"],
            )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entry, number = None, 0, 0
        for batch in batches:
            entries, numbers = [], []
            for file, leaves, chunks in zip(*(batch[c].to_pylist() for c in ("file", "leaves", "chunks"))):
                if file != now:
                    now, entry, number = file, 0, 0
                entries.append(entry)
                numbers.append(number)
                number += int(np.frombuffer(chunks, "<i4", 1, 4 * entry)[0]) if 4 * entry < len(chunks) else 0
                entry = int(np.frombuffer(leaves, "<i4", 1, 4 * entry)[0]) if 4 * entry < len(leaves) else 0
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array(entries, pa.int32()), pa.array(numbers, pa.int32())],
                names=["file", "block", "entry", "first"],
            )

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"file": [], "chunknumber": [], "start": [], "end": []}
            columns = [batch[c].to_pylist() for c in ("file", "block", "n", "text", "ahead", "entry", "first")]
            for file, number, n, text, ahead, at, chunk in zip(*columns):
                index = breaks(text + (ahead or ""))
                while at < len(text):
                    end = n if _whole(n, size) else int(next_cuts(index, np.array([at]), size)[0])
                    for name, value in zip(out, (file, chunk, number * block + at, number * block + end)):
                        out[name].append(value)
                    at, chunk = end, chunk + 1
            names = {"chunknumber": pa.int32(), "start": pa.int32(), "end": pa.int32(), "file": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, names[k]) for k, v in out.items()})

    tables = blocks.mapInArrow(tabulate, "file string, block int, leaves binary, chunks binary")
    in_order = tables.repartition("file").sortWithinPartitions("file", "block")
    entered = in_order.mapInArrow(follow, "file string, block int, entry int, first int")
    # Texts stay where they were dealt; a broadcast of either side would move them again.
    return blocks.join(entered.hint("merge"), ["file", "block"]).mapInArrow(bounds, "file string, chunknumber int, start int, end int")


def chunk_size_grid(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """``(size, chunks, min_length, avg_length, max_length)`` for every size, from one scan of the texts.

    The places where chunks may end are found once per document and searched for each size.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch["content"].to_pylist():
                index = breaks(text)
                for size in sizes:
                    lengths = np.diff(np.array([0, *cuts(index, size)]))
                    parts.append((size, len(lengths), lengths.min(), lengths.max(), lengths.sum()))
            columns = zip(*parts) if parts else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x) for x in c], pa.int64()) for c in columns],
                names=["size", "chunks", "low", "high", "total"],
            )

    parts = usable(documents).select("content").mapInArrow(measure, "size long, chunks long, low long, high long, total long")
    return parts.groupBy("size").agg(
        F.sum("chunks").alias("chunks"), F.min("low").alias("min_length"),
        (F.sum("total") / F.sum("chunks")).alias("avg_length"), F.max("high").alias("max_length"),
    )
