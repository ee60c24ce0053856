"""Chunk rows: cut, slice, measure, and compare with changed content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.chunking import chunk_bounds, slice_all

CHUNK_KEY = ["file", "chunknumber"]


def usable(documents: DataFrame) -> DataFrame:
    """Documents with text.  The content conditions follow from the status, but unlike it
    they reach the Parquet scan."""
    has_text = F.col("content").isNotNull() & (F.col("content") != "")
    return documents.where((F.col("status") == "ok") & has_text)


def chunk_documents(documents: DataFrame, size: int) -> DataFrame:
    """``(file, chunknumber, start, end)`` of usable documents; a map-only job."""
    bounds = chunk_bounds(F.col("content"), size)
    return (
        usable(documents)
        .select("file", F.explode(bounds).alias("chunk"))
        .select("file", "chunk.chunknumber", "chunk.start", "chunk.end")
    )


def chunk_texts(documents: DataFrame, size: int) -> DataFrame:
    """Chunk rows with their text in the same pass; nothing is joined or shuffled."""
    chunks = slice_all(F.col("content"), chunk_bounds(F.col("content"), size))
    return (
        usable(documents)
        .select("file", F.explode(chunks).alias("chunk"))
        .select("file", "chunk.chunknumber", "chunk.start", "chunk.end", "chunk.chunk_text")
    )


def slice_chunks(
    chunks: DataFrame, documents: DataFrame, small: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Attach text to stored bounds: one equi-join on ``file``; ``carry`` columns stay.

    The bounds of a document travel as one array, so its content is moved once and
    sliced once, however many of its chunks are wanted.  That array is bounded by the
    document's own length.  Say ``small`` only of chunk sets whose rows were counted.
    """
    bound = F.struct("chunknumber", "start", "end", *carry)
    wanted = chunks.groupBy("file").agg(F.collect_list(bound).alias("bounds"))
    if small:
        wanted = F.broadcast(wanted)
    sliced = slice_all(F.col("content"), F.col("bounds"), carry)
    return (
        documents.select("file", "content")
        .join(wanted, "file")
        .select("file", F.explode(sliced).alias("chunk"))
        .select("file", "chunk.*")
    )


def chunk_stats(chunks: DataFrame, by: str | Column = "file") -> DataFrame:
    """Counts and lengths of chunks, to choose a chunk size."""
    length = F.col("end") - F.col("start")
    return chunks.groupBy(by).agg(
        F.count("*").alias("n_chunks"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum(length).alias("total_length"),
        F.avg(length).alias("avg_length"),
    )


def bounds_drift(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose content no longer matches what their stored bounds cover."""
    covered = chunks.groupBy("file").agg(F.max("end").alias("covered"))
    lengths = documents.select("file", F.length("content").alias("length"))
    drift = F.when(F.col("length") > F.col("covered"), "grown").otherwise("shrunk")
    return (
        covered.join(lengths, "file")
        .where(F.col("covered") != F.col("length"))
        .select("file", "covered", "length", drift.alias("drift"))
    )


def chunk_marks(texts: DataFrame) -> DataFrame:
    """Chunk rows with a fingerprint of their text, to be kept beside the bounds."""
    return texts.select("file", "chunknumber", "start", "end", F.md5(F.col("chunk_text").cast("binary")).alias("mark"))


def chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file, mark, old_chunk, new_chunk, change)`` between two tables of :func:`chunk_marks`.

    Chunks of a file with equal text are aligned one by one in order: ``kept`` at the same
    number, ``moved`` at another; both keep their results.  The rest is ``gone`` or ``new``, so an
    edit that leaves the length alone is found too.  Only fingerprints are shuffled.
    """
    same = Window.partitionBy("file", "mark").orderBy("chunknumber")

    def numbered(marks: DataFrame, name: str) -> DataFrame:
        return marks.select("file", "mark", F.row_number().over(same).alias("k"), F.col("chunknumber").alias(name))

    change = (
        F.when(F.col("old_chunk").isNull(), "new")
        .when(F.col("new_chunk").isNull(), "gone")
        .when(F.col("old_chunk") == F.col("new_chunk"), "kept")
        .otherwise("moved")
    )
    both = numbered(old, "old_chunk").join(numbered(new, "new_chunk"), ["file", "mark", "k"], "full")
    return both.select("file", "mark", "old_chunk", "new_chunk", change.alias("change"))


def known_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("file").distinct()


def active_files(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Files that are both in the store and in the folder; the rest keep their rows."""
    return known_files(chunks).join(documents.select("file"), "file", "left_semi")


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty where the key holds."""
    return table.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
