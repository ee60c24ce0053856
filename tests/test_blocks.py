"""Cutting in blocks and the size grid against the fold over whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.functions.breaks import SPACES, breaks, cuts, jumps
from gleanframe.operators.blocks import chunk_size_grid, cut_in_blocks
from gleanframe.operators.chunks import chunk_documents, chunk_stats
from gleanframe.sources.documents import with_status

PIECES = ["\n", "\n \t\n", "\n\n\n", ". ", "! ", "?", "...", " ", "\u001c", "é", "日", "word", "\U0001f600", "\r\n"]


def random_texts(n, seed=0, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    rows = [(f"s/{i}", text) for i, text in enumerate(texts)]
    return with_status(spark.createDataFrame(rows, "file string, content string"))


def bounds(chunks):
    return sorted(tuple(r) for r in chunks.select("file", "chunknumber", "start", "end").collect())


def test_white_space_is_that_of_the_cutter(spark):
    from gleanframe.functions.text import SPACE

    points = spark.createDataFrame([(i, chr(i)) for i in range(0x3001)], "id int, c string").where(F.col("c").rlike(f"^{SPACE}$"))
    assert sorted(r.id for r in points.collect()) == SPACES.tolist()


@pytest.mark.parametrize("size,block", ((7, 7), (13, 31), (40, 1000)))
def test_blocks_equal_the_fold(spark, size, block):
    documents = frame(spark, random_texts(400, size)).repartition(4)
    assert bounds(cut_in_blocks(documents, size, block)) == bounds(chunk_documents(documents, size))


def test_one_long_document_is_cut_by_many_tasks(spark):
    text = "".join(random_texts(1, 5, 700_000))
    documents = frame(spark, [text])
    cut = cut_in_blocks(documents, 500, 1 << 14)
    assert bounds(cut) == bounds(chunk_documents(documents, 500))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan and "block" in plan
    parts = cut.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert parts > 1


def test_chains_by_doubling_equal_steps():
    for text in random_texts(60, 3, 80):
        index = breaks(text)
        if index.length > 20:
            stop = index.length * 2 // 3
            leave, count = jumps(index, 9, stop)
            for start in range(stop):
                at, n = start, 0
                while at < stop:
                    at, n = int(np.asarray(jumps(index, 9, at + 1)[0])[at]), n + 1
                assert (leave[start], count[start]) == (at, n)
        assert not cuts(index, 9) or cuts(index, 9)[-1] == index.length


def test_grid_equals_statistics_per_size(spark):
    documents = frame(spark, random_texts(300, 9))
    sizes = [5, 17, 100]
    found = {r["size"]: r for r in chunk_size_grid(documents, sizes).collect()}
    for size in sizes:
        expected = chunk_stats(chunk_documents(documents, size), F.lit(1)).first()
        got = found[size]
        assert (got.chunks, got.min_length, got.max_length) == (expected.n_chunks, expected.min_length, expected.max_length)
        assert got.avg_length == pytest.approx(expected.avg_length)
    assert chunk_size_grid(documents.limit(0), sizes).count() == 0
