import random
import re

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.chunking import BLOCK, chunk_bounds, slice_all
from gleanframe.operators.chunks import chunk_documents, chunk_texts, duplicate_keys, slice_chunks
from gleanframe.sources.documents import corpus, with_status

VECTORS = [
    ("", 10, []),
    ("short", 10, [(0, 5)]),
    ("exactly10!", 10, [(0, 10)]),
    ("abcdefghijk", 5, [(0, 5), (5, 10), (10, 11)]),
    ("One. Two. Three", 10, [(0, 10), (10, 15)]),
    ("One. Two. Three.", 10, [(0, 10), (10, 16)]),
    ("aa\n\nbb\ncc dd ee", 12, [(0, 4), (4, 7), (7, 15)]),
    ("aa\nbb\ncc", 6, [(0, 6), (6, 8)]),
    ("p1\n\nxxxxxxxxxxxx", 10, [(0, 4), (4, 14), (14, 16)]),
    ("abcd\n\nefgh", 5, [(0, 5), (5, 6), (6, 10)]),
    ("a\n \n \nb c d", 8, [(0, 6), (6, 11)]),
    ("Hi there\n- item one", 12, [(0, 9), (9, 19)]),
    ("wow!yes?no", 4, [(0, 4), (4, 8), (8, 10)]),
    ("ab.\U0001f916cd e", 4, [(0, 4), (4, 8)]),
    ("ab\x1c.\x1f c\x85d e", 5, None),
]


def expected_bounds(text, size):
    """Independent statement of the rule: the latest break of the strongest kind present."""
    if not text:
        return []
    if len(text) <= size:
        return [(0, len(text))]
    bounds, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        kinds = {0: [], 1: [], 2: []}
        for at in range(start, stop):
            char, rest = text[at], text[at + 1 : stop]
            if char == "\n":
                kinds[1].append(at + 1)
                earlier = text[start:at].rstrip()
                if "\n" in text[start + len(earlier) : at]:
                    kinds[0].append(at + 1)
            if char in ".!?" and (not rest or rest[0].isspace()):
                kinds[2].append(min(at + 2, stop))
        end = next((max(found) for found in kinds.values() if found), stop)
        bounds.append((start, end))
        start = end
    return bounds


def bounds_of(spark, texts, size):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    sliced = slice_all(F.col("t"), chunk_bounds(F.col("t"), size))
    rows = frame.select("i", sliced.alias("chunks")).orderBy("i").collect()
    for row, text in zip(rows, texts):
        assert "".join(c.chunk_text for c in row.chunks) == text
        assert [c.chunknumber for c in row.chunks] == list(range(len(row.chunks)))
    return [[(c.start, c.end) for c in row.chunks] for row in rows]


@pytest.mark.parametrize("size", sorted({size for _, size, _ in VECTORS}))
def test_vectors(spark, size):
    cases = [(text, bounds) for text, s, bounds in VECTORS if s == size]
    found = bounds_of(spark, [text for text, _ in cases], size)
    for (text, bounds), got in zip(cases, found):
        assert got == (expected_bounds(text, size) if bounds is None else bounds), text


@pytest.mark.parametrize("size", [1, 3, 7, 20])
def test_random_texts_match_the_rule(spark, size):
    rng = random.Random(size)
    alphabet = "ab .!?\n\n\t \x1d \U0001f916"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(400)]
    for text, got in zip(texts, bounds_of(spark, texts, size)):
        assert got == expected_bounds(text, size), repr(text)
        assert len(got) <= 4 * -(-len(text) // size)


def test_many_segments_and_long_slices(spark):
    """A text far beyond one segment of ends and beyond the direct slicing length."""
    rng = random.Random(5)
    words = ["alpha", "beta.", "gamma\n", "\U0001f916é", "delta\n\n", "x" * 90, "y?"]
    text = " ".join(rng.choices(words, k=40_000))
    assert len(text) > 8 * BLOCK
    for size in (100, 5000, 50_000):
        assert bounds_of(spark, [text], size) == [expected_bounds(text, size)]


def test_possessive_blocks_survive_mixed_widths(spark):
    text = "a\U0001f916" * 60_000
    assert bounds_of(spark, [text], 50_000) == [expected_bounds(text, 50_000)]


def test_null_and_bad_size(spark):
    frame = spark.range(1).select(F.lit(None).cast("string").alias("t"))
    assert frame.select(F.size(chunk_bounds(F.col("t"), 5))).first()[0] == 0
    for size in (0, -1, 2.5):
        with pytest.raises(ValueError):
            chunk_bounds(F.col("t"), size)


def test_only_usable_documents_and_unique_keys(spark):
    rows = [("a", "x. y. z."), ("b", None), ("c", ""), ("d", "short")]
    documents = with_status(spark.createDataFrame(rows, "file string, content string"))
    chunks = chunk_documents(documents, 4)
    assert {r.file for r in chunks.collect()} == {"a", "d"}
    assert duplicate_keys(chunks, ["file", "chunknumber"]).count() == 0


def test_cutting_is_map_only(spark):
    documents = with_status(spark.createDataFrame([("a", "x")], "file string, content string"))
    plan = chunk_texts(documents, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_conditions_reach_the_scan(spark, sf_dir):
    plan = chunk_documents(corpus(spark, sf_dir), 100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan


def test_slices_of_changed_content(spark):
    chunks = spark.createDataFrame(
        [("a", 0, 0, 4), ("a", 1, 4, 9), ("a", 2, 9, 12), ("gone", 0, 0, 3)],
        "file string, chunknumber int, start int, end int",
    )
    documents = spark.createDataFrame([("a", "one two")], "file string, content string")
    for small in (False, True):
        rows = slice_chunks(chunks, documents, small).orderBy("chunknumber").collect()
        assert [r.chunk_text for r in rows] == ["one ", "two", ""]
