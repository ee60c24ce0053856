"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is a seed, however often the corpus has it: edits break n-grams, so
none may be given up for another.  Passages of documents around seeds are joined to the
items and aligned word by word, which scores copies with words changed, added or left out.
One seed makes a candidate; candidates with too few of the item's words to reach the limit
are left out before the alignment, which can't lose a leak.

A leak without any run of ``NGRAM`` words of its item isn't found.  ``x`` words changed or
left out of ``n`` leave such a run if ``3 * x < n - 2``; beyond, evenly spread edits, or
words put in after every second word, may break all runs of a leak near the limit.

Documents are scanned once in place; only passages are shuffled.  A bitmap of fixed size
tells a task which n-grams may matter, and an exact join follows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept, key_filter, map_batches, maybe
from gleanframe.llm.words import Words, lists, mix, shingles, signed, trimmed, word_hashes, words

NGRAM = 3
# Smith-Waterman scores, and the least share of an item's perfect score that is a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK_SCORE = 0.5
# Punctuation cut off the ends of words before they are compared.
_TRIM = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}"))


def _plain(texts: pa.Array) -> Words:
    """Lower-cased words without punctuation at their ends, however much; code points stay in place."""
    return trimmed(words(pc.utf8_lower(texts)), _TRIM)


def _ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    grams = shingles(word_hashes(w), w.first, NGRAM, whole=True)
    return signed(grams.hashes), grams.first


def item_grams(items: DataFrame) -> DataFrame:
    """``(item_id, gram)``: the distinct n-grams of each item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _plain(batch.column("text"))
        grams, first = _ngrams(w)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
        return pa.RecordBatch.from_pydict(
            {
                "item_id": batch.column("item_id").take(pa.array(rows)),
                "gram": pa.array(grams),
            }
        )

    return map_batches(items, run, "item_id long, gram long").distinct()


def passages(docs: DataFrame, grams: DataFrame, reach: int) -> DataFrame:
    """``(doc_id, text_key, start, passage, grams)`` around possible seeds.

    A passage has ``reach`` words on either side of each n-gram; overlapping ones are one.
    ``start`` is the code point at which it begins.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(F.col("gram"), grams))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _plain(batch.column("text"))
        found, first = _ngrams(w)
        hits = np.flatnonzero(maybe(bitmap.value, found))
        row = np.searchsorted(first, hits, side="right") - 1
        place = hits - first[row] + w.first[row]
        begin = np.maximum(place - reach, w.first[row])
        end = np.minimum(place + NGRAM + reach, w.first[row + 1])
        # A new passage starts in a new row or beyond the last one's end.
        new = np.ones(len(hits), bool)
        if len(hits):
            new[1:] = (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hits)) - 1 if len(head) else head
        rows = row[head]
        left, right = w.starts[begin[head]], w.ends[end[tail] - 1]
        chars = [
            int(np.count_nonzero((w.data[w.offsets[r] : a] & 0xC0) != 0x80)) for r, a in zip(rows, left)
        ]
        texts = [w.data[a:b].tobytes().decode("utf-8") for a, b in zip(left, right)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "text_key": batch.column("text_key").take(pa.array(rows)),
                "start": pa.array(chars, pa.int64()),
                "passage": pa.array(texts, pa.string()),
                "grams": lists(pa.array(found[hits]), np.append(head, len(hits))),
            }
        )

    schema = "doc_id long, text_key long, start long, passage string, grams array<bigint>"
    return map_batches(docs, run, schema)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and its first and last word in the passage."""
    m = len(passage)
    best = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    steps = np.arange(m + 1) * GAP
    top, first, last = 0, 0, 0
    for word in item:
        from_match = best[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = best[1:] + GAP
        cell = np.maximum(0, np.maximum(from_match, down))
        came = np.where(cell == 0, np.arange(1, m + 1), np.where(from_match >= down, origin[:-1], origin[1:]))
        # Gaps along the passage: the best of all cells before, less a gap for each word between.
        lifted = np.concatenate([[0], cell]) - steps
        high = np.maximum.accumulate(lifted)
        place = np.maximum.accumulate(np.where(lifted == high, np.arange(m + 1), 0))
        best = high + steps
        origin = np.concatenate([[0], came])[place]
        k = int(best.argmax())
        if best[k] > top:
            top, first, last = int(best[k]), int(origin[k]), k - 1
    return top, first, last


def _shared_words(item: np.ndarray, item_rows: np.ndarray, passage: np.ndarray, passage_rows: np.ndarray) -> np.ndarray:
    """Whether each word of an item occurs in the passage of its row."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    own = [mix(h ^ mix((r + 1).astype(np.uint64) * salt)) for h, r in ((item, item_rows), (passage, passage_rows))]
    return np.isin(*own)


def _align_batch(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """Scores of the rows that can reach ``least``: every word of an alignment's matches is in both."""
    p, q = _plain(batch.column("passage")), _plain(batch.column("item"))
    shared = _shared_words(word_hashes(q), q.rows, word_hashes(p), p.rows)
    most = np.bincount(q.rows, weights=shared, minlength=batch.num_rows)
    batch = batch.take(pa.array(np.flatnonzero(most >= least * q.counts)))
    p, q = _plain(batch.column("passage")), _plain(batch.column("item"))
    of_p, of_q = word_hashes(p), word_hashes(q)
    scores, bounds = [], []
    for r in range(batch.num_rows):
        item = of_q[q.first[r] : q.first[r + 1]]
        score, first, last = align(item, of_p[p.first[r] : p.first[r + 1]])
        scores.append(score / (MATCH * max(1, len(item))))
        begin, a, b = p.offsets[r], p.starts[p.first[r] + first], p.ends[p.first[r] + max(first, last)]
        bounds.append([int(np.count_nonzero((p.data[begin:x] & 0xC0) != 0x80)) for x in (a, b)])
    start = batch.column("start").to_numpy()
    found = np.array(bounds, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "text_key": batch.column("text_key"),
            "item_id": batch.column("item_id"),
            "score": pa.array(scores, pa.float64()),
            "start": pa.array(start + found[:, 0]),
            "end": pa.array(start + found[:, 1]),
        }
    )


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK_SCORE) -> DataFrame:
    """``(doc_id, text_key, item_id, score, start, end)`` per document and item it leaks.

    ``score`` is the best alignment's share of the item's perfect score, ``start`` and
    ``end`` its code points in the text (the first passage of equal score).  Texts and items
    without words leak nothing; null ids are ids like any other, ``text_key`` (a hash of the
    text) tells rows with equal ids apart, repeated rows are one.  An item with fewer words
    than an n-gram is one n-gram.  Extra columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    items = kept(
        benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    )
    seeds = kept(item_grams(items))
    sizes = items.agg(F.max(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0]
    # An alignment of the least score spans twice its item's words at most.
    reach = math.ceil(2 * (1 - min(least, 1)) * sizes) + sizes if sizes else 1
    found = kept(passages(docs, seeds.select("gram").distinct(), reach).distinct())
    near = found.select("doc_id", "text_key", "start", F.explode(F.array_distinct("grams")).alias("gram"))
    pairs = near.join(seeds, "gram").select("doc_id", "text_key", "start", "item_id").distinct()
    same = [found[c].eqNullSafe(F.col(f"p_{c}")) for c in ("doc_id", "text_key", "start")]
    named = pairs.select("item_id", *[F.col(c).alias(f"p_{c}") for c in ("doc_id", "text_key", "start")])
    texts = found.drop("grams").join(named, same[0] & same[1] & same[2]).select("doc_id", "text_key", "start", "passage", "item_id")
    right = items.select(F.col("item_id").alias("i"), F.col("text").alias("item"))
    texts = texts.join(right, F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
    scored = map_batches(
        texts, lambda batch: _align_batch(batch, least), "doc_id long, text_key long, item_id long, score double, start long, end long"
    ).where(F.col("score") >= least)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("best")
    return scored.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "best.*")
