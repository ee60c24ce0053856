"""Repeated passages by MinHash banding of paragraphs.

Texts are cut into short paragraphs where the hash of a word is the least around, so a
passage is cut alike wherever it stands.  Paragraphs that collide in a band are joined,
their exact Jaccard similarity decides, and components of similar paragraphs are classes.
A class keeps its occurrences in the document with the least id.  Runs of neighbouring
paragraphs that recur across documents are extended word by word on both sides, as far as
the same words stand there in another document, and runs with a small gap between them,
where words were changed, are one passage.

Extensions need no pairs: the hashes of a paragraph's class and of 1, 2, 3 ... words beside
it are counted over documents, and the longest that two documents have is the extension.

``BANDS`` bands of ``ROWS`` minima find a pair of similarity 0.8 with probability
1 - (1 - 0.8 ** 2) ** 4 = 0.983; equal paragraphs are always found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.components import components
from gleanframe.llm.links import links
from gleanframe.llm.tables import kept, key_filter, map_batches, maybe
from gleanframe.llm.words import Words, lists, mix, shingles, signed, word_hashes, words

# A cut stands before a word whose hash is the least of so many words on either side.
REACH = 6
# Stretches without such a word are cut into pieces of this many words.
LONGEST = 48
SHINGLE, NUM, DEN = 5, 8, 10
BANDS, ROWS = 4, 2
# A passage is reported from so many repeated words on, with gaps of one paragraph or
# ``REACH`` words at most between extended runs.
MIN_WORDS = 24
MAX_GAP = 2


def paragraphs(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every paragraph of a batch, and the paragraphs of each row."""
    n = len(hashes)
    rows = w.rows
    least = np.ones(n, dtype=bool)
    for k in range(1, REACH + 1):
        inside = rows[k:] == rows[:-k]
        # Ties go to the first word; near the ends of a text nothing is cut.
        least[k:] &= (hashes[k:] < hashes[:-k]) & inside
        least[:-k] &= (hashes[:-k] <= hashes[k:]) & inside
        least[:k] = False
        least[n - k :] = False
    least[w.first[:-1][w.counts > 0]] = True
    starts = np.flatnonzero(least)
    sizes = np.diff(np.append(starts, n))
    parts = -(-sizes // LONGEST)
    begin = np.cumsum(parts) - parts
    starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(begin, parts)) * LONGEST
    return starts, np.searchsorted(starts, w.first)


def minima(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band keys of each paragraph, one row per band."""
    keys = []
    for band in range(BANDS):
        key = np.full(len(first) - 1, band + 1, dtype=np.uint64)
        for row in range(ROWS):
            salt = np.uint64(0x9E3779B97F4A7C15 * (band * ROWS + row + 1) % (1 << 64))
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(grams ^ salt), first[:-1]))
        keys.append(key)
    return np.stack(keys)


class _Batch:
    """Paragraphs of a batch of texts with their hashes."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = words(texts, lower=True)
        hashes = word_hashes(self.words)
        starts, self.per_row = paragraphs(self.words, hashes) if len(hashes) else (np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
        self.bounds = np.append(starts, len(hashes)).astype(np.int64)
        self.sizes = np.diff(self.bounds)
        self.grams = shingles(hashes, self.bounds, SHINGLE, whole=True)
        whole = shingles(hashes, self.bounds, 1)
        # A content hash depends on all words in order.
        place = np.arange(len(hashes)) - np.repeat(self.bounds[:-1], self.sizes)
        value = mix(whole.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.add.reduceat(value, self.bounds[:-1]) if len(starts) else np.zeros(0, np.uint64)
        self.content = mix(total + self.sizes.astype(np.uint64))
        self.keys = minima(self.grams.hashes, self.grams.first) if len(starts) else np.zeros((BANDS, 0), np.uint64)
        self.rows = np.repeat(np.arange(len(texts)), np.diff(self.per_row))


def _band_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    b = _Batch(batch.column("text"))
    keys = {"token": pa.array(signed(b.keys.ravel())), "id": pa.array(np.tile(signed(b.content), BANDS))}
    return pa.RecordBatch.from_pydict(keys)


FOUND = (
    "doc_id long, text_key long, place int, start long, end long, w0 int, w1 int, id long, "
    "tokens array<bigint>, items array<bigint>"
)


def _recurring(docs: DataFrame, again: np.ndarray, shared: np.ndarray) -> DataFrame:
    """Paragraphs that may recur; those that may be near others carry band keys and shingles."""
    spark = docs.sparkSession
    again, shared = spark.sparkContext.broadcast(again), spark.sparkContext.broadcast(shared)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = _Batch(batch.column("text"))
        keys = signed(b.keys)
        near = maybe(shared.value, keys.ravel()).reshape(keys.shape)
        use = np.flatnonzero(maybe(again.value, keys[0]) | near.any(axis=0))
        w = b.words
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int32)]).astype(np.int64)
        rows = b.rows[use]
        head = chars[w.offsets[rows]]
        tokens, items = [], []
        for p in use:
            hit = near[:, p]
            tokens.append(keys[hit, p])
            gram = b.grams.hashes[b.grams.first[p] : b.grams.first[p + 1]]
            items.append(signed(np.unique(gram)) if hit.any() else np.zeros(0, np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, items)]
        upto = [np.concatenate([[0], np.cumsum([len(i) for i in x], dtype=np.int64)]) for x in (tokens, items)]
        columns = {
            "doc_id": batch.column("doc_id").take(pa.array(rows)),
            "text_key": batch.column("text_key").take(pa.array(rows)),
            "place": pa.array((use - b.per_row[rows]).astype(np.int32)),
            "start": pa.array(chars[w.starts[b.bounds[use]]] - head),
            "end": pa.array(chars[w.ends[b.bounds[use + 1] - 1]] - head),
            "w0": pa.array((b.bounds[use] - w.first[rows]).astype(np.int32)),
            "w1": pa.array((b.bounds[use + 1] - w.first[rows]).astype(np.int32)),
            "id": pa.array(signed(b.content)[use]),
            "tokens": lists(pa.array(flat[0], pa.int64()), upto[0]),
            "items": lists(pa.array(flat[1], pa.int64()), upto[1]),
        }
        return pa.RecordBatch.from_pydict(columns)

    return map_batches(docs, run, FOUND)


def similar(a: str, b: str) -> Column:
    """Exact Jaccard similarity of at least NUM / DEN, from the whole shingle sets."""
    common = F.size(F.array_intersect(f"{a}.items", f"{b}.items"))
    sizes = F.size(f"{a}.items"), F.size(f"{b}.items")
    met = common * (NUM + DEN) >= (sizes[0] + sizes[1]) * NUM
    return (F.least(*sizes) * DEN >= F.greatest(*sizes) * NUM) & met


EDGES = "doc_id long, text_key long, run long, side int, k int, pos long, key long"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIDES = np.array([0x632BE59BD9B4E019, 0xD1B54A32D192ED03], dtype=np.uint64)


def _edge_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for every number of words beside both ends of each run.

    Words are taken up to the second cut before and after: the first is within ``REACH``
    words of the end of what two documents have in common, or its paragraph would recur.
    """
    w = words(batch.column("text"), lower=True)
    hashes = word_hashes(w)
    cuts = np.append(paragraphs(w, hashes)[0], len(hashes)) if len(hashes) else np.zeros(0, np.int64)
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int32)]).astype(np.int64)
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for r, runs in enumerate(batch.column("runs").to_pylist()):
        low, high, head = w.first[r], w.first[r + 1], chars[w.offsets[r]]
        for one in runs:
            a, b = low + one["w0"], low + one["w1"]
            i, j = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
            left = np.arange(a - 1, max(low, cuts[max(i - 2, 0)]) - 1, -1)
            right = np.arange(b, min(high, cuts[min(j + 2, len(cuts) - 1)]))
            for side, at, anchor in ((0, left, one["lc"]), (1, right, one["rc"])):
                k = np.arange(1, len(at) + 1)
                start = mix(np.array([anchor], np.int64).view(np.uint64) + _SIDES[side])
                key = mix(start + np.cumsum(mix(hashes[at] + k.astype(np.uint64) * _STEP)))
                place = chars[w.ends[at] if side else w.starts[at]] - head
                full = [np.full(len(at), x, np.int64) for x in (r, one["run"], side)]
                for column, values in zip(out, (*full, k, place, signed(key))):
                    column.append(values)
    row, run, side, k, pos, key = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id").take(pa.array(row)),
            "text_key": batch.column("text_key").take(pa.array(row)),
            "run": pa.array(run),
            "side": pa.array(side.astype(np.int32)),
            "k": pa.array(k.astype(np.int32)),
            "pos": pa.array(pos),
            "key": pa.array(key),
        }
    )


def _extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with ``w0``, ``start``, ``w1`` and ``end`` moved outwards over words that recur."""
    name = ["doc_id", "text_key"]
    edges = runs.groupBy(*name).agg(F.collect_list(F.struct("run", "w0", "w1", "lc", "rc")).alias("runs"))
    rows = kept(map_batches(docs.join(edges, name), _edge_rows, EDGES))
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    most = lambda side: F.max(F.when(F.col("side") == side, F.struct("k", "pos")))
    found = rows.join(keys.select("key"), "key", "left_semi").groupBy(*name, "run").agg(
        most(0).alias("left"), most(1).alias("right")
    )
    return runs.join(found, [*name, "run"], "left").withColumns(
        {
            "start": F.coalesce("left.pos", "start"),
            "end": F.coalesce("right.pos", "end"),
            "w0": F.col("w0") - F.coalesce("left.k", F.lit(0)),
            "w1": F.col("w1") + F.coalesce("right.k", F.lit(0)),
        }
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that occur in more than one document, one row per occurrence.

    ``(doc_id, start, end, n_words, removed, first_docs, classes)``: code points, end
    exclusive; the repeated words inside; false for ``removed`` if all its paragraphs are
    the kept occurrences; the documents that keep them; and the paragraphs' class ids.
    ``first_docs`` of a kept passage is its own document.

    Null and empty texts have no paragraphs.  Words are compared with A-Z lower-cased.
    Rows with a null doc_id take part in no class.  Repeated rows (equal id and text) are
    one document, and rows with equal ids but other texts belong to one document, so they
    don't repeat each other.  Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")
    )
    bands = map_batches(docs.select("text"), _band_rows, "token long, id long")
    counts = bands.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    often = kept(counts.where("n > 1").select("token", (F.col("lo") != F.col("hi")).alias("shared")))
    shared = often.where("shared").select("token")
    found = kept(_recurring(docs, key_filter(F.col("token"), often), key_filter(F.col("token"), shared)).distinct())

    near = found.where(F.size("tokens") > 0).select("id", "items", F.explode("tokens").alias("token"))
    near = near.join(shared, "token", "left_semi").dropDuplicates(["token", "id"])
    labels = components(links(near, similar, lambda pairs: pairs, matches=False))
    named = found.drop("tokens", "items").join(labels, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    classes = named.groupBy("component").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    recurring = named.join(classes.where("first_doc < last_doc").drop("last_doc"), "component")
    # One document's paragraphs meet in a window, and then its runs.
    in_text = Window.partitionBy("doc_id", "text_key").orderBy("place")
    new = (F.col("place") - F.lag("place").over(in_text) > 1).cast("int")
    pieces = recurring.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(in_text))
    runs = pieces.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("w0").alias("w0"),
        F.max("w1").alias("w1"),
        F.min("place").alias("head"),
        F.max("place").alias("tail"),
        F.min_by("component", "place").alias("lc"),
        F.max_by("component", "place").alias("rc"),
        F.max(F.col("first_doc") != F.col("doc_id")).alias("removed"),
        F.collect_set("first_doc").alias("first_docs"),
        F.collect_set("component").alias("classes"),
    )
    in_text = Window.partitionBy("doc_id", "text_key").orderBy("run")
    before = in_text.rowsBetween(Window.unboundedPreceding, -1)
    runs = _extended(docs, kept(runs)).withColumn("upto", F.coalesce(F.max("w1").over(before), F.lit(0)))
    apart = (F.col("head") - F.lag("tail").over(in_text) > MAX_GAP) & (F.col("w0") - F.col("upto") > REACH)
    runs = runs.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0)))
    own = F.greatest(F.col("w1") - F.greatest("w0", "upto"), F.lit(0))
    every = lambda name: F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return (
        runs.withColumn("passage", F.sum("new").over(in_text))
        .groupBy("doc_id", "text_key", "passage")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum(own).cast("long").alias("n_words"),
            F.max("removed").alias("removed"),
            every("first_docs"),
            every("classes"),
        )
        .where(F.col("n_words") >= MIN_WORDS)
        .drop("text_key", "passage")
    )
