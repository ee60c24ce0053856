"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct word shingles, in one global order: rarer first by a
count of all shingles of the corpus in a table of fixed size, then by hash.  Two sets that
reach the threshold share at least ``ell`` tokens in their prefixes of length
``n - ceil(t * n) + ell``.  A document with costly prefix tokens takes a larger ``ell``:
more tokens to match, fewer candidates to verify.  Any order and any ``ell`` is exact.

Equal sets are one set from the start, large groups of near copies are linked through a
hub (:mod:`gleanframe.llm.links`), and verification compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.components import components
from gleanframe.llm.links import links
from gleanframe.llm.tables import cut, kept, key_filter, map_batches, maybe, settled
from gleanframe.llm.words import lists, mix, shingles, signed, word_hashes, words

# Cells of the count table: a byte each in the end, whatever the corpus holds.
CELLS = 1 << 22
CELLS_PER_ROW = 1 << 14
# Partial count tables are added up in groups of tasks first.
TASK_GROUPS = 64
MAX_MATCHES = 16
# Cost of verifying a candidate, in looked-up postings, per shingle of its set.
VERIFY_COST = 1 / 16
# Words of 64 bits in a set's parity sketch.
SKETCH = ("s0", "s1", "s2", "s3")
SKETCH_SCHEMA = "".join(f", {name} long" for name in SKETCH)

BESIDE_SCHEMA = ", prev long, next long, at long, next_lost long, next_level long"


@dataclass(frozen=True)
class Join:
    """Words per shingle, the threshold as a fraction, and rounds of hubs before pairs are compared in full.

    The lower the threshold, the more members of a group of copies aren't near its first hub.
    """

    words: int = 3
    num: int = 90
    den: int = 100
    rounds: int = 0

    def base_prefix(self, n: np.ndarray) -> np.ndarray:
        """Prefix length for one match: n - ceil(n * num / den) + 1."""
        return n - -(-n * self.num // self.den) + 1


def document_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    w = words(texts, lower=True)
    grams = shingles(word_hashes(w), w.first, size, whole=True)
    for r in range(len(texts)):
        yield np.unique(grams.hashes[grams.first[r] : grams.first[r + 1]])


def set_id(items: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = np.add.reduce(mix(items)) if len(items) else np.uint64(0)
    return int(signed(mix(np.array([total + np.uint64(len(items))], np.uint64)))[0])


def parities(items: np.ndarray) -> np.ndarray:
    """Bit ``b``: whether an odd number of the set's items fall on ``b``.

    An item that only one of two sets has flips one bit, so the sketches of two sets differ
    in at most as many bits as the sets differ in items.
    """
    odd = np.bincount((items >> np.uint64(32) & np.uint64(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_ranks(docs: DataFrame, join: Join) -> np.ndarray:
    """How many documents hold the shingles of each cell, over the whole corpus, as a rank.

    Ranks are quarter octaves.  Each task adds up its documents in one table; tables are summed cell by cell in Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            for items in chain.from_iterable(document_sets(b.column("text"), join.words) for b in cut(batch)):
                np.add.at(cells, (items & np.uint64(CELLS - 1)).astype(np.int64), 1)
        rows = cells.reshape(-1, CELLS_PER_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(used, pa.int32()), "counts": pa.array([rows[i].tobytes() for i in used], pa.binary())}
            )

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS_PER_ROW, np.int64)
        for part in table["counts"]:
            total += np.frombuffer(part.as_py(), np.int64 if len(part.as_py()) == 8 * CELLS_PER_ROW else np.int32)
        return pa.table({"block": table["block"].slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, schema)
    grouped = parts.withColumn("task", F.spark_partition_id() % TASK_GROUPS)
    once = grouped.groupBy("block", "task").applyInArrow(summed, schema)
    def ranked(table: pa.Table) -> pa.Table:
        counts = np.frombuffer(summed(table)["counts"][0].as_py(), np.int64)
        ranks = np.minimum(np.log2(counts + 1.0) * 4, 255).astype(np.uint8)
        return pa.table({"block": table["block"].slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    total = np.zeros((CELLS // CELLS_PER_ROW, CELLS_PER_ROW), np.uint8)
    # CELLS bytes in all.
    for row in once.groupBy("block").applyInArrow(ranked, "block int, ranks binary").collect():
        total[row["block"]] = np.frombuffer(row["ranks"], np.uint8)
    return total.ravel()


def ordered_tokens(items: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Tokens in the global order: the rank of their count above 56 bits of hash."""
    rank = ranks[(items & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort(rank << np.uint64(56) | items >> np.uint64(8))


def matches_for(hits: np.ndarray, first: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's number of matches with the least estimated cost, and whether it may be linked.

    ``hits`` marks the prefix tokens that other prefixes share.  With ``ell`` matches their
    postings are looked up, and at most their number divided by ``ell`` sets are candidates
    per posting.  A set with fewer than ``ell`` shared tokens in the prefix for ``ell``, for
    any ``ell``, is linked with nothing.
    """
    upto = np.concatenate([[0], np.cumsum(hits)])
    best, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    may = np.ones(len(n), bool)
    for ell in range(1, MAX_MATCHES + 1):
        valid = base + ell - 1 <= n
        end = np.where(valid, first[:-1] + base + ell - 1, first[:-1])
        shared = upto[end] - upto[first[:-1]]
        may &= ~valid | (shared >= ell)
        cost = shared + shared / ell * (1 + n * VERIFY_COST)
        better = valid & (cost < least)
        best, least = np.where(better, ell, best), np.where(better, cost, least)
    return best, may


def beside(token: np.ndarray, row: np.ndarray, ids: np.ndarray, lost: np.ndarray, level: np.ndarray) -> dict[str, np.ndarray]:
    """Each token's place in its row and the tokens before and after; where there is none, the id, which no other row has."""
    heads = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    tails = np.append(heads[1:], True) if len(row) else heads
    at = np.arange(len(row)) - np.maximum.accumulate(np.where(heads, np.arange(len(row)), 0))
    return {
        "prev": np.where(heads, ids, np.roll(token, 1)),
        "next": np.where(tails, ids, np.roll(token, -1)),
        "at": at,
        "next_lost": np.roll(lost, -1),
        "next_level": np.roll(level, -1),
    }


def prefixes(docs: DataFrame, join: Join, ranks: np.ndarray) -> DataFrame:
    """``(doc_id, text_key, n, id, tokens, s0 ...)``: each document's set size, name, longest prefix and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, names, tokens, upto, sketches = [], [], [], [0], []
        for items in document_sets(batch.column("text"), join.words):
            n = len(items)
            order = ordered_tokens(items, shared.value)
            base = int(join.base_prefix(np.int64(n))) if n else 0
            take = order[: base + MAX_MATCHES - 1] if n else order[:0]
            sizes.append(n)
            names.append(set_id(items))
            tokens.append(take)
            upto.append(upto[-1] + len(take))
            sketches.append(parities(items))
        flat = pa.array(signed(np.concatenate(tokens)))
        sketch = np.stack(sketches, axis=1)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n": pa.array(sizes, pa.int64()),
                "id": pa.array(names, pa.int64()),
                "tokens": lists(flat, np.array(upto)),
                **{name: pa.array(sketch[k]) for k, name in enumerate(SKETCH)},
            }
        )

    return map_batches(docs, run, "doc_id long, text_key long, n long, id long, tokens array<bigint>" + SKETCH_SCHEMA)


def _buckets(sets: DataFrame, join: Join) -> DataFrame:
    """Rows of tokens that different sets share, with what bounds a pair's overlap.

    ``lost`` counts prefix tokens before this one that no other prefix has.  Had the partner
    one of them, it would stand in its prefix too, before the common token; so the overlap
    is at most ``n - lost``.
    """
    rows = sets.where("n > 0").select("id", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = kept(shared.where("lo <> hi").select("token"))
    bitmap = sets.sparkSession.sparkContext.broadcast(key_filter(F.col("token"), shared))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed = batch.column("tokens")
        flat = listed.flatten().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.diff(listed.offsets.to_numpy()))])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(flat)) - first[row]
        hit = maybe(bitmap.value, flat)
        n = batch.column("n").to_numpy()
        base = join.base_prefix(n)
        ell, may = matches_for(hit, first, base, n)
        missed = np.concatenate([[0], np.cumsum(~hit)])
        lost = missed[:-1] - missed[first[row]]
        level = np.maximum(1, place - base[row] + 2)
        # A set can't reach the threshold once it has lost more than the rest may differ.
        use = hit & may[row] & (level <= ell[row]) & ((n[row] - lost) * join.den >= n[row] * join.num)
        out = {
            "token": flat, "id": batch.column("id").to_numpy()[row], "n": n[row], "lost": lost, "level": level,
            "ell": ell[row], **{name: batch.column(name).to_numpy()[row] for name in SKETCH},
        }
        out = {k: v[use] for k, v in out.items()} | beside(flat[use], row[use], out["id"][use], lost[use], level[use])
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    schema = "token long, id long, n long, lost long, level long, ell long" + SKETCH_SCHEMA + BESIDE_SCHEMA
    found = map_batches(sets.where("n > 0").select("id", "n", "tokens", *SKETCH), run, schema)
    return found.distinct().join(shared, "token", "left_semi")


def _whole_sets(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """``(id, items)`` of the sets named, each once."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(F.col("id"), ids))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, items, upto = [], [], [0]
        for one in document_sets(batch.column("text"), join.words):
            name = set_id(one)
            if len(one) and maybe(bitmap.value, np.array([name]))[0]:
                names.append(name)
                items.append(one)
                upto.append(upto[-1] + len(one))
        flat = pa.array(signed(np.concatenate(items))) if items else pa.array([], pa.int64())
        return pa.RecordBatch.from_pydict({"id": pa.array(names, pa.int64()), "items": lists(flat, np.array(upto))})

    found = map_batches(docs.select(F.col("text").cast("string")), run, "id long, items array<bigint>")
    # Copies have equal items, so any one of them will do.
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def jaccard_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``(doc_id, text_key, id, n, component, component_id)`` per row of ``docs``.

    ``text_key`` is a hash of the text, ``id`` names the row's set, ``component`` its class of linked sets and ``component_id``
    is the least doc_id of the class.  A null text or one without words has an empty set,
    is linked with nothing and is a class of its own.  Null ids never name a class (a class
    of rows without ids has a null one).  Repeated rows are equal sets, hence one class;
    extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    sets = kept(prefixes(docs, join, shingle_ranks(docs, join)))
    buckets = kept(_buckets(sets, join))

    def possible(a: str, b: str, lost: str = "lost") -> Column:
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        bound = F.least(n - F.col(f"{a}.{lost}"), m - F.col(f"{b}.{lost}"))
        # Linked sets differ in few items, so their sketches differ in few bits.
        apart = reduce(add, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH])
        near = apart * (join.num + join.den) <= (n + m) * (join.den - join.num)
        return (bound * (join.num + join.den) >= (n + m) * join.num) & near

    def verify(pairs: DataFrame) -> DataFrame:
        return settled(lambda: linked(kept(pairs)))

    def linked(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        items = kept(_whole_sets(docs, named, join))
        left = items.select(F.col("id").alias("a"), F.col("items").alias("of_a"))
        right = items.select(F.col("id").alias("b"), F.col("items").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        total = F.size("of_a") + F.size("of_b")
        met = common * (join.num + join.den) >= total * join.num
        return pairs.join(left, "a").join(right, "b").where(met).select("a", "b")

    labels = components(links(buckets, possible, verify, matches=True, rounds=join.rounds))
    named = sets.select("doc_id", "text_key", "id", "n").join(labels, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    least = named.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", "text_key", "id", "n", "component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )
