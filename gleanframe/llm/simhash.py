"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints at most ``RADIUS`` bits apart have a common variant: a word at most half of
that from both.  So every distinct fingerprint stands for all its variants within half the
radius, and fingerprints of equal variants meet.  Any two that meet at a variant are linked
by the triangle inequality, so a variant's members are joined to one of them, never in
pairs.

The shuffle doesn't carry each variant by itself.  A variant is sent by ``ROUTE_BITS`` of its
bits, together with all others of its fingerprint that agree there, as one row ``(route,
fingerprint)``; its task writes the variants out again.  A route with more than ``MAX_ROUTE``
variants is split by further bits, round after round, until none has more or all bits are
used, so a group of near copies is dealt to as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.components import components
from gleanframe.llm.tables import kept, map_batches
from gleanframe.llm.words import words

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
# Bits that route a variant at first and bits added when a route is split.
ROUTE_BITS = 12
SPLIT_BITS = 8
# Variants of a route above which it is split.
MAX_ROUTE = 1 << 26
# Variants that a task holds at a time.
VARIANTS = 1 << 22
# Shingles hashed at a time.
BLOCK = 1 << 14


def fingerprint(data: bytes, starts: list[int], ends: list[int]) -> int:
    """A bit is one if more than half of the shingles' hashes have it; ``data`` has words one space apart."""
    if not starts:
        return 0
    n = max(1, len(starts) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        tails = ends[i + SHINGLE - 1 : j + SHINGLE - 1] or ends[-1:]
        hashes = [digest(data[a:b], SEED) for a, b in zip(starts[i:j], tails)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = words(batch.column("text"), lower=True)
    # Words of the batch one space apart: every run of white space becomes one byte.
    sizes = w.ends - w.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    space = np.ones(len(joined), bool)
    space[ends] = False
    joined[space] = w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    out = np.zeros(batch.num_rows, np.uint64)
    for r in range(batch.num_rows):
        i, j = w.first[r], w.first[r + 1]
        if i < j:
            at = int(starts[i])
            data = joined[at : int(ends[j - 1])].tobytes()
            out[r] = fingerprint(data, (starts[i:j] - at).tolist(), (ends[i:j] - at).tolist())
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(out.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of the whole text of every document."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(picked, _fingerprints, "doc_id long, fp long")


def balanced(prints: DataFrame) -> list[int]:
    """Bits by how evenly the fingerprints split on them, the most even first; one row of counts."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    row = prints.agg(F.count("*").alias("n"), *ones).first()
    return sorted(range(BITS), key=lambda b: (abs(2 * (row[f"b{b}"] or 0) - row["n"]), b))


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _flips(bits: Sequence[int], most: int) -> list[tuple[int, int]]:
    """``(mask, number of bits)`` of every choice of at most ``most`` of the bits."""
    masks = [(0, 0)]
    for b in bits:
        masks += [(m | 1 << b, n + 1) for m, n in masks if n < most]
    return masks


def _routed(rows: DataFrame, bits: list[int], reach: int) -> DataFrame:
    """Each row once for every way to flip some of ``bits`` with the flips it has left.

    ``route`` is the variant's value on the routing bits, ``left`` the flips for all others.
    """
    masks = _flips(bits, reach)
    ways = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(n).alias("n")) for m, n in masks])
    out = rows.select("fp", "route", "left", F.explode(ways).alias("way")).where("way.n <= left")
    route = F.col("route").bitwiseOR(F.col("fp").bitwiseXOR(F.col("way.mask")).bitwiseAND(F.lit(_mask(bits))))
    return out.select("fp", route.alias("route"), (F.col("left") - F.col("way.n")).alias("left"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def routes(prints: DataFrame, reach: int, max_route: int = MAX_ROUTE) -> list[tuple[list[int], DataFrame]]:
    """``(bits used, rows (fp, route, left))``: every variant of every fingerprint in one route."""
    order = balanced(prints)
    used, rows = order[:ROUTE_BITS], None
    start = prints.select("fp", F.lit(0).cast("long").alias("route"), F.lit(reach).alias("left"))
    rows = _routed(start, used, reach)
    done = []
    while len(used) < BITS:
        free = range(BITS - len(used))
        per = F.element_at(F.array(*[F.lit(len(_flips(free, n))) for n in range(reach + 1)]), F.col("left") + 1)
        full = kept(rows.groupBy("route").agg(F.sum(per).alias("n")).where(F.col("n") > max_route).select("route"))
        if full.isEmpty():
            break
        done.append((used, rows.join(full, "route", "left_anti")))
        more = order[len(used) : len(used) + SPLIT_BITS]
        rows = kept(_routed(rows.join(full, "route", "left_semi"), more, reach))
        used = used + more
    return [*done, (used, rows)]


def _variants(fps: np.ndarray, left: np.ndarray, free: list[int], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``(variant, index of its fingerprint)``; all of a fixed part are in one block.

    Free bits beyond what fits into a block are fixed one after the other, which keeps a
    block's variants complete for the values it covers.
    """
    per = [len(_flips(free, n)) for n in range(reach + 1)]
    if not free or sum(per[int(n)] * int(c) for n, c in zip(*np.unique(left, return_counts=True))) <= VARIANTS:
        values, owners = [], []
        for n in range(reach + 1):
            at = np.flatnonzero(left == n)
            masks = np.array([m for m, _ in _flips(free, n)], np.uint64)
            values.append((fps[at][:, None] ^ masks).ravel())
            owners.append(np.repeat(at, len(masks)))
        yield np.concatenate(values), np.concatenate(owners)
        return
    bit = np.uint64(1 << free[0])
    for value in (np.uint64(0), bit):
        same = (fps & bit) == value
        can = same | (left > 0)
        at = np.flatnonzero(can)
        moved = np.where(same[at], fps[at], fps[at] ^ bit)
        for variant, owner in _variants(moved, left[at] - ~same[at], free[1:], reach):
            yield variant, at[owner]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index connected with each of ``n``, by hooking and shortcuts."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def meet(fps: np.ndarray, left: np.ndarray, free: list[int], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(least of its component, fingerprint)`` between fingerprints of one route.

    Of the members of a variant each is linked with one of them.  The check of the distance is
    for safety: it always holds.
    """
    order = np.argsort(fps, kind="stable")
    fps, left = fps[order], left[order]
    root = np.arange(len(fps))
    # Of a route's variants the routing bits are equal; only the others tell them apart.
    rest = fps & np.uint64(sum(1 << b for b in free))
    for variant, owner in _variants(rest, left, free, reach):
        by = np.argsort(variant)
        variant, owner = variant[by], owner[by]
        head = np.concatenate([[True], variant[1:] != variant[:-1]])
        first = owner[np.flatnonzero(head)][np.cumsum(head) - 1]
        pair = np.flatnonzero(~head)
        near = np.bitwise_count(fps[first[pair]] ^ fps[owner[pair]]) <= 2 * reach
        links = np.unique(np.stack([root[first[pair[near]]], root[owner[pair[near]]]]), axis=1)
        root = _forest(links[0], links[1], len(fps))[root]
    tied = root != np.arange(len(fps))
    return fps[root[tied]], fps[tied]


def _met(rows: DataFrame, used: list[int], reach: int) -> DataFrame:
    free = [b for b in range(BITS) if b not in set(used)]

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = meet(fps, table.column("left").to_numpy().astype(np.int64), free, reach)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return rows.groupBy("route").applyInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, radius: int = RADIUS, max_route: int = MAX_ROUTE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document.

    ``fingerprint`` has 16 hexadecimal digits.  ``component_id`` is the least doc_id that can
    be reached by links of at most ``radius`` (an even number) differing bits.  A null or
    wordless text has the fingerprint zero and is linked like any other; repeated rows are
    linked with each other; null ids take part, and a component of null ids alone has a null
    ``component_id``.  Other columns play no part, and an empty table gives no rows.
    """
    docs = kept(fingerprints(docs))
    prints = kept(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reach = radius // 2
    links = None
    for used, rows in routes(prints.select("fp"), reach, max_route):
        met = _met(rows, used, reach)
        links = met if links is None else links.unionByName(met)
    labels = components(kept(links.distinct()))
    named = prints.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = kept(named.join(least, "component").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return docs.join(classes, "fp").select("doc_id", hexed, "component_id")
