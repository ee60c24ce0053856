"""Language-model scores: a unigram base and context-tree weighting over bytes.

The model reads a text as its lower-cased words, each followed by a space, and one end
byte.  A byte is eight binary decisions; every decision has a context tree over the
``DEPTH`` bytes before it, whose nodes estimate by Krichevsky-Trofimov and are weighted
over all depths.  With counts fixed after training, the probability of a bit mixes the
estimates of the nodes on its context's path that training has seen.

Counts of byte (DEPTH + 1)-grams are gathered over the whole corpus.  Trees meet in groups by
their two nearest context bytes, of at most 256 ** (DEPTH - 1) grams, and above that per
bit prefix, of at most 65,536 nodes: bounds that don't depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import cut, kept
from gleanframe.llm.words import Words, lists, signed, word_hashes, words

DEPTH = 5
END, SPACE = 0x0A, 0x20
# Documents whose crc32(doc_id) mod 7 is this are held out.
HELD_OUT = 2
# The most frequent words are looked up in the task, all others in a join.
FREQUENT_WORDS = 1 << 18
# Gram tables of up to so many rows (12 bytes each) are broadcast; beyond, grams are joined.
BROADCAST_GRAMS = 6_000_000
# Partial counts are handed on when a task holds so many.
FLUSH = 2_000_000
WORD, GRAM = 0, 1
# A gram and a row of a slice together fit a bigint.
GRAM_BITS = 8 * (DEPTH + 1)
ROW_BITS = 63 - GRAM_BITS


def byte_stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The model's bytes of all rows, each row led by DEPTH end bytes, and where rows begin."""
    sizes = w.ends - w.starts + 1
    upto = np.concatenate([[0], np.cumsum(sizes)])
    rows = upto[w.first]
    first = rows + np.arange(len(rows)) * (DEPTH + 1)
    out = np.full(first[-1], END, dtype=np.uint8)
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], sizes)
    begin = upto[:-1] + (w.rows + 1) * (DEPTH + 1) - 1
    target = np.repeat(begin, sizes) + place
    source = np.repeat(w.starts, sizes) + place
    last = place == np.repeat(sizes - 1, sizes)
    out[target] = np.where(last, SPACE, w.data[np.minimum(source, max(len(w.data) - 1, 0))])
    return out, first


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The gram ending at every byte of the model's text, and where rows begin."""
    stream, first = byte_stream(w)
    n = max(len(stream) - DEPTH, 0)
    value = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        value <<= 8
        value |= stream[k : k + n]
    # Places whose gram reaches back over the row's head belong to the row before.
    keep = np.ones(n, bool)
    heads = first[1:-1]
    for k in range(1, DEPTH + 1):
        keep[heads - k] = False
    counts = np.diff(first) - DEPTH
    return value[keep], np.concatenate([[0], np.cumsum(counts)])


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, weights=weights, minlength=len(distinct)).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(kind, key, n)``: training counts of words and byte grams.

    Grams that only held-out texts have are there with ``n = 0``, since they get scored too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, n = _counted(*[np.concatenate(x) for x in zip(*parts)])
                    kinds = np.full(len(keys), kind, np.int32)
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds), "key": pa.array(keys), "n": pa.array(n)})
                parts.clear()

        for batch in batches:
            for part in cut(batch):
                trains = ~part.column("held_out").to_numpy(zero_copy_only=False)
                w = words(part.column("text"), lower=True)
                in_training = trains[w.rows]
                if in_training.any():
                    held[WORD].append(np.unique(signed(word_hashes(w))[in_training], return_counts=True))
                value, first = grams(w)
                trained = np.repeat(trains, np.diff(first))
                others = np.unique(value[~trained])
                held[GRAM].append((others, np.zeros(len(others), np.int64)))
                held[GRAM].append(np.unique(value[trained], return_counts=True))
                size += len(others)
                size += len(held[GRAM][-1][0]) + (len(held[WORD][-1][0]) if held[WORD] else 0)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select("held_out", "text").mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- context-tree weighting -------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from 8 on."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(x), 0)
        x += low
    inverse = 1 / x
    series = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


# Logarithms of the gamma function at n + 1/2 and n + 1 for the counts most nodes have.
COUNTS = 4096
_HALF, _WHOLE = (log_gamma(np.arange(COUNTS) + x) for x in (0.5, 1.0))


def _log_gamma_at(n: np.ndarray, values: np.ndarray, add: float) -> np.ndarray:
    out = values[np.minimum(n, COUNTS - 1).astype(np.int64)]
    large = n >= COUNTS
    if large.any():
        out[large] = log_gamma(n[large] + add)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones under the Krichevsky-Trofimov estimate."""
    halves = _log_gamma_at(n0, _HALF, 0.5) + _log_gamma_at(n1, _HALF, 0.5)
    return halves - _log_gamma_at(n0 + n1, _WHOLE, 1.0) - np.log(np.pi)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the share of their own estimate in the mix."""
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _nodes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values, and each row's place among them; sorted input isn't sorted again."""
    if (key[1:] >= key[:-1]).all():
        new = np.concatenate([[True], key[1:] > key[:-1]])
        return key[new], np.cumsum(new) - 1
    return np.unique(key, return_inverse=True)


class Tree:
    """Nodes of one bit prefix length over contexts of DEPTH to 2 bytes, in numpy.

    ``key`` names the deepest node of each gram, its context above the bit prefix, and
    leaving out the farthest byte names the node above.  A level is built from the level
    below, so only the deepest one looks at every gram.
    """

    def __init__(self, key: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        self.levels = []
        names, at = _nodes(key)
        self.gram = at
        n0 = np.bincount(at, weights=n * (bit == 0), minlength=len(names))
        n1 = np.bincount(at, weights=n * (bit == 1), minlength=len(names))
        log, share = log_kt(n0, n1), np.ones(len(names))
        at = np.arange(len(names))
        self.levels.append((at, n0, n1, share))
        for d in range(DEPTH - 1, 1, -1):
            names, at = _nodes(names & ((1 << 8 * (d - 1)) - 1))
            n0, n1, below = (np.bincount(at, weights=x, minlength=len(names)) for x in (n0, n1, log))
            log, share = weigh(log_kt(n0, n1), below)
            self.levels.append((at, n0, n1, share))
        self.names, self.n0, self.n1, self.log = names, n0, n1, log

    def ones(self) -> np.ndarray:
        """Per gram: the mixed probability of a one over the depths that training has seen."""
        place = np.arange(len(self.levels[0][0]))
        p, known = np.full(len(place), 0.5), np.zeros(len(place), bool)
        for at, n0, n1, share in self.levels:
            place = at[place]
            seen, own, part = (n0 + n1 > 0)[place], ((n1 + 0.5) / (n0 + n1 + 1))[place], share[place]
            mix = np.where(known, part * own + (1 - part) * p, own)
            p, known = np.where(seen, mix, p), known | seen
        return p[self.gram]


def _bits(key: np.ndarray, depth_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit prefix (with a leading one) before decision ``depth_bits``, and the bit."""
    byte = key & 0xFF
    return (1 << depth_bits) | (byte >> (8 - depth_bits)), (byte >> (7 - depth_bits)) & 1


def _trees(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    """Trees of grams in order with equal two nearest context bytes, from DEPTH up to depth 2."""
    for j in range(8):
        prefix, bit = _bits(key, j)
        yield prefix, bit, Tree((key >> 24) << 8 | prefix, bit, n)


def _in_order(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    key, n = group["key"].to_numpy(), group["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _lower(group: pd.DataFrame) -> pd.DataFrame:
    """Depth-2 nodes of a group: counts and weighted log probability."""
    key, n = _in_order(group)
    trees = [tree for _, _, tree in _trees(key, n)]
    out = {c: np.concatenate([getattr(tree, a) for tree in trees]) for c, a in (("prefix", "names"), ("n0", "n0"), ("n1", "n1"), ("log", "log"))}
    return pd.DataFrame({"near": (key[0] >> 8) & 0xFFFF, **out})


def _upper(group: pd.DataFrame) -> pd.DataFrame:
    """For each depth-2 node of one bit prefix: final p = scale * p2 + shift."""
    near, n0, n1 = (group[c].to_numpy() for c in ("near", "n0", "n1"))
    one, at = np.unique(near & 0xFF, return_inverse=True)
    m0, m1 = (np.bincount(at, weights=x, minlength=len(one)) for x in (n0, n1))
    log, share = weigh(log_kt(m0, m1), np.bincount(at, weights=group["log"].to_numpy(), minlength=len(one)))
    r0, r1 = m0.sum(keepdims=True), m1.sum(keepdims=True)
    _, top = weigh(log_kt(r0, r1), log.sum(keepdims=True))
    root, mid = (r1 + 0.5) / (r0 + r1 + 1), ((m1 + 0.5) / (m0 + m1 + 1))[at]
    share, mid_seen, seen = share[at], (m0 + m1 > 0)[at], n0 + n1 > 0
    scale1 = np.where(seen, 1 - share, 0.0)
    shift1 = np.where(seen, share * mid, mid)
    scale = np.where(mid_seen, (1 - top) * scale1, 0.0)
    shift = np.where(mid_seen, top * root + (1 - top) * shift1, root)
    return pd.DataFrame({"near": near, "prefix": group["prefix"].to_numpy(), "scale": scale, "shift": shift})


def _score(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Log10 probability of the byte of every gram of a group."""
    key, n = _in_order(group)
    scale, shift = np.zeros(256), np.full(256, 0.5)
    prefix = above["prefix"].to_numpy()
    scale[prefix], shift[prefix] = above["scale"].to_numpy(), above["shift"].to_numpy()
    total = np.zeros(len(key))
    for prefix, bit, tree in _trees(key, n):
        p = scale[prefix] * tree.ones() + shift[prefix]
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return pd.DataFrame({"key": key, "log10": total})


def gram_scores(counts: DataFrame) -> DataFrame:
    """``(key, log10)``: the model's log probability of the last byte of every gram."""
    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    table = counts.where(F.col("kind") == GRAM).select("key", "n", near.alias("near"))
    lower = table.groupBy("near").applyInPandas(_lower, "near long, prefix long, n0 double, n1 double, log double")
    upper = kept(lower.groupBy("prefix").applyInPandas(_upper, "near long, prefix long, scale double, shift double"))
    scored = table.groupBy("near").cogroup(upper.groupBy("near"))
    return scored.applyInPandas(_score, "key long, log10 double")


# --- scores -----------------------------------------------------------------------------


def lm_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``.

    Training leaves out documents whose crc32(doc_id as text) mod 7 is HELD_OUT; a null id
    counts as an empty text.  A null text is empty and has one token, its end.  Every row
    is scored, repeated ones alike; in training they count as often as they occur.  Extra
    columns are ignored and an empty table gives no rows.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.crc32(name.cast("binary")) % 7 == HELD_OUT).alias("held_out")
    )
    counts = kept(corpus_counts(docs))
    by_word = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    totals = by_word.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = docs.where("not held_out").count()
    # The end of a text is a token too.
    n_train, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    top = by_word.orderBy(F.desc("n"), "key").limit(FREQUENT_WORDS).toArrow()
    order = np.argsort(top["key"].to_numpy())
    frequent = spark.sparkContext.broadcast((top["key"].to_numpy()[order], top["n"].to_numpy()[order]))

    scores = kept(gram_scores(counts))
    n_scores = scores.count()
    small = n_scores <= BROADCAST_GRAMS
    if small:
        got = scores.toArrow()
        order = np.argsort(got["key"].to_numpy())
        table = (got["key"].to_numpy()[order], got["log10"].to_numpy()[order])
    else:
        table = (np.zeros(0, np.int64), np.zeros(0))
    table = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, n), (known_grams, log10) = frequent.value, table.value
        task, number = TaskContext.get().partitionId(), 0
        slices = (p for batch in batches for p in cut(batch))
        for part in (p.slice(at, 1 << ROW_BITS) for p in slices for at in range(0, p.num_rows, 1 << ROW_BITS)):
            rows = part.num_rows
            w = words(part.column("text"), lower=True)
            hashes = signed(word_hashes(w))
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            value = np.where(hit, np.log10(n[at] + 1.0) if len(keys) else 0.0, 0.0)
            rare, row = hashes[~hit], w.rows[~hit]
            gram, first = grams(w)
            row_of = np.repeat(np.arange(rows), np.diff(first))
            score = np.zeros(rows)
            own = [np.zeros(0, np.int64)] * 2
            upto = np.zeros(rows + 1, np.int64)
            if small:
                # One sort of gram and row together: equal grams are looked up once.
                both = np.sort(gram << ROW_BITS | row_of)
                gram, row_of = both >> ROW_BITS, both & ((1 << ROW_BITS) - 1)
                distinct, times = np.unique(gram, return_counts=True)
                each = log10[np.searchsorted(known_grams, distinct)]
                score = np.bincount(row_of, weights=np.repeat(each, times), minlength=rows)
            else:
                pair, times = np.unique(row_of << GRAM_BITS | gram, return_counts=True)
                own = [pair & ((1 << GRAM_BITS) - 1), times]
                upto = np.searchsorted(pair >> GRAM_BITS, np.arange(rows + 1))
            out = {
                "rid": np.int64(task) << 33 | np.arange(number, number + rows),
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                "n_tokens": w.counts + 1, "n_bytes": np.diff(first),
                "known": np.bincount(w.rows[hit], minlength=rows),
                "base": np.bincount(w.rows, weights=value, minlength=rows),
                "ctw": score,
            }
            out = {k: pa.array(v) for k, v in out.items()}
            out["rare"] = lists(pa.array(rare), np.searchsorted(row, np.arange(rows + 1)))
            out["grams"] = lists(pa.array(own[0], pa.int64()), upto)
            out["times"] = lists(pa.array(own[1], pa.int64()), upto)
            number += rows
            yield pa.RecordBatch.from_pydict(out)

    schema = (
        "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, ctw double, "
        "rare array<bigint>, grams array<bigint>, times array<bigint>"
    )
    rows = kept(docs.mapInArrow(run, schema))
    rare = rows.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("times"))
    found = rare.join(by_word, "key").groupBy("rid").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base")
    )
    rows = rows.join(found, "rid", "left")
    ctw = F.col("ctw")
    if not small:
        listed = rows.select("rid", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("rid", "g.*")
        summed = listed.join(scores.withColumnRenamed("key", "grams"), "grams").groupBy("rid")
        rows = rows.join(summed.agg(F.sum(F.col("times") * F.col("log10")).alias("joined")), "rid", "left")
        ctw = F.col("joined")
    null0 = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + null0("rare_base") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n_train + distinct + 1))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + null0("rare_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ctw.alias("score"),
        (-ctw / F.col("n_bytes") / float(np.log10(2))).alias("bits_per_byte"),
    )
