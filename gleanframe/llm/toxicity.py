"""Toxicity as an ordered grade: cumulative-link regression on sparse text features.

``P(grade <= k) = sigmoid(threshold_k - w.x)``: one weight vector shared by all ordered
thresholds.  The features are words and the beginnings of words, hashed into a fixed
number of slots, so weights have a fixed size and scoring is map-only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept, map_batches
from gleanframe.llm.words import Words, lists, mix, word_hashes, words

SLOTS = 1 << 18
# Bytes of a word that stand for its stem.
STEMS = (4, 5, 6)
# Labelled rows the fit uses at most, clean and toxic; they are taken in hash order.
SAMPLE = (8000, 2000)
# A feature counts only if so many labelled rows hold it.
MIN_ROWS = 8
# Numbers of features that are tried; the labels' folds choose one.
SIZES = (100, 200, 500, 1000)
FOLDS = 5
# Probability from which a document is toxic where labels are too few for folds.
TOXIC_FROM = 0.5
# Punctuation cut off the ends of words.
_TRIM = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}*$%&#|<>-_"))


def _trimmed(w: Words) -> Words:
    """Words without punctuation at their ends; a word of punctuation alone stays whole."""
    inner = np.flatnonzero(~_TRIM[w.data])
    if not len(inner):
        return w
    first = inner[np.minimum(np.searchsorted(inner, w.starts), len(inner) - 1)]
    last = inner[np.maximum(np.searchsorted(inner, w.ends) - 1, 0)]
    some = (first >= w.starts) & (first < w.ends)
    return w._replace(starts=np.where(some, first, w.starts), ends=np.where(some, last + 1, w.ends))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature slots of each row and where each row begins.

    Presence counts, not frequency, so a long text isn't diluted.
    """
    w = words(pc.utf8_lower(texts))
    rows = len(w.first) - 1
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    cut = _trimmed(w)
    keys = [word_hashes(cut)]
    for size in STEMS:
        stem = cut._replace(ends=np.minimum(cut.ends, cut.starts + size))
        keys.append(mix(word_hashes(stem) + np.uint64(size)))
    slots = np.stack(keys) & np.uint64(SLOTS - 1)
    pairs = np.unique((np.tile(w.rows, len(keys)) * SLOTS) + slots.ravel().astype(np.int64))
    return pairs % SLOTS, np.searchsorted(pairs // SLOTS, np.arange(rows + 1))


@dataclass(frozen=True)
class Ordinal:
    """Weights of a fixed size, the ordered thresholds, and the probability from which a text is toxic."""

    weights: np.ndarray
    thresholds: np.ndarray
    limit: float = TOXIC_FROM


def _sums(weights: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def fit(
    slots: np.ndarray,
    first: np.ndarray,
    grades: np.ndarray,
    n_grades: int,
    rounds: int = 150,
    rate: float = 0.03,
    sparsity: float = 0.002,
) -> Ordinal:
    """Full-batch Adam on the likelihood; soft thresholding keeps only telling features.

    Grades weigh alike however often they occur, so the rate of toxic labels in the sample
    doesn't move the thresholds.
    """
    used, at = np.unique(slots, return_inverse=True)
    n, row = len(grades), np.repeat(np.arange(len(grades)), np.diff(first))
    counts = np.bincount(grades, minlength=n_grades)
    share = 1 / np.maximum(counts, 1)[grades] / max(1, (counts > 0).sum())
    # Values: weights, then the first threshold, then the logarithms of the gaps after it.
    values = np.zeros(len(used) + n_grades - 1)
    values[len(used)] = 1.0
    mean, square = np.zeros_like(values), np.zeros_like(values)
    every = np.arange(n)
    for step in range(1, rounds + 1):
        weights, start, gaps = values[: len(used)], values[len(used)], values[len(used) + 1 :]
        thresholds = start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = _sums(weights, at, first)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None, :], -50, 50)))
        bounds = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = bounds * (1 - bounds)
        upper, lower = slope[every, grades + 1], slope[every, grades]
        weight = share / np.maximum(bounds[every, grades + 1] - bounds[every, grades], 1e-12)
        d_weights = np.bincount(at, weights=(weight * (upper - lower))[row], minlength=len(used))
        d_threshold = np.bincount(grades, weights=weight * lower, minlength=n_grades)[1:]
        d_threshold -= np.bincount(grades, weights=weight * upper, minlength=n_grades)[:-1]
        after = np.cumsum(d_threshold[::-1])[::-1]
        slope_ = np.concatenate([d_weights, after[:1], after[1:] * np.exp(gaps)])
        mean = 0.9 * mean + 0.1 * slope_
        square = 0.999 * square + 0.001 * slope_**2
        moves = rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        values = values - moves
        head = values[: len(used)]
        head[:] = np.sign(head) * np.maximum(np.abs(head) - rate * sparsity * step**0.5, 0)
    weights = np.zeros(SLOTS, dtype=np.float32)
    weights[used] = values[: len(used)]
    gaps = np.exp(values[len(used) + 1 :])
    return Ordinal(weights, values[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def _feature_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Slots, a name that equal rows share, and the fold that follows from it."""
    slots, first = features(batch.column("text"))
    slots = slots.astype(np.int32)
    names = [hashlib.md5(slots[first[r] : first[r + 1]].tobytes()) for r in range(batch.num_rows)]
    return pa.RecordBatch.from_pydict({
        "grade": batch.column("grade"), "fold": pa.array([n.digest()[0] % FOLDS for n in names], pa.int32()),
        "name": pa.array([n.hexdigest() for n in names]), "slots": lists(pa.array(slots), first),
    })


def labelled_sample(labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``(doc_id, grade)``: up to ``sample[g]`` labelled documents of each toxic label ``g``.

    A document labelled more than once has its highest label; null labels are left out.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("grade")
    )
    order = F.xxhash64("doc_id")
    parts = [one.where(F.col("grade") == g).orderBy(order, "doc_id").limit(sample[g]) for g in (0, 1)]
    return parts[0].unionByName(parts[1])


class Counts(NamedTuple):
    """Rows that hold each of ``slots`` and rows at all, by label and fold."""

    slots: np.ndarray
    holding: np.ndarray
    rows: np.ndarray

    def ranked(self, without: int | None = None, min_rows: int = MIN_ROWS) -> np.ndarray:
        """Features that enough rows outside of a fold hold, the most telling first.

        The order is by the log odds between toxic and clean rows times the logarithm of the
        toxic rows with the feature, so one that a few rows share by chance comes late.
        """
        used = [k for k in range(FOLDS) if k != without]
        clean, toxic = self.holding[:, used].sum(axis=1)
        n_clean, n_toxic = self.rows[:, used].sum(axis=1)
        odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
        worth = np.where(clean + toxic >= min_rows, np.abs(odds) * np.log1p(toxic), -1)
        order = np.lexsort((self.slots, -worth))
        return self.slots[order[: int((worth >= 0).sum())]]


def _count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Features of a batch with their rows of each label and fold (``cell``)."""
    column = batch.column("slots")
    cell = batch.column("grade").to_numpy().astype(np.int64) * FOLDS + batch.column("fold").to_numpy()
    pairs = np.repeat(cell, np.diff(column.offsets.to_numpy())) * SLOTS + column.flatten().to_numpy()
    pairs, times = np.unique(pairs, return_counts=True)
    return pa.RecordBatch.from_pydict({
        "cell": pa.array((pairs // SLOTS).astype(np.int32)), "slot": pa.array((pairs % SLOTS).astype(np.int32)),
        "n": pa.array(times.astype(np.int64)),
    })


def _counted(rows: DataFrame, min_rows: int) -> Counts:
    """Counts over the labelled rows; the driver gets a row per feature of ``min_rows`` rows, ``SLOTS`` at most."""
    cells = range(2 * FOLDS)
    sizes = rows.agg(*[F.count_if(F.col("grade") * FOLDS + F.col("fold") == c).alias(f"c{c}") for c in cells]).first()
    counted = map_batches(rows.select("grade", "fold", "slots"), _count_batch, "cell int, slot int, n long")
    inside = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in cells]
    got = counted.groupBy("slot").agg(F.sum("n").alias("n"), *inside).where(F.col("n") >= min_rows).drop("n").toArrow()
    shape = lambda values: np.array(values).reshape(2, FOLDS, -1)
    holding = shape([got[f"c{c}"].to_numpy() for c in cells])
    return Counts(got["slot"].to_numpy(), holding, shape([sizes[f"c{c}"] for c in cells])[:, :, 0])


def _only(slots: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen features of each row."""
    stay = np.zeros(SLOTS, bool)
    stay[chosen] = True
    hit = stay[slots]
    return slots[hit], np.concatenate([[0], np.cumsum(hit)])[first]


def _rows(slots: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)[which]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes) + np.repeat(first[:-1][which], sizes)
    return slots[at], begin


def _held_out(slots, first, toxic, folds, chosen: np.ndarray, fold: int) -> np.ndarray:
    """Probabilities of a fold's rows by a fit that saw none of them."""
    s, f = _rows(slots, first, np.flatnonzero(folds != fold))
    model = fit(*_only(s, f, chosen), toxic[folds != fold], 2)
    score = _sums(model.weights, *_rows(slots, first, np.flatnonzero(folds == fold)))
    return 1 / (1 + np.exp(np.clip(model.thresholds[0] - score, -50, 50)))


def _cut(p: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The limit with the best mean of toxic rows caught and clean rows left alone, and that mean.

    The middle of all best limits is taken.
    """
    tried = np.linspace(0.05, 0.95, 91)
    caught = (p[toxic > 0][:, None] >= tried).mean(axis=0)
    alone = (p[toxic == 0][:, None] < tried).mean(axis=0)
    both = (caught + alone) / 2
    best = np.flatnonzero(both >= both.max() - 1e-12)
    return float(tried[best[len(best) // 2]]), float(both.max())


def learn(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray, folds: np.ndarray, order: list[np.ndarray]) -> Ordinal:
    """Number of features, severe grade and limit by folds of the labelled rows, then one fit on all of them.

    ``order`` has the features ranked without each fold, and without none at its end.  The
    number of features is the one that tells held-out rows apart best.  The labels tell
    toxic from clean only; toxic rows above the median of their held-out probabilities are
    the severe grade, so it isn't read off scores that the fit has memorised.
    """
    worth = {}
    for size in SIZES:
        p = np.concatenate([_held_out(slots, first, toxic, folds, order[k][:size], k) for k in (0, 1)])
        worth[size] = _cut(p, np.concatenate([toxic[folds == k] for k in (0, 1)]))[1]
    size = max(SIZES, key=lambda n: worth[n])
    p = np.zeros(len(toxic))
    for k in range(FOLDS):
        p[folds == k] = _held_out(slots, first, toxic, folds, order[k][:size], k)
    limit, _ = _cut(p, toxic)
    severe = (toxic > 0) & (p > np.median(p[toxic > 0]))
    final = fit(*_only(slots, first, order[-1][:size]), toxic + severe, 3 if severe.any() else 2)
    return Ordinal(final.weights, final.thresholds, limit)


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Ordinal:
    """Fit grades 0 (clean), 1 (toxic) and 2 (severe) on a bounded sample of labelled rows.

    ``sample`` bounds the rows of each label; everything that is fitted comes from them.  Features
    are counted where the rows are; the driver gets the counts and then of each row only the
    features that some fold may choose.  Where a fold has no toxic or no clean row there are
    no folds, and one grade of toxic rows.  Without documents of both labels nothing is toxic.
    """
    picked = F.broadcast(labelled_sample(labels, sample))
    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(picked, "doc_id")
    schema = "grade int, fold int, name string, slots array<int>"
    rows = kept(map_batches(pairs.select("grade", "text"), _feature_batch, schema))
    counts = _counted(rows, MIN_ROWS)
    if not counts.rows.sum(axis=1).all():
        return Ordinal(np.zeros(SLOTS, np.float32), np.array([50.0, 60.0]))
    folded = bool(counts.rows.all())
    if folded:
        order = [counts.ranked(k)[: SIZES[-1]] for k in (*range(FOLDS), None)]
    else:
        order = [_counted(rows, 1).ranked(min_rows=1)[: SIZES[-1]]]
    wanted = np.zeros(SLOTS, bool)
    wanted[np.concatenate(order)] = True
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)  # SLOTS bytes

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists_ = batch.column("slots")
        flat, offsets = lists_.flatten().to_numpy(), lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
        hit = wanted.value[flat]
        upto = np.concatenate([[0], np.cumsum(hit)])[offsets]
        columns = {c: batch.column(c) for c in ("grade", "fold", "name")}
        return pa.RecordBatch.from_pydict(columns | {"slots": lists(pa.array(flat[hit]), upto)})

    # Sorted, so that the fit doesn't depend on the order in which rows arrive.
    got = map_batches(rows, narrow, schema).toArrow().sort_by([("grade", "ascending"), ("name", "ascending")])
    wanted.unpersist()
    slots = got["slots"].combine_chunks().flatten().to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in got["slots"]])])
    toxic = got["grade"].to_numpy().astype(np.int64)
    if not folded:
        return fit(*_only(slots, first, order[0]), toxic, 2)
    return learn(slots, first, toxic, got["fold"].to_numpy(), order)


def severity(docs: DataFrame, model: Ordinal, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns with ``severity`` (expected grade), ``p_toxic`` and ``toxic``.

    Whole texts; a null or empty text scores 0 before the thresholds.  Rows are judged one
    by one: repeated rows alike, null ids like any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, fixed

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, first = features(batch.column("_text"))
        score = _sums(model.value.weights, slots, first)
        above = 1 / (1 + np.exp(np.clip(model.value.thresholds[None, :] - score[:, None], -50, 50)))
        out = {c: batch.column(c) for c in columns}
        out["severity"] = pa.array(above.sum(axis=1))
        out["p_toxic"] = pa.array(above[:, 0])
        out["toxic"] = pa.array(above[:, 0] >= model.value.limit)
        return pa.RecordBatch.from_pydict(out)

    picked = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    schema = ", ".join([*kinds, "severity double, p_toxic double, toxic boolean"])
    return map_batches(picked, run, schema)
