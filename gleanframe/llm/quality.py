"""Quality rules as weak supervision.

Every rule votes keep (1) or drop (0) or abstains (-1).  Expectation-maximisation over the
vote patterns of all documents estimates how often each rule is right, without labels, and
each pattern's posterior probability of good quality replaces an all-must-pass filter.

A pattern is one of 3 ** len(RULES) at most, so what reaches the driver is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept, map_batches
from gleanframe.llm.words import Words, utf8, word_hashes, words

# The base rules of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PCT = 20, 8, 30
# Distinct words are counted in windows of so many words; a shorter text is one window.
VARIETY_WINDOW = 2000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_upper long, n_letters long, n_digits long, n_types long, n_type_words long"

_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
# Letters: ASCII letters and every character beyond ASCII.
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1)) | (np.arange(256) >= 0xC0)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by a window of words that occurs twice or more, its first time included.

    Windows are compared exactly: ids of 2, 4, 8 words come from pairs of shorter ids.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    width = 1
    while width < window:
        pair = ids[: len(ids) - width].astype(np.int64) * len(ids) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    counts = np.bincount(ids[:n])
    again = counts[ids[:n]] > 1
    edges = np.zeros(n + window, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def distinct_words(ids: np.ndarray, window: int = VARIETY_WINDOW) -> tuple[int, int]:
    """Distinct words summed over consecutive windows, and the words of these windows.

    All windows have one size: the last one ends with the text and may overlap another.
    """
    n = len(ids)
    starts = [*range(0, n - window, window), n - window] if n > window else [0]
    return sum(len(np.unique(ids[a : a + window])) for a in starts), len(starts) * min(n, window)


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines), len(lines) - len(set(lines))


def _stats(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text")
    w: Words = words(texts)
    data, offsets = utf8(texts)
    rows = len(offsets) - 1
    in_word = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(in_word, w.starts, 1)
    np.add.at(in_word, w.ends, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    hashes = word_hashes(w)
    repeats, types, type_words = (np.zeros(rows, np.int64) for _ in range(3))
    lines, same = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for r in range(rows):
        ids = np.unique(hashes[w.first[r] : w.first[r + 1]], return_inverse=True)[1]
        (types[r], type_words[r]), repeats[r] = distinct_words(ids), repeated_words(ids)
        lines[r], same[r] = _duplicate_lines(data[offsets[r] : offsets[r + 1]].tobytes())
    columns = {
        "doc_id": batch.column("doc_id"),
        "n_words": w.counts,
        "word_chars": _per_row(in_word & ~_CONTINUATION[data], offsets),
        "n_symbols": _per_row(_IS_SYMBOL[data], offsets),
        "n_dup_lines": same,
        "n_repeat_words": repeats,
        "n_lines": lines,
        "n_upper": _per_row(_UPPER[data], offsets),
        "n_letters": _per_row(_LETTER[data], offsets),
        "n_digits": _per_row(_DIGIT[data], offsets),
        "n_types": types,
        "n_type_words": type_words,
    }
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def document_stats(docs: DataFrame) -> DataFrame:
    """Counts per document, over its whole text; one pass, no shuffle."""
    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(pairs, _stats, f"doc_id long, {STATS}, {MORE}")


def rules() -> dict[str, Column]:
    """Votes by name; each uses shares of the text, so it means the same at any length.

    Most rules see one kind of damage and abstain without it: lacking one defect is no
    proof of quality.  Two rules know what good text looks like and can vote keep.
    """
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    drop = lambda when: F.when(when, 0).otherwise(-1)
    mean, words_ = share("word_chars", "n_words"), F.col("n_words")
    letters, capitals = share("n_letters", "word_chars"), share("n_upper", "n_letters")
    symbols, repeats = share("n_symbols", "word_chars"), share("n_repeat_words", "n_words")
    prose = (letters > 0.85) & (capitals < 0.15) & (symbols < 0.01)
    return {
        "length": F.when(words_ < MIN_WORDS, 0).when(words_ >= 2 * MIN_WORDS, 1).otherwise(-1),
        "prose": F.when(prose & (mean >= 3) & (mean <= 10), 1).when(~prose & (letters < 0.7), 0).otherwise(-1),
        "repeats": drop(repeats > MAX_REPEATED_PCT / 100),
        "symbols": drop(symbols > 0.08),
        "lines": drop(share("n_dup_lines", "n_lines") > 0.3),
        "word_length": drop((mean < 2.5) | (mean > 12)),
        "capitals": drop(capitals > 0.4),
        "variety": drop(share("n_types", "n_type_words") < 0.15),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good quality per vote pattern (rows of -1, 0, 1).

    Rules are independent given the class.  ``table[y, rule, vote + 1]``, how often a rule
    abstains, drops or keeps in class ``y``, starts with rules that rarely drop good text
    and is smoothed by one document, so a rule that never votes stays harmless.
    """
    n_rules = patterns.shape[1]
    table = np.empty((2, n_rules, 3))
    table[0], table[1] = [0.5, 0.3, 0.2], [0.5, 0.02, 0.48]
    prior, index = 0.85, patterns + 1
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        log = [np.log(table[y, np.arange(n_rules), index]).sum(axis=1) for y in (0, 1)]
        odds = np.log(prior / (1 - prior)) + log[1] - log[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - posterior).max() < 1e-12
        posterior = new
        if done:
            break
        for y, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for v in (0, 1, 2):
                table[y, :, v] = (weight[:, None] * (index == v)).sum(axis=0) + 1 / 3
            table[y] /= table[y].sum(axis=1, keepdims=True)
        # One document of each class besides the counted ones keeps the prior inside (0, 1).
        prior = ((counts * posterior).sum() + 1) / (counts.sum() + 2)
    return posterior


def quality(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict per document.

    A null or empty text has no words and fails the base rules.  Repeated rows are judged
    one by one and alike, a null doc_id like any other; other columns are ignored.  An empty
    table gives no rows.
    """
    names = list(rules())
    stats = document_stats(docs).withColumns(rules())
    stats = kept(stats.withColumn("votes", F.concat_ws(",", *[F.col(n).cast("string") for n in names])))
    spark = docs.sparkSession
    seen = stats.groupBy("votes").count().orderBy("votes").collect()
    rows = []
    if seen:
        patterns = np.array([[int(x) for x in row.votes.split(",")] for row in seen])
        posterior = fit(patterns, np.array([row["count"] for row in seen], dtype=float))
        rows = [(row.votes, float(p)) for row, p in zip(seen, posterior)]
    # At most 3 ** 8 patterns, so this side is small whatever the corpus holds.
    scores = F.broadcast(spark.createDataFrame(rows, "votes string, posterior double"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PCT
    )
    base = [field.split()[0] for field in STATS.split(", ")]
    return stats.join(scores, "votes").select(
        "doc_id",
        *base,
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= 0.5)).alias("kept"),
        "posterior",
        "votes",
    )
