"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie has a row per edge, ``(node, first, label, child, child_ends)``; a node is the hash
of a beginning of words, and beginnings that neither end a word nor branch are left out, so
a very long word has few edges.  States ``(word, other, pos, node)`` say that ``other``, the
word after its one edit, has been followed up to ``pos``.  Every round joins all states with
the edge table on node and next character; states that reach the end of a word are
neighbours, the others go on until none is left.

Edits are made in the second half of a word only, where nodes have few children.  Those in
the first half are found in the trie of the reversed words, which is part of the same table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import cut, kept
from gleanframe.llm.words import mix

# What a word is, how often a run loses a character, and when a form is one.
RUN = r"([A-Za-zÀ-ÿ]+)"
LOSE_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
# Words are worked on in tables of about so many bytes.
TABLE_BYTES = 1 << 20
PATH_SCHEMA = (
    "word string, backward boolean, pos int, node long, ends boolean, "
    "upto int, child long, child_ends boolean, edge boolean"
)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words of all whole texts."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1))).alias("raw"))
    # Most runs are in lower case already.
    plain = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", upper, lower))
    made = runs.where(F.length("raw") >= min_length).select("doc_id", plain.alias("run"))
    made = made.withColumn("h", F.expr("crc32(concat(coalesce(cast(doc_id as string), ''), ':', run))"))
    made = made.withColumn("at", F.expr("cast(h % length(run) as int)"))
    shorter = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    word = F.when(F.col("h") % LOSE_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = made.select(word.alias("word")).where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _nodes(table: pa.Table) -> pa.RecordBatch:
    """The rows of :func:`_paths` for words that share no node with words of other tables.

    A beginning's hash is a sum over its characters and their places, so all of a table
    come from one running sum.
    """
    texts, backward = table["word"].to_pylist(), table["backward"].to_numpy()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - first[owner]
    salt = (2 * backward.astype(np.uint64) + np.uint64(1)) << np.uint64(60)
    one = mix(codes + (place.astype(np.uint64) << np.uint64(24)) + salt[owner])
    upto = np.cumsum(one, dtype=np.uint64)
    before = upto[first] - one[first]
    # Position p stands behind p characters; the next one is at index p.
    least = (sizes + backward) // 2
    counts = sizes - least + 1
    begin = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(sizes)), counts)
    pos = np.arange(counts.sum()) - begin[row] + least[row]
    node = mix(upto[first[row] + pos - 1] - before[row])
    # A next character of zero is the end of a word.
    after = np.where(pos == sizes[row], 0, codes[np.minimum(first[row] + pos, len(codes) - 1)].astype(np.int64))
    order = np.argsort(node, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(node[order].view(np.int64)) != 0))
    lo, hi = (f.reduceat(after[order], heads) for f in (np.minimum, np.maximum))
    group = np.empty(len(node), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(node))))
    ends = (lo == 0)[group]
    at = np.flatnonzero(ends | (lo != hi)[group])
    # A word's last node is its end, which has no way on.
    last = after[at] == 0
    to = np.append(at[1:], at[-1:])
    edge = np.zeros(len(at), bool)
    edge[np.unique(np.where(last, np.uint64(0), node[to]), return_index=True)[1]] = True
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array(texts, pa.string()).take(pa.array(row[at])),
            "backward": pa.array(backward[row[at]]),
            "pos": pa.array(pos[at].astype(np.int32)),
            "node": pa.array(node[at].view(np.int64)),
            "ends": pa.array(ends[at]),
            "upto": pa.array(pos[to].astype(np.int32), mask=last),
            "child": pa.array(node[to].view(np.int64), mask=last),
            "child_ends": pa.array(ends[to], mask=last),
            "edge": pa.array(edge & ~last),
        }
    )


def _by_start(batches: Iterator[pa.RecordBatch], size: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows sorted by direction and start, worked on in tables that hold all words of a start."""
    held: list[pa.RecordBatch] = []
    for part in chain.from_iterable(cut(b) for b in batches):
        held.append(part)
        if sum(p.nbytes for p in held) < size:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        same = pc.and_(pc.equal(rows["start"], rows["start"][-1]), pc.equal(rows["backward"], rows["backward"][-1]))
        whole = rows.num_rows - pc.sum(same).as_py()
        if whole:
            yield _nodes(rows.slice(0, whole))
        held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield _nodes(pa.Table.from_batches(held))


def _paths(words: DataFrame, min_length: int) -> DataFrame:
    """The nodes on every word's way through the trie, with the next one.

    ``(word, backward, pos, node, ends, upto, child, child_ends, edge)``; a backward word is
    read from its end.  ``edge`` marks one of the rows with the same way on.  Words that
    share a node share their first ``min_length // 2`` characters, so these deal out the words.
    """
    both = words.select("word", F.lit(False).alias("backward")).unionByName(
        words.select(F.reverse("word").alias("word"), F.lit(True).alias("backward"))
    )
    started = both.withColumn("start", F.substring("word", 1, min_length // 2))
    dealt = started.repartition("backward", "start").sortWithinPartitions("backward", "start")
    return dealt.mapInArrow(_by_start, PATH_SCHEMA)


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(word, other)`` for any two words that differ by one edit, once in one direction.

    No word is shorter than ``min_length``.
    """
    paths = kept(_paths(words, min_length), "zstd")
    edges = paths.where("edge").select(
        "node", F.expr("substring(word, pos + 1, 1)").alias("first"),
        F.expr("substring(word, pos + 1, upto - pos)").alias("label"), "child", "child_ends",
    )
    own, rest = F.expr("substring(word, pos + 1, 1)"), F.expr("substring(word, pos + 2)")
    inside = paths.where("pos < length(word)").select("word", "backward", "pos", "node", "ends")
    # A word's last character is deleted.
    found = [inside.where("ends and pos = length(word) - 1").select("word", F.expr("substring(word, 1, pos)").alias("other"), "backward")]
    # Of two words of equal length the one with the lesser character is changed; the last of
    # equal characters is deleted, where the shorter word leaves the way of the longer.  Both
    # take their first edge at once.
    changed = (F.col("first") > own) & F.startswith(rest, F.expr("substring(label, 2)"))
    deleted = (F.col("first") != own) & F.startswith(rest, F.col("label"))
    met = inside.join(edges.withColumnRenamed("node", "from"), (F.col("node") == F.col("from")) & (changed | deleted))
    begin = F.expr("substring(word, 1, pos)")
    others = F.array(F.when(changed, F.concat(begin, "first", rest)), F.when(deleted, F.concat(begin, rest)))
    moved = (
        "word", "other", "backward", (F.col("pos") + F.length("label")).alias("pos"),
        F.col("child").alias("node"), F.col("child_ends").alias("ends"),
    )
    states = kept(met.withColumn("other", F.explode(F.array_compact(others))).select(*moved), "zstd")
    fits = F.expr("substring(other, pos + 1, length(label)) = label")
    while True:
        found.append(states.where("ends and pos = length(other)").select("word", "other", "backward"))
        going = states.where("pos < length(other)").withColumn("first", F.expr("substring(other, pos + 1, 1)"))
        states = kept(going.join(edges, ["node", "first"]).where(fits).select(*moved), "zstd")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    turned = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    return pairs.select(turned("word"), turned("other")).distinct()


def spelling_variants(docs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per distinct word.

    Words, their near words, forms and roots are those of the contract; ``ratio`` is how many
    times as often a form occurs.  A null text has no words; a null doc_id counts as an empty
    one in the checksum.  Repeated rows count each time.  Of near words that occur equally
    often the first in code-point order is the form.  Other columns play no part; without
    words there are no rows.
    """
    words = kept(word_counts(docs))
    one = near_pairs(words)
    both = one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other")))
    # This join also checks that the other is a word, whatever its hashes say.
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = both.join(counts, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    )
    forms = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    enough = F.col("form_n") >= ratio * F.col("n")
    forms = kept(forms.select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n"),
    ))
    # Counts grow by the ratio with every step to a form, so there are few steps.
    step = forms.where("form is not null").select("word", "form")
    roots = step.withColumnRenamed("form", "root")
    onward = step.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        further = kept(roots.join(onward, "root", "left"))
        roots = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next is not null").isEmpty():
            break
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
