"""Spelling variants against brute force on random words, and on awkward rows."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa

from gleanframe.llm import spelling
from gleanframe.llm.tables import kept, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = brute_counts(rows)
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame).collect()}


def test_random_words_against_brute_force(spark):
    """Few letters, so that words have runs of equal letters and many neighbours; chains of forms."""
    rng = np.random.default_rng(5)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    words = {make("ab", int(rng.integers(7, 11))) for _ in range(150)} | {make("abcÀÿ×", 9) for _ in range(100)}
    words |= {make("abcdefghijklmnop", 20) for _ in range(20)}
    for w in list(words)[:150]:
        i = int(rng.integers(len(w)))
        words |= {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]}
    words = sorted(words)
    rows = []
    for i in range(60):
        picked = rng.choice(len(words), 300)
        rows.append((i, " ".join(words[k].capitalize() if k % 7 == 0 else words[k] for k in picked)))
    rows.append((99, " ".join(["variant"] * 400 + ["varriant"] * 30 + ["varriaant"] * 3 + ["Varriaants"] * 2)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    expected = brute(rows)
    assert got == expected and any(v[1] != v[0] is not None for v in expected.values())


def test_awkward_rows(spark):
    long = "a" * 30_000 + "b"
    rows = [
        (1, "colours COLOURS colors7colors"), (1, "colours COLOURS colors7colors"), (2, None), (3, ""),
        (None, "nullidword nullidword"), (4, " \n"), (5, f"{long} {long}c {long}"), (6, f"{long} {long}c {long}"),
        (7, "tenfold " * 30 + "tenfolds tenfolds tenfald tenfald"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    expected = brute(rows)
    assert found(docs.repartition(3)) == expected and len(expected) > 5
    assert found(docs.limit(0)) == {}


def test_rows_written_are_few(spark, monkeypatch):
    """States that can't take an edge after their edit are never written, and edges not apart from the paths."""
    written = []

    def counted(frame, *options):
        out = kept(frame, *options)
        written.append(out.count())
        return out

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words = kept(spelling.word_counts(docs))
    monkeypatch.setattr(spelling, "kept", counted)
    pairs = spelling.near_pairs(words).count()
    assert pairs and sum(written) < 15 * words.count()


def test_starts_over_many_batches():
    """Words of one start that come in many batches make the same rows as all in one."""
    words = sorted(set(map("".join, itertools.product("abc", "ab", "ab", "ab", "xy", "word", "yz"))))
    rows = [(w, backward, w[:3]) for backward in (False, True) for w in sorted(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "backward", "start"])

    def trie(step, size):
        made = spelling._by_start(iter([batch.slice(i, step) for i in range(0, len(rows), step)]), size)
        return [pa.Table.from_batches([b]).drop_columns(["edge"]).to_pylist() for b in made]

    whole, small = trie(len(rows), 1 << 30), trie(7, 1)
    assert len(whole) == 1 and len(small) > 10
    assert [r for part in small for r in part] == whole[0]
