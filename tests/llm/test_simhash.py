"""SimHash classes against brute force, and on awkward rows."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from gleanframe.llm import simhash
from gleanframe.llm.queries import QUERIES
from gleanframe.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=4):
    """Least reachable id of each (id, fingerprint)."""
    near = lambda a, b: (a ^ b).bit_count() <= radius
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, v in prints.items():
        least[find(v)] = min(i, least.get(find(v), i))
    return {i: least[find(v)] for i, v in prints.items()}


def test_documents_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    classes = brute_classes(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_simhash"](spark, sf_dir).collect()}
    assert found == {i: (f"{prints[i]:016x}", classes[i]) for i in texts}


def random_prints(seed=0, n=1200):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    out = []
    for _ in range(n):
        x = int(centres[rng.integers(60)])
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("limit", (simhash.VARIANTS, 3000))
def test_links_of_one_route(monkeypatch, limit):
    """Whatever fits into a block, links have the components of all pairs within four bits."""
    monkeypatch.setattr(simhash, "VARIANTS", limit)
    prints = np.unique(np.array(random_prints(n=300), np.uint64))
    a, b = simhash.meet(prints, np.full(len(prints), 2), list(range(64)), 2)
    root = simhash._forest(np.searchsorted(prints, a), np.searchsorted(prints, b), len(prints))
    assert {i: int(r) for i, r in enumerate(root)} == brute_classes({i: int(f) for i, f in enumerate(prints)})


@pytest.mark.parametrize("max_route", (simhash.MAX_ROUTE, 20_000))
def test_routes_and_their_splits(spark, monkeypatch, max_route):
    """A large group of near copies is split by further bits without losing a link."""
    prints = dict(enumerate(random_prints(3)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    rounds = simhash.routes(frame.select("fp").distinct(), 2, max_route)
    assert (len(rounds) > 1) == (max_route < simhash.MAX_ROUTE)
    found = {r.doc_id: r.component_id for r in simhash.simhash_classes(frame, max_route=max_route).collect()}
    assert found == brute_classes(prints)


def test_awkward_rows(spark):
    long = " ".join(f"Word{i % 701} and{i % 13}" for i in range(40_000))
    rows = [(1, "a B c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y"), (4, " \n\t "), (5, long), (6, "Ünïcode 日本 語")]
    schema = "doc_id long, text string, fp long, route long, component_id long, first long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).repartition(3)
    found = simhash.simhash_classes(docs).collect()
    expected = sorted((str(i), f"{brute_print(t):016x}") for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == expected
    by = {r.doc_id: r.component_id for r in found}
    assert by[2] == by[3] == by[4] == 2 and by[1] == 1 and by[5] == 5 and by[None] is None
    assert simhash.simhash_classes(docs.limit(0)).collect() == []
