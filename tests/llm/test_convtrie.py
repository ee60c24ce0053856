"""The conversation trie against brute force over many shards, and on awkward rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest

from gleanframe.llm import convtrie

COLUMNS = ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    members, said = collections.defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        said[c] = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(said[c]) + 1):
            members[said[c][:d]].append(c)
    out = {}
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        parents = {k[:-1] for k in members if k}
        ends = ",".join(str(c) for c in convs if said[c] == key)
        out[convs[0], len(key)] = (
            members[key[:-1]][0] if key else None, len(convs), sum(len(k) == len(key) + 1 for k in below),
            sum(k not in parents for k in below), sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(frame, **options):
    rows = convtrie.conversation_trie(frame, **options).collect()
    got = {(r.conv_id, r.depth): tuple(r[c] for c in COLUMNS[1:]) for r in rows}
    assert len(got) == len(rows)
    return got


def conversations(n=260, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        kind = rng.integers(4)
        for t in range(int(rng.integers(1, 9))):
            text = f"turn {t}" if kind else f"turn {rng.integers(3)} of {rng.integers(4)}"
            rows.append((c, t, "user" if t % 2 else "assistant", text * int(1 + t % 3)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", (1, 4, convtrie.SHARD_BITS))
def test_against_brute_force(spark, monkeypatch, bits):
    """Trees that go through many shards have the totals of one that is in a single shard."""
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(convtrie, "PIECE_BITS", 3)
    assert found(frame, shard_bits=bits) == brute(rows)


def test_awkward_rows(spark):
    long = "x" * 100_000
    rows = [
        (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (5, 0, "user", long), (105, 0, "a", "b"),
        (None, 0, "user", "nobody"), (-7, 3, "user", "below zero"), (-107, 2, "user", "below zero"), (0, 0, "user", "é"),
        (0, 0, "user", "é"), (0, 2, None, "x"), (3, None, "user", None), (2**62, 0, "user", "far"),
    ]
    rows += [(7, t % 40, "user", str(t % 3)) for t in range(500)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, part long").repartition(3)
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == {}


def test_queue_spills_in_order():
    queue, rng = convtrie.SpillingQueue(5, limit=50), np.random.default_rng(2)
    waiting, taken = [], []
    for i, message in enumerate(itertools.islice(iter(lambda: tuple(rng.integers(-99, 99, 5).tolist()), None), 3000)):
        queue.push(message)
        waiting.append(message)
        if i % 3 == 0:
            assert queue.first() == min(waiting)
            taken.append(queue.pop())
            waiting.remove(taken[-1])
    assert len(queue.runs) > 3
    while queue.first():
        taken.append(queue.pop())
    assert taken[-len(waiting) :] == sorted(waiting)
