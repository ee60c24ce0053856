"""State queries on skewed logs against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import pending as P
from gleanframe.operators import reports as R
from gleanframe.plans.sample import SPEC

SCHEMA = "id long, file string, chunknumber int, at int, success boolean, run_tag string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hot = [("hot", 0)] * 1500
    keys = hot + [(f"f{rng.randint(0, 60)}", rng.randint(0, 2)) for _ in range(3000)]
    return [
        (i, file, n, rng.randint(0, 1000), rng.random() < 0.3, rng.choice("ab"))
        for i, (file, n) in enumerate(keys)
    ]


@pytest.fixture(scope="module")
def log(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("timestamp", F.timestamp_seconds("at"))


def moment(at):
    return F.timestamp_seconds(F.lit(at))


def test_consecutive_failures(log, rows):
    last = defaultdict(lambda: -1)
    for _, file, n, at, ok, _ in rows:
        if ok:
            last[file, n] = max(last[file, n], at)
    expected = {(r[1], r[2]): 0 for r in rows}
    for _, file, n, at, ok, _ in rows:
        expected[file, n] += not ok and at > last[file, n]
    for salts in (1, 16):
        found = P.consecutive_failures(log, salts).collect()
        assert {(r.file, r.chunknumber): r.consecutive_failures for r in found} == expected


def test_latest_attempt(log, rows):
    latest = {}
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        latest[row[1], row[2]] = row
    counts = Counter((r[1], r[2]) for r in rows)
    for r in P.latest_attempt(log).collect():
        key = (r.file, r.chunknumber)
        assert (r.id, r.success, r.attempts) == (latest[key][0], latest[key][4], counts[key])


@pytest.mark.parametrize("tag", [None, "", "a"])
@pytest.mark.parametrize("limit", [1, 5])
def test_pending(log, rows, tag, limit):
    results = log.where("success and at > 950").withColumnRenamed("id", "request_id")
    done = {(r[1], r[2]) for r in rows if r[4] and r[3] > 950 and (not tag or r[5] == tag)}
    failed = Counter((r[1], r[2]) for r in rows if not r[4] and r[3] > 900)
    expected = {
        k for k in {(r[1], r[2]) for r in rows} if k not in done and failed[k] < limit
    }
    chunks = log.select("file", "chunknumber").distinct()
    found = P.pending_chunks(chunks, results, log, limit, moment(900), tag).collect()
    assert {(r.file, r.chunknumber) for r in found} == expected


def test_window_ends(log, rows):
    """The summary includes both ends, the failure budget excludes its start."""
    inside = [r for r in rows if 100 <= r[3] <= 600]
    assert P.in_window(log, moment(100), moment(600)).count() == len(inside)
    failed = Counter((r[1], r[2]) for r in rows if not r[4] and r[3] > 100)
    found = P.failures_since(log, moment(100)).collect()
    assert {(r.file, r.chunknumber): r.failures for r in found} == failed


def test_run_summary(log, rows):
    results = log.where("success").withColumnRenamed("id", "request_id")
    row = P.run_summary(log, results, moment(100), moment(600), 2).first()
    inside = [r for r in rows if 100 <= r[3] <= 600]
    failed = Counter((r[1], r[2]) for r in inside if not r[4])
    assert row.llm_calls == len(inside)
    assert row.successes == sum(r[4] for r in inside)
    assert row.skipped == sum(c >= 2 for c in failed.values())
    assert row.duration_us == 500 * 1_000_000


def test_typed_values(spark):
    rows = [("7.0", "yes"), ("7", "0"), ("seven", "maybe"), ("n/a", " TRUE "), ("", None), (None, "No")]
    results = spark.createDataFrame(
        [(n, b, "t", "q", "1") for n, b in rows], "n_words string, has_space string, title string, quote string, score string"
    )
    found = R.typed_results(results, SPEC).collect()
    assert [r.n_words for r in found] == [7.0, 7.0, None, None, None, None]
    assert [r.has_space for r in found] == [True, False, None, True, None, False]
    assert found[0].score == 1.0


def test_run_compare_counts_one_sided_chunks(spark):
    schema = "file string, chunknumber int, x string"
    left = spark.createDataFrame([("a", 0, "1"), ("a", 1, None), ("b", 0, "2")], schema)
    right = spark.createDataFrame([("a", 0, "1"), ("a", 1, None), ("c", 0, "2"), ("d", 0, "2")], schema)
    row = R.run_compare(left, right, ["x"]).first()
    assert tuple(row) == ("x", 2, 2, 0, 1, 2)
