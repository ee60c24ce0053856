import json
import time
from dataclasses import replace
from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from gleanframe.operators.attempts import attempt, request_id
from gleanframe.operators.chunks import chunk_texts
from gleanframe.operators.completion import FunctionCompleter, RuleCompleter
from gleanframe.operators.store import Store
from gleanframe.plans import run
from gleanframe.plans.run import Breaker, BreakerTripped
from gleanframe.plans.sample import SPEC
from gleanframe.sources.documents import with_status
from gleanframe.spec import NodeSpec
from gleanframe.plans.run import run_extraction
from gleanframe.session import spread
from gleanframe.sources.documents import corpus

# The rule completer has faults in its replies.
run_extraction = partial(run.run_extraction, breaker=None)
KEYS = ["run_id", "file", "chunknumber", "wave", "outcome", "id"]


@pytest.fixture()
def documents(spark):
    rows = [(f"s/{i}", "Some words here. And more. " * (i % 7 + 1)) for i in range(24)]
    return with_status(spark.createDataFrame(rows, "file string, content string"))


@pytest.fixture()
def spec():
    return replace(SPEC, chunk_size=40)


def content(frame, columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_stopped_run_ends_like_an_unbroken_one(spark, documents, spec, tmp_path):
    whole = Store(spark, f"{tmp_path}/whole", spec)
    summaries = run_extraction(whole, documents, RuleCompleter(), "a", "r")
    assert len(summaries) == spec.max_failures
    stopped = Store(spark, f"{tmp_path}/stopped", spec)
    run_extraction(stopped, documents, RuleCompleter(), "a", "r", max_waves=1)
    run_extraction(Store(spark, stopped.root, spec), documents, RuleCompleter(), "a", "r")
    assert content(stopped.log(), KEYS) == content(whole.log(), KEYS)
    columns = spec.result_schema.fieldNames()
    assert content(stopped.results(), columns) == content(whole.results(), columns)
    # Nothing is left for this run: the budget is used up or the chunk is done.
    assert run_extraction(stopped, documents, RuleCompleter(), "a", "r") == []
    assert content(stopped.log(), KEYS) == content(whole.log(), KEYS)


def test_results_lost_before_their_write_are_derived_on_resume(spark, documents, spec, tmp_path):
    """The log of a wave was written, its results were not: they come back, calls do not."""
    reference = Store(spark, f"{tmp_path}/reference", spec)
    run_extraction(reference, documents, RuleCompleter(), "a", "r")
    store = Store(spark, f"{tmp_path}/store", spec)
    store.register_chunks(documents)
    requests = chunk_texts(documents, spec.chunk_size).withColumn("attempt", F.lit(1))
    store._overwrite("log", attempt(requests, spec, RuleCompleter(), "a", "r", 1))
    assert store.results().count() == 0
    run_extraction(store, documents, RuleCompleter(), "a", "r")
    assert content(store.log(), KEYS) == content(reference.log(), KEYS)
    assert content(store.results(), ["request_id"]) == content(reference.results(), ["request_id"])


def test_repeating_a_wave_replaces_it(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    run_extraction(store, documents, RuleCompleter(), "a", "r")
    log, results = content(store.log(), KEYS), content(store.results(), ["request_id"])
    requests = chunk_texts(documents, spec.chunk_size).withColumn("attempt", F.lit(1))
    store.write_wave(attempt(requests, spec, RuleCompleter(), "a", "r", 1), "a", "r", 1)
    assert content(store.log(), KEYS) == log
    assert content(store.results(), ["request_id"]) == results


def test_tags_and_runs_are_separate(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    run_extraction(store, documents, RuleCompleter(), "a", "r1")
    done = store.results().count()
    run_extraction(store, documents, RuleCompleter(), "b", "r1")
    per_tag = {r.run_tag: r["count"] for r in store.results().groupBy("run_tag").count().collect()}
    assert per_tag == {"a": done, "b": done}
    ever = datetime(2020, 1, 1), datetime(2100, 1, 1)
    summary = store.summary(*ever, run_tag="a").first()
    assert summary.llm_calls == store.log().where("run_tag = 'a'").count()
    assert (summary.successes, summary.skipped) == (done, store.chunks().count() - done)
    assert store.summary(*ever).first().successes == 2 * done
    # A new run under the same tag attempts only what is left, with a fresh budget.
    again = run_extraction(store, documents, RuleCompleter(), "a", "r2")
    chunks = store.chunks().count()
    assert again[0]["attempts"] == chunks - done
    with pytest.raises(ValueError):
        run_extraction(store, documents, RuleCompleter(), "", "r3")


def test_new_documents_join_and_first_bounds_stay(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    first = documents.where("file <= 's/19'")
    run_extraction(store, first, RuleCompleter(), "a", "r1")
    bounds = content(store.chunks(), ["file", "chunknumber", "start", "end"])
    wider = Store(spark, store.root, replace(spec, chunk_size=1000))
    run_extraction(wider, documents, RuleCompleter(), "a", "r2")
    after = content(store.chunks(), ["file", "chunknumber", "start", "end"])
    assert set(bounds) < set(after)
    assert content(store.chunks().select("file").distinct(), ["file"]) == content(documents, ["file"])


def test_removed_documents_keep_their_rows(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    run_extraction(store, documents, RuleCompleter(), "a", "r1")
    rows = store.log().count()
    rest = documents.where("file = 's/8'")
    run_extraction(store, rest, RuleCompleter(), "a", "r2")
    assert content(store.log().where("run_id = 'r2'").select("file").distinct(), ["file"]) in (
        [("s/8",)],
        [],
    )
    assert store.log().where("run_id = 'r1'").count() == rows


def test_breaker_stops_before_the_next_wave(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    with pytest.raises(BreakerTripped):
        run_extraction(store, documents, RuleCompleter(), "a", "r", breaker=Breaker(0, 0))
    assert {r.wave for r in store.log().select("wave").distinct().collect()} == {1}
    assert store.results().count() > 0


def test_changed_columns_need_a_new_store(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    run_extraction(store, documents, RuleCompleter(), "a", "r")
    Store(spark, store.root, spec)
    other = replace(spec, nodes=(*spec.nodes, NodeSpec("extra", "x", db_column="extra")))
    with pytest.raises(ValueError, match="use a new store"):
        Store(spark, store.root, other)


def test_function_completer_isolates_errors_and_skips_empty_chunks(spark, spec):
    def answer(payload: str) -> str:
        text = json.loads(payload)["messages"][1]["content"]
        if text == "boom":
            raise TimeoutError("30 s")
        if not text:
            raise AssertionError("called for an empty chunk")
        value = json.dumps({"title": text, "quote": text, "has_space": True})
        return json.dumps({"choices": [{"message": {"content": value}}]})

    rows = [("s/1", i, 1, text) for i, text in enumerate(["fine", "boom", ""])]
    requests = spark.createDataFrame(rows, "file string, chunknumber int, attempt int, chunk_text string")
    for concurrency in (None, 3):
        log = attempt(requests, spec, FunctionCompleter(answer, concurrency), "a", "r", 1)
        found = {r.chunknumber: r for r in log.collect()}
        assert [found[i].outcome for i in range(3)] == ["ok", "request_failed", "empty_chunk"]
        assert found[0].extracted["has_space"] == "1"
        assert found[1].error_message.endswith("Raw details: Request error: 30 s")
        assert found[2].raw_response is None


def test_calls_are_not_shuffled_afterwards(spark, spec):
    """The plan has no exchange between the completion and the write."""
    requests = spark.createDataFrame(
        [("s/1", 0, 1, "x")], "file string, chunknumber int, attempt int, chunk_text string"
    )
    log = attempt(requests, spec, FunctionCompleter(str, 4), "a", "r", 1)
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Exchange")
    assert plan.count("Exchange") == 1


def test_documents_added_to_a_run_are_attempted_in_full(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    run_extraction(store, documents.where("file <= 's/15'"), RuleCompleter(), "a", "r", max_waves=1)
    run_extraction(store, documents, RuleCompleter(), "a", "r")
    whole = Store(spark, f"{tmp_path}/whole", spec)
    run_extraction(whole, documents, RuleCompleter(), "a", "r")
    keys = ["file", "chunknumber", "outcome", "id"]
    assert content(store.log(), keys) == content(whole.log(), keys)
    assert run_extraction(store, documents, RuleCompleter(), "a", "r") == []


def test_slices_end_like_one_and_commit_one_by_one(spark, documents, spec, tmp_path):
    whole, sliced = Store(spark, f"{tmp_path}/whole", spec), Store(spark, f"{tmp_path}/sliced", spec)
    run_extraction(whole, documents, RuleCompleter(), "a", "r")
    first = run_extraction(sliced, documents, RuleCompleter(), "a", "r", slices=4, max_waves=1)
    done = content(sliced.log(), ["id"])
    assert 0 < first[0]["attempts"] == len(done) < sliced.chunks().count()
    run_extraction(sliced, documents, RuleCompleter(), "a", "r", slices=4)
    keys = ["file", "chunknumber", "outcome", "id"]
    assert content(sliced.log(), keys) == content(whole.log(), keys)
    assert len(set(content(sliced.log(), ["id"]))) == sliced.log().count()


def test_breaker_stops_after_the_first_slice(spark, documents, spec, tmp_path):
    store = Store(spark, f"{tmp_path}/s", spec)
    with pytest.raises(BreakerTripped):
        run_extraction(store, documents, RuleCompleter(), "a", "r", breaker=Breaker(0, 0), slices=4)
    assert store.log().count() < store.chunks().count()


def test_ids_of_different_parts_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "b"), ("a", "\\b"), (None, "c"), ("", "c")]
    frame = spark.createDataFrame(rows, "tag string, run string")
    frame = frame.selectExpr("*", "'f' AS file", "1 AS chunknumber", "1 AS attempt")
    assert frame.select(request_id(F.col("tag"), F.col("run"))).distinct().count() == len(rows)


CALL = "file string, chunknumber int, attempt int, chunk_text string"


def calls(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


def failing(path, healthy=None):
    """A function that fails while ``healthy`` doesn't exist and notes every call."""

    def answer(payload: str) -> str:
        with open(path, "a") as file:
            file.write("call\n")
        if healthy is None or not healthy.exists():
            raise ConnectionError("refused")
        return json.dumps({"choices": [{"message": {"content": '{"title": "t", "quote": "q"}'}}]})

    return answer


@pytest.mark.parametrize("tasks,in_flight", ((1, 1), (40, 3)))
def test_failing_calls_stop_inside_the_wave(spark, spec, tmp_path, tasks, in_flight):
    documents = with_status(spark.range(600).selectExpr("concat('s/', id) AS file", "'Some words.' AS content"))
    store, noted, healthy = Store(spark, f"{tmp_path}/s", replace(spec, max_failures=5)), tmp_path / "calls", tmp_path / "healthy"
    completer = FunctionCompleter(failing(noted, healthy), tasks, in_flight)
    breaker = Breaker(max_errors=3)
    with pytest.raises(BreakerTripped):
        while True:
            run.run_extraction(store, documents, completer, "a", "r", breaker=breaker)
    # Every worker stops after its share of the limit; what was called is in the log.
    workers = spark.sparkContext.defaultParallelism
    assert 4 <= calls(noted) <= 4 + workers * in_flight + workers
    assert store.log().count() == calls(noted) == store.log().where("outcome = 'request_failed'").count()
    # What was left out is pending, and a run without the fault goes on with it.
    healthy.touch()
    failed = store.log().count()
    run_extraction(store, documents, completer, "a", "r")
    assert store.results().count() == 600 and store.log().count() == 600 + failed


def test_a_hanging_call_ends_at_its_deadline(spark, spec):
    def answer(payload: str) -> str:
        if "hang" in json.loads(payload)["messages"][1]["content"]:
            time.sleep(60)
        return json.dumps({"choices": [{"message": {"content": "{}"}}]})

    rows = [("s/1", i, 1, "hang" if i == 1 else "fine") for i in range(4)]
    spec = replace(spec, timeout=1)
    began = time.time()
    log = attempt(spark.createDataFrame(rows, CALL).coalesce(1), spec, FunctionCompleter(answer, None, 2), "a", "r", 1)
    found = {r.chunknumber: r for r in log.collect()}
    assert time.time() - began < 20
    assert found[1].outcome == "request_failed" and found[1].error_message.endswith("no reply within 1 s")
    assert found[1].latency_ms == 1000 and all(found[i].latency_ms < 1000 for i in (0, 2, 3))
    assert {found[i].outcome for i in (0, 2, 3)} == {"empty_object"}
    assert all(began - 1 <= r.timestamp.timestamp() <= time.time() for r in found.values())


def test_calls_in_flight_overlap_and_keep_their_order(spark, spec):
    def answer(payload: str) -> str:
        text = json.loads(payload)["messages"][1]["content"]
        time.sleep(0.1 + 0.01 * (int(text) % 3))
        value = json.dumps({"title": text, "quote": text})
        return json.dumps({"choices": [{"message": {"content": value}}]})

    rows = [("s/1", i, 1, str(i)) for i in range(64)]
    took = {}
    for in_flight in (1, 8):
        frame = spark.createDataFrame(rows, CALL).coalesce(1)
        log = attempt(frame, spec, FunctionCompleter(answer, None, in_flight), "a", "r", 1)
        began = time.time()
        found = log.collect()
        took[in_flight] = time.time() - began
        assert [r.chunknumber for r in found] == list(range(64))
        assert [r.extracted["title"] for r in found] == [str(i) for i in range(64)]
    assert took[8] < took[1] / 3


def test_scans_of_many_files_are_not_spread(spark, tmp_path):
    """A file per core keeps all cores busy, so the texts of such a scan are not shuffled; one file is spread."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(10 * cores).withColumn("text", F.lit("some text"))
    rows.repartition(cores).write.parquet(f"{tmp_path}/many")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        many, one = read("many"), read("one")
        assert cores <= many.rdd.getNumPartitions() < 2 * cores
        assert "Exchange" not in spread(many, "id")._jdf.queryExecution().executedPlan().toString()
        assert spread(one, "id").rdd.getNumPartitions() == 2 * cores or one.rdd.getNumPartitions() >= 2 * cores
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_resuming_writes_the_last_wave_only(spark, sf_dir, tmp_path, monkeypatch):
    documents = corpus(spark, sf_dir)
    store = Store(spark, f"{tmp_path}/store", SPEC)
    run_extraction(store, documents, RuleCompleter(), "a", "r", breaker=None)
    waves = []
    derive = Store.derive_results
    monkeypatch.setattr(Store, "derive_results", lambda self, tag, run, wave=None: waves.append(wave) or derive(self, tag, run, wave))
    before = store.results().count()
    run_extraction(store, documents, RuleCompleter(), "a", "r", breaker=None)
    assert waves == [2] and store.results().count() == before
