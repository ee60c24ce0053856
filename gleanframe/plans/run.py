"""The resumable run: waves of attempts until nothing is pending.

Chunks are independent.  A chunk leaves with its first success or its ``max_failures``-th
failure in the run.  The state is the store's tables alone: before each wave the pending
query says what is left, so a stopped run continues from them and documents that were
added meanwhile join it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.attempts import attempt
from gleanframe.operators.chunks import CHUNK_KEY, chunk_texts, slice_chunks, usable
from gleanframe.operators.completion import Completer, FunctionCompleter
from gleanframe.operators.pending import failures_since, pending_chunks
from gleanframe.operators.store import Store

# Outcomes that count as execution errors, and as warnings.
ERROR_OUTCOMES = ("request_failed",)
WARNING_OUTCOMES = ("empty_chunk", "bad_json", "empty_object", "missing_required")
# A run stops beyond these counts when a breaker is set up with its defaults.
MAX_ERRORS = 3
MAX_WARNINGS = 10


@dataclass(frozen=True)
class Breaker:
    """Stops a run once errors or warnings exceed their limits.

    Every slice or wave is counted when it has been committed.  Inside of it a completer that
    can pause leaves further rows alone when its share of the errors left is used up in a
    Python worker, so calls that all fail end after the limit and the calls in flight, not
    after the corpus.
    """

    max_errors: int = MAX_ERRORS
    max_warnings: int = MAX_WARNINGS

    def share(self, counts: list[dict], workers: int) -> int:
        """Errors after which one of so many workers pauses; together they pass the limit."""
        left = self.max_errors + 1 - sum(c["errors"] for c in counts)
        return max(1, -(-left // workers))

    def trips(self, counts: list[dict]) -> bool:
        errors = sum(c["errors"] for c in counts)
        warnings = sum(c["warnings"] for c in counts)
        return errors > self.max_errors or warnings > self.max_warnings


class BreakerTripped(RuntimeError):
    pass


def outcome_counts(log: DataFrame) -> DataFrame:
    """Attempts, errors and warnings per wave of a log."""
    is_error = F.col("outcome").isin(*ERROR_OUTCOMES).cast("int")
    is_warning = F.col("outcome").isin(*WARNING_OUTCOMES).cast("int")
    return log.groupBy("run_tag", "run_id", "wave").agg(
        F.count("*").alias("attempts"),
        F.sum(is_error).alias("errors"),
        F.sum(is_warning).alias("warnings"),
    )


def breaker_state(log: DataFrame, breaker: Breaker) -> DataFrame:
    """Cumulative counts after each wave and whether the run stops there.

    At most ``max_failures`` rows per run reach the window.
    """
    counts = outcome_counts(log)
    so_far = (
        Window.partitionBy("run_tag", "run_id")
        .orderBy("wave")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = counts.withColumns(
        {"errors_so_far": F.sum("errors").over(so_far), "warnings_so_far": F.sum("warnings").over(so_far)}
    )
    tripped = (F.col("errors_so_far") > breaker.max_errors) | (
        F.col("warnings_so_far") > breaker.max_warnings
    )
    return total.withColumn("tripped", tripped)


def run_extraction(
    store: Store,
    documents: DataFrame,
    completer: Completer,
    run_tag: str,
    run_id: str,
    breaker: Breaker | None = Breaker(),
    max_waves: int | None = None,
    slices: int = 1,
) -> list[dict]:
    """Register, attempt and store until nothing is pending; one summary per wave.

    A wave is what is committed at once: all pending chunks, or with ``slices`` those of
    one hash slice, so that a stopped run loses a slice of calls at most and the breaker
    looks after each slice.  Without a breaker a run goes on whatever fails.

    A completer that pauses leaves rows out of a wave; they are pending like any other.

    Call it again with the same ``run_id`` to continue a stopped run, with a new one to
    give every unfinished chunk a fresh failure budget.  Only counts per wave come back
    to the driver.
    """
    if not run_tag or not run_id:
        raise ValueError("run_tag and run_id must not be empty")
    fresh = not store.has_chunks()
    store.register_chunks(documents)
    earlier = wave_counts(store, run_tag, run_id)
    if earlier:
        # Waves are closed in order, so only the results of the last one can be missing.
        store.derive_results(run_tag, run_id, earlier[-1]["wave"])
    wave = max((c["wave"] for c in earlier), default=0) + 1
    summaries: list[dict] = []
    counts = earlier
    turn = idle = 0
    # The run ends when every slice in turn has nothing left that could be attempted.
    while idle < slices and (max_waves is None or len(summaries) < max_waves):
        if fresh and slices == 1 and not earlier and not summaries and not idle:
            # Everything was registered just now: text comes with the cut, map-only.
            requests = chunk_texts(documents, store.spec.chunk_size).withColumn("attempt", F.lit(1))
        else:
            left = _pending(store, run_tag, run_id)
            if slices > 1:
                left = left.where(F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(slices)) == turn % slices)
            turn += 1
            if left.isEmpty():
                idle += 1
                continue
            requests = slice_chunks(left, usable(documents), carry=("attempt",))
        requests = requests.select("file", "chunknumber", "attempt", "chunk_text")
        asked = completer
        if breaker and isinstance(completer, FunctionCompleter):
            workers = store.spark.sparkContext.defaultParallelism
            asked = completer.pausing(uuid.uuid4().hex, breaker.share(counts, workers))
        attempts = attempt(requests, store.spec, asked, run_tag, run_id, wave)
        store.write_wave(attempts, run_tag, run_id, wave)
        counts = wave_counts(store, run_tag, run_id)
        if not counts or counts[-1]["wave"] != wave:
            idle += 1  # what is pending has no document any more
            continue
        idle = 0
        wave += 1
        summaries.append(counts[-1])
        if breaker and breaker.trips(counts):
            raise BreakerTripped(f"run {run_id} stopped after wave {wave - 1}: {counts}")
    return summaries


def wave_counts(store: Store, run_tag: str, run_id: str) -> list[dict]:
    counts = outcome_counts(store.run_log(run_tag, run_id)).orderBy("wave")
    return [row.asDict() for row in counts.collect()]


def _pending(store: Store, run_tag: str, run_id: str) -> DataFrame:
    """Chunks the run has yet to attempt, with the number of the next attempt at each.

    A chunk's own failures in this run count, so chunks that joined later have their full
    budget.
    """
    log = store.run_log(run_tag, run_id)
    pending = pending_chunks(store.chunks(), store.results(), log, store.spec.max_failures, run_tag=run_tag)
    failed = failures_since(log, None)
    next_attempt = F.coalesce(F.col("failures"), F.lit(0)).cast("int") + 1
    return pending.join(failed, CHUNK_KEY, "left").withColumn("attempt", next_attempt).drop("failures")
