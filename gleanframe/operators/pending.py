"""What is left to do, what was given up, and how a run went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.chunks import CHUNK_KEY


def failures_since(log: DataFrame, since: Column | None) -> DataFrame:
    """Failed attempts per chunk after ``since`` (exclusive), or in the whole log given."""
    failed = log.where(~F.col("success"))
    if since is not None:
        failed = failed.where(F.col("timestamp") > since)
    return failed.groupBy(*CHUNK_KEY).agg(F.count("*").alias("failures"))


def pending_chunks(
    chunks: DataFrame,
    results: DataFrame,
    log: DataFrame,
    max_failures: int,
    since: Column | None = None,
    run_tag: str | None = None,
) -> DataFrame:
    """Chunks without a result and with fewer than ``max_failures`` failures since ``since``.

    With a run tag only that tag's results count as done; without one any result does.
    Both exclusions are anti-joins on one key, and both right sides are reduced to
    unique keys first, so a chunk with very many attempts is combined before the shuffle.
    """
    if run_tag:
        results = results.where(F.col("run_tag") == run_tag)
    done = results.select(*CHUNK_KEY).distinct()
    given_up = failures_since(log, since).where(F.col("failures") >= max_failures)
    return chunks.join(done, CHUNK_KEY, "left_anti").join(
        given_up.select(*CHUNK_KEY), CHUNK_KEY, "left_anti"
    )


def in_window(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Log rows of a run interval, both ends included."""
    return log.where((F.col("timestamp") >= start) & (F.col("timestamp") <= end))


def skipped_chunks(log: DataFrame, start: Column, end: Column, max_failures: int) -> DataFrame:
    """Chunks that reached the failure limit inside the interval."""
    failed = in_window(log, start, end).where(~F.col("success"))
    return (
        failed.groupBy(*CHUNK_KEY)
        .agg(F.count("*").alias("failures"))
        .where(F.col("failures") >= max_failures)
    )


def results_in_window(results: DataFrame, log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Results whose request was logged inside the interval."""
    ids = in_window(log, start, end).select(F.col("id").alias("request_id"))
    return results.join(ids, "request_id", "left_semi")


def retry_budget(log: DataFrame, since: Column, max_failures: int) -> DataFrame:
    """Failures since the run began and attempts left, for every chunk in the log."""
    failed = (~F.col("success") & (F.col("timestamp") > since)).cast("int")
    return log.groupBy(*CHUNK_KEY).agg(
        F.sum(failed).alias("failures"),
        F.greatest(F.lit(max_failures) - F.sum(failed), F.lit(0)).alias("attempts_left"),
    )


def run_summary(
    log: DataFrame, results: DataFrame, start: Column, end: Column, max_failures: int
) -> DataFrame:
    """One row: attempts, stored results, skipped chunks, and the interval's length."""
    counted = {
        "llm_calls": in_window(log, start, end),
        "successes": results_in_window(results, log, start, end),
        "skipped": skipped_chunks(log, start, end, max_failures),
    }
    parts = [
        table.agg(*[(F.count("*") if n == name else F.lit(0)).alias(n) for n in counted])
        for name, table in counted.items()
    ]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return total.agg(*[F.sum(n).alias(n) for n in counted]).withColumn(
        "duration_us", F.timestamp_diff("MICROSECOND", start, end)
    )


def consecutive_failures(log: DataFrame, salts: int = 16) -> DataFrame:
    """Failures later than each chunk's last success, all where it never succeeded.

    Attempts are salted, so those of one very frequent chunk are compared in ``salts``
    tasks instead of one.  The other side of the join holds one row per chunk and salt
    that occurs, so chunks with few attempts are not multiplied.
    """
    salted = log.select(
        *CHUNK_KEY, "success", "timestamp", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")
    )
    success_at = F.when(F.col("success"), F.col("timestamp"))
    per_salt = salted.groupBy(*CHUNK_KEY, "salt").agg(F.max(success_at).alias("success_at"))
    # At most ``salts`` rows per chunk reach the window.
    last = F.max("success_at").over(Window.partitionBy(*CHUNK_KEY)).alias("last_success")
    bounds = per_salt.select(*CHUNK_KEY, "salt", last)
    never = F.col("last_success").isNull()
    after = ~F.col("success") & (never | (F.col("timestamp") > F.col("last_success")))
    return (
        salted.join(bounds, [*CHUNK_KEY, "salt"])
        .groupBy(*CHUNK_KEY)
        .agg(F.sum(after.cast("int")).alias("consecutive_failures"))
    )


def latest_attempt(log: DataFrame) -> DataFrame:
    """Attempts so far and the most recent one, as a combinable aggregate per chunk."""
    order = F.struct("timestamp", "id")
    return (
        log.groupBy(*CHUNK_KEY)
        .agg(
            F.count("*").alias("attempts"),
            F.max_by(F.struct("id", "timestamp", "success"), order).alias("latest"),
        )
        .select(*CHUNK_KEY, "attempts", "latest.*")
    )
