"""From replies to log rows and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.replies import classify
from gleanframe.operators.completion import Completer
from gleanframe.spec import LOG_SCHEMA, ExtractionSpec


def request_id(run_tag: Column, run_id: Column) -> Column:
    """A stable id per attempt: the same after a task is retried or a wave rewritten.

    Separators inside a part are escaped, so different parts never give the same text.
    """
    parts = [run_tag, run_id, F.col("file"), F.col("chunknumber"), F.col("attempt")]
    escaped = [F.regexp_replace(part.cast("string"), r"([\\|])", r"\\$1") for part in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(part, F.lit("\\N")) for part in escaped]), 256)


def attempt(
    requests: DataFrame,
    spec: ExtractionSpec,
    completer: Completer,
    run_tag: str,
    run_id: str,
    wave: int,
) -> DataFrame:
    """One attempt per request row, as log rows; a plain chain of projections."""
    replied = completer(requests, spec)
    return as_log(classify(replied, spec.required_nodes), spec, run_tag, run_id, wave)


def as_log(
    classified: DataFrame, spec: ExtractionSpec, run_tag: str, run_id: str, wave: int
) -> DataFrame:
    """Log rows; the time of an attempt is the start of its call where the completer says it."""
    now, took = F.current_timestamp(), F.lit(None).cast("long")
    if "started_at" in classified.columns:
        now, took = F.coalesce("started_at", now), F.col("latency_ms")
    stamped = classified.withColumns(
        {
            "run_tag": F.lit(run_tag),
            "run_id": F.lit(run_id),
            "wave": F.lit(wave),
            "timestamp": now,
            "latency_ms": took,
            "model": F.lit(spec.model),
        }
    )
    return stamped.withColumn("id", request_id(F.col("run_tag"), F.col("run_id"))).select(
        *LOG_SCHEMA.fieldNames()
    )


def as_results(log: DataFrame, spec: ExtractionSpec) -> DataFrame:
    """Successful attempts as result rows: one column per stored node, absent nodes NULL."""
    extracted = F.col("extracted")
    stored = [
        F.try_element_at(extracted, F.lit(node)).alias(column)
        for node, column in spec.db_columns.items()
    ]
    return log.where(F.col("success")).select(
        F.col("id").alias("request_id"),
        "file",
        "chunknumber",
        *stored,
        "run_tag",
        "run_id",
        "wave",
    )


def replay(log: DataFrame, spec: ExtractionSpec) -> DataFrame:
    """Parse stored replies again, for instance with a changed spec, without new calls."""
    kept = log.withColumn(
        "_chunk_text", F.when(F.col("outcome") == "empty_chunk", "").otherwise("kept")
    ).drop("success", "outcome", "error_message", "extracted")
    return classify(kept, spec.required_nodes, text="_chunk_text").drop("_chunk_text")
