"""Watch a request log while it grows: failure rates over event time.

A window's counts are kept as state until the watermark passes its end, then written once;
later rows of it are dropped.  State is one row per open window and run tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Length of a window and how late a row may come.
WINDOW = "1 day"
LATENESS = "2 days"


def failure_rate(log: DataFrame, at: Column, length: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """``(window_start, window_end, run_tag, attempts, failures, failure_rate)`` of a log.

    ``log`` has ``success`` and ``run_tag`` and may be a stream or a table; ``at`` is the time
    of the attempt.  Rows without a time are in no window.
    """
    timed = log.withColumn("at", at.cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("at", lateness)
    failed = F.count_if(~F.col("success"))
    counted = timed.groupBy(F.window("at", length).alias("w"), "run_tag").agg(
        F.count("*").alias("attempts"), failed.alias("failures")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "run_tag",
        "attempts", "failures", (F.col("failures") / F.col("attempts")).alias("failure_rate"),
    )


def monitor(rates: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append finished windows to a table; stops when the input is used up unless there is an ``interval``.

    Started again with the same checkpoint it goes on with the windows it had open.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        rates.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def tripped_windows(rates: DataFrame, limit: float) -> DataFrame:
    """Windows in which more than ``limit`` of the attempts failed."""
    return rates.where(F.col("failure_rate") > limit)
