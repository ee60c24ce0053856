"""Time the headline queries on the bench tables and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from gleanframe.plans.queries import QUERIES
from gleanframe.session import local_session

HEADLINE = (
    "chunk_bounds", "chunk_text", "chunk_slices", "chunk_stats", "register_chunks",
    "pending_chunks", "run_summary", "consecutive_failures", "latest_attempt",
    "envelope_parse", "json_clean", "outcome", "completion_wave", "run_waves",
    "run_compare", "label_agreement", "fill_rate", "quote_grounding", "top_results",
    "text_normalize", "pages_to_text", "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    chunks = QUERIES["chunk_bounds"](spark, sf_dir).count()
    rates = {
        "chunks_per_sec": round(chunks / times["chunk_bounds"]),
        "attempts_parsed_per_sec": round(chunks / times["outcome"]),
        "pending_sec": times["pending_chunks"],
        "full_run_sec": times["run_waves"],
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
