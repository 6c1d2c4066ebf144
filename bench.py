"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then up to three times; the median counts. Results go to the
no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliospark.plans.queries import QUERIES  # noqa: E402
from foliospark.session import local_session  # noqa: E402

HEADLINE = (
    "word_counts", "quote_books", "quote_orders", "price_catalogue", "charge_lines", "delivery_resolve",
    "translation_requests", "windowed_requests", "mark_spans", "structure_check", "results_by_order",
    "payment_events_to_orders", "orders_stream", "staged_upsert", "status_transitions", "selection_fold",
    "notification_outbox", "strategy_contract", "strategy_render", "docx_bulk_extract",
)
SLOW = 6.0  # seconds; slower queries are timed once


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, folder, name)
        taken = [run(spark, folder, name)]
        while len(taken) < 3 and taken[0] < SLOW:
            taken.append(run(spark, folder, name))
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
