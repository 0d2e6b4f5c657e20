"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the local cores. Each query is built and written to the no-op sink;
the first of them also pays for starting the Python workers, so one untimed
query runs first.
"""

from __future__ import annotations

import json
import os
import time

from tapeloom.queries import QUERIES
from tapeloom.session import build_session

HEADLINE = [
    "second_bars", "microstructure_bars", "prevailing_quotes", "quote_gaps", "bar_features", "barrier_labels", "taker_oracle",
    "maker_oracle", "taker_fills", "threshold_sweep", "training_set", "runner_days", "factors", "cross_ranks", "monthly_portfolio",
    "book_features", "book_backtest", "direction_labels", "matched_fills", "latest_orders", "screened_intents", "performance_metrics",
    "robust_scaler", "decile_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=str(2 * int(cpus)), **{"spark.ui.showConsoleProgress": "false"})
    QUERIES["barrier_labels"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
