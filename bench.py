"""Bench: run the headline catalogue queries at $BENCH_SF_DIR on
local[$BENCH_CPUS], each fully executed through the ``noop`` sink (no
collect), and print ONE JSON line with per-query wall seconds."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.plans import catalog  # noqa: E402
from tideline.session import build_session  # noqa: E402

HEADLINE = [
    "unified_timeline_5m",   # grid + as-of + interval + decay + bin aggregates (J1-J6, A1-A6)
    "features",              # 44 window features + labels (W1-W11)
    "unified_timeline_1h",
    "gap_report",
    "regression_metrics",
    "alerts",
    "forecast_truth_join",
    "rolling_mae_6h",
    "drift_status",
    "scenario_rewrite",
    "union_pump_streams",
    "gbt_backtest",
    "contributions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    # warm-up: JVM, parquet footer cache
    catalog.QUERIES["time_in_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "catalogue_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
