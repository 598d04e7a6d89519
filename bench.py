"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads and
``BENCH_REPEAT`` the warm runs per query (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablecraft.session import build_session  # noqa: E402
from tablecraft.suite import QUERIES  # noqa: E402

HEADLINE = (
    "daily_revenue", "model_join", "inc_merge", "inc_delete_insert", "inc_append", "scd_cycle", "scd_hard_delete",
    "part_ts_trunc", "cluster_by", "fn_surrogate_key", "fn_listagg", "fn_datediff", "evo_combined", "redact_text",
    "conv_fold", "golden_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false"}
    spark = build_session("bench", f"local[{cpus}]", settings)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
