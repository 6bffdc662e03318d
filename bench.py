"""Time the headline queries: one JSON line, median of warm runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from driftpanel import get_spark
from driftpanel.checks import fixtures as fx
from driftpanel.checks.queries import QUERIES

HEADLINE = [
    "panel_wide",
    "pseudo_residual",
    "change_summary",
    "transition_risk_by_quartile",
    "model_selection",
    "composition_by_quartile",
    "change_by_tercile",
    "histogram",
]
RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("driftpanel-bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, warm median",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
                "lineitem_rows": fx.table(spark, sf_dir, "lineitem").count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
