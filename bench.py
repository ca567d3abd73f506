"""Times the headline queries of the dialect over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times; the median counts. Results are written to the noop sink, so
that every row is made and none is collected. One engine serves all runs over a folder, so footers are read in the warm-up run;
dml_* copy a table into a fresh store each time, and that copy is in their figure.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from loomq.queries import queries  # noqa: E402

HEADLINE = [
    "scan_project", "filter_and_or_not", "filter_like", "point_lookup", "arith", "div_zero", "join_inner", "join_left", "join_self_theta", "join_chain_filter", "agg_global", "agg_distinct", "agg_having", "agg_join_having_topk",
    "pricing_summary", "revenue_by_nation", "sort_limit_offset", "distinct", "dml_update", "dml_delete",
]
RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("loomq-bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            at = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - at)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
