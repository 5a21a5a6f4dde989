"""Times the stages of a run and the report queries; prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.plans import dashboard, gates, quality
from revlens.plans.marts import MART_NAMES
from revlens.session import configured
from revlens.testbed.binding import Workspace
from revlens.testbed.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def materialise(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    builder = builder.config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    spark = configured(builder, int(CPUS)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work = Workspace(spark, FOLDER)
    seconds: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> object:
        started = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    # the stages, in the order a run builds them; each is written once
    timed("land_raw_lines", lambda: work.raw)
    raw_rows = work.raw.count()
    timed("clean", lambda: work.cleaned)
    timed("star", lambda: work.star)
    timed("order_heads", lambda: work.marts.order_heads)
    timed("product_totals", lambda: work.marts.product_totals)
    for name in MART_NAMES:
        timed(name, lambda name=name: getattr(work.marts, name))
    timed("gates", lambda: gates.gate_report(work.cleaned, work.star, work.marts).collect())
    timed("quality_report", lambda: quality.quality_report(work.cleaned))
    timed("dashboard", lambda: dashboard.payload(work.star, work.marts))
    # report and audit queries over the finished stages
    for name, query in QUERIES.items():
        if name not in seconds:
            timed(name, lambda query=query: materialise(query(work)))
    clean_seconds = seconds["clean"]
    warehouse_seconds = sum(
        seconds[name] for name in ("star", "order_heads", "product_totals", *MART_NAMES, "gates")
    )
    print(
        json.dumps(
            {
                "metric": "full_run_and_all_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "raw_rows": raw_rows,
                "clean_rows_per_sec": round(raw_rows / clean_seconds),
                "warehouse_rows_per_sec": round(raw_rows / warehouse_seconds),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
