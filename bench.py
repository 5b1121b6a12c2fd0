"""Headline queries, timed: BENCH_SF_DIR and BENCH_CPUS set the data and the cores.

Each query runs to a no-op sink, so every row and column is computed.  A query is run up to
three times (fewer when a run is long) and the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from colloquy.catalog.everything import REGISTRY  # noqa: E402
from colloquy.session import local_session  # noqa: E402

HEADLINE = (
    "a02_overview",
    "j03_effective_plan",
    "a07_usage_dashboard",
    "w18_first_boundary_time",
    "t02_webhook_route",
    "t08_latency_alert",
    "w02_char_budget_chunks",
    "x01_sentence_split",
    "x02_cue_signals",
    "a12_action_consolidate",
    "x05_v3_actions",
    "q05_regression_eval",
    "q07_engine_v1",
    "q08_engine_v2",
    "q09_engine_v3",
)
LONG_RUN = 20.0


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # one small run starts the workers and the code generator
    timed(REGISTRY["a01_status_counts"].run, spark, sf_dir)
    seconds: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        while len(runs) < 3 and not (runs and runs[-1] > LONG_RUN):
            runs.append(timed(REGISTRY[name].run, spark, sf_dir))
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    talk = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cores": cpus,
                "driver_memory": spark.conf.get("spark.driver.memory", "default"),
                "transcripts": talk,
                "transcripts_per_sec_engine_v1": round(talk / seconds["q07_engine_v1"], 1)
                if "q07_engine_v1" in seconds
                else None,
            }
        )
    )


if __name__ == "__main__":
    main()
