"""Times the headline queries and prints one JSON line.

Each query runs to completion with its result discarded: once to warm up, then up to three times
within a few seconds, of which the median counts. `BENCH_SF_DIR` names the data and `BENCH_CPUS` the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beaconry.plans import load  # noqa: E402
from beaconry.session import build_session  # noqa: E402

# A query of the published suite, and the registered query that does the same work here.
HEADLINE = {
    "tail_newest_1000": "tail_latest",
    "token_search": "text_any_token",
    "two_tokens_and": "text_all_token",
    "phrase": "text_phrase",
    "substring_scan": "text_substring",
    "filter_time": "filter_time",
    "severity_floor": "severity_at_least",
    "group_by_map_key": "group_by",
    "top_n_by_resource": "top_n",
    "full_range_histogram": "log_histogram",
    "rows_of_resources": "select_group",
    "trace_lookup": "trace_lookup",
    "service_map": "service_map",
    "service_latency": "service_latency",
    "timeline": "timeline",
    "counter_rate": "rate_agg",
    "rollup_metrics": "rollup_metrics_1h",
    "rollup_flows": "rollup_flows_5m",
    "top_talkers": "top_talkers",
    "alert_values": "alert_threshold_values",
    "alert_cycle": "alert_fsm",
    "syslog_parse": "parse_syslog",
    "security_events": "sec_events",
    "subnets": "subnet_utilisation",
}
RUNS, SECONDS = 3, 4.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    for label, name in HEADLINE.items():
        taken = []
        while len(taken) < 2 or (len(taken) <= RUNS and sum(taken[1:]) < SECONDS):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[label] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "median seconds of the headline queries, summed", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
