"""Times the headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]` and prints one JSON line.

Every query runs in full into the no-op sink (a stored result would add the cost of the sink, a count would
let the optimizer drop columns). One untimed run per query warms the JVM, the next one is timed (`$BENCH_REPEAT` runs: the best of them).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from tiltmeter.session import build_session  # noqa: E402

HEADLINE = (
    "window_features", "sweep_windows", "sweep", "sweep_adr", "consensus", "injection_flips", "negative_summary",
    "timeline", "clean_posts", "score_lexicon", "score_distinct", "score_udf", "time_jitter", "heuristic_policy", "decide_bucketed",
    "market_frame", "drift_steps", "consensus_steps", "pnl_steps", "stream_windows",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    seconds: dict[str, float] = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(min(run(spark, name, folder) for _ in range(repeat)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
