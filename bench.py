"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up run; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from changelake.plans import fixtures as fx  # noqa: E402
from changelake.plans.registry import Tables, execute  # noqa: E402
from changelake.operators import versions as v  # noqa: E402
from changelake.operators.envelope import decode  # noqa: E402
from changelake.session import build  # noqa: E402

HEADLINE = (
    "active_by_type", "decode_full", "decode_lineitem", "latest_lineitem", "active_lineitem", "agg_by_type",
    "agg_global", "summary_lineitem", "op_counts_recent", "op_rates_minute", "audit_trail", "as_of_state",
    "expire_deleted", "compact_partition", "diff_snapshots", "field_summary", "count_check", "table_counts",
    "p95_by_type", "classify_queries", "rule_hits", "throughput_series", "tsv_round_trip", "point_lookup",
    "active_title_basics", "active_title_principals", "stream_ingest", "stream_latest",
)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build("bench", f"local[{cpus}]", cpus, spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def median(run) -> float:
        timed(run)
        return round(statistics.median(timed(run) for _ in range(runs)), 3)

    times = {name: median(lambda n=name: execute(n, spark, sf_dir)) for name in HEADLINE}

    # Decode throughput alone: messages lie in files, as many as there are cores.
    t = Tables(spark, sf_dir)
    folder = tempfile.mkdtemp(prefix="changelake-bench-")
    fx.lineitem_messages(t.lineitem.repartition(2 * cpus, *t.lineitem.columns)).write.parquet(f"{folder}/messages")
    messages = spark.read.parquet(f"{folder}/messages")
    n = messages.count()
    stored = median(lambda: decode(messages, fx.LINEITEM))
    resolved = median(lambda: v.latest(decode(messages, fx.LINEITEM), fx.LINEITEM.keys))
    times |= {"stored_decode": stored, "stored_decode_latest": resolved}

    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries (median of runs)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "messages": n,
                "decode_rows_per_sec": round(n / stored),
                "decode_latest_rows_per_sec": round(n / resolved),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
