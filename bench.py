"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], warm; prints one JSON line."""

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logweave.plans.queries import QUERIES  # noqa: E402
from logweave.session import build_session  # noqa: E402

HEADLINES = [
    "assemble_transactions",
    "split_transactions",
    "record_headers",
    "build_records",
    "order_log_transactions",
    "order_log_records",
    "assign_seqid",
    "fan_in",
    "publish_records",
    "resequence",
    "pending_status",
    "gap_report",
    "contiguous_watermark",
    "route_messages",
    "pack_messages",
    "unpack",
    "segment_log",
    "rewrite_positions",
    "verify_segments",
    "throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("logweave-bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        run(name)  # start-up of workers and code generation are not the query
        timings[name] = round(run(name), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, second run of each",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
