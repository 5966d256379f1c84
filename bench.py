"""Time the stages of one assembly; prints one JSON line.

``queries`` holds seconds per stage, each including the write of its result; ``value``
is their sum.
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandweave import build_session  # noqa: E402
from strandweave.plans.assembly import Assembly  # noqa: E402
from strandweave.sources.tables import MIN_OVERLAP_LEN, sampled_reads  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(int(cpus) * 2 if cpus.isdigit() else 16),
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = Assembly(sampled_reads(spark, sf_dir), MIN_OVERLAP_LEN)
    cycle_len = run.cycle.count()
    rows = {
        "reads": run.reads.count(), "overlaps": run.overlaps.count(),
        "reduced": run.reduced_rope.edges.count(), "collapsed": run.collapsed_rope.edges.count(),
        "cycle": cycle_len,
    }
    spark.stop()
    total = round(sum(run.seconds.values()), 3)
    print(json.dumps({
        "metric": "assembly_stages_total", "value": total, "unit": "sec", "queries": run.seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
        "overlaps_per_sec": round(rows["overlaps"] / run.seconds["overlaps"], 1),
    }))


if __name__ == "__main__":
    main()
