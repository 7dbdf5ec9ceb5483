"""Times the headline queries on one local session and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "byte_chi2", "byte_entropy", "window_verdict_chi2", "window_verdict_overlap", "text_verdict", "fixed_scan",
    "adaptive_scan", "dirty_union", "asof_end", "changed_blocks", "delta_blocks", "detect_regions", "map_blocks",
    "restore_blocks", "islands_by_status", "merge_spans", "gap_spans", "interval_stab", "range_chunks",
    "compare_three_way", "region_keep_flags", "block_summary", "text_decisions", "verify_recall", "basic_stats",
    "zip_verdict", "ooxml_verdict", "pdf_verdict", "zip_decisions", "detect_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from epochlens import catalog
    from epochlens.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    # One small job so that the first query does not pay for the start of the workers.
    catalog.QUERIES["byte_chi2"](spark, sf_dir).limit(1).count()
    took = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
