"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope.catalog import registry  # noqa: E402
from folioscope.session import local_session  # noqa: E402

HEADLINE = (
    "rag_chunks", "rag_chunks_native", "chunk_lines", "confident_lines", "reading_order", "extract_record", "extract_vin",
    "annotate_lines", "translate_longest", "nms", "iou_pairs", "image_detections", "damage_job", "damage_reports", "claim_rollup",
    "latency_summary", "latency_histogram", "response_metrics", "quality_report", "drop_warmup", "threshold_sweep",
    "breaker_states", "flatten_json", "identity_score", "batch_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # session warm-up
    timings = {}
    for key in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        registry.queries()[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[key] = round(time.perf_counter() - started, 3)
        print(f"{key}: {timings[key]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
