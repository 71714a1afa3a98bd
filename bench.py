"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import load  # noqa: E402
from lectern.session import build_session  # noqa: E402

HEADLINE = (
    "bm25_topk dense_topk rrf_fuse lexical_rerank ir_metrics_rollup search_batch tfidf_weights page_blocks "
    "segment_headings outline_asof chapter_link extraction_diff chapter_readiness progress_report calendar_union "
    "practice_queue verify_keys gradebook upsert_latest delete_preview stream_engagement"
).split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = load()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
