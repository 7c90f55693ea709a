"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, _HERE)
# Python workers find the package in whatever folder the benchmark runs.
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([_HERE, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))

HEADLINE = [
    "scan_gkg", "normalize_candidates", "dedup_url", "relevance_score", "category_scores", "quality_checks",
    "trigram_similarity", "news_list", "page_keyset", "feed_sections", "home_layout", "also_reported_by",
    "related_in_category", "sources_public", "ingestion_summary", "backfill_plan", "outbox_project", "retention",
    "bookmark_merge", "bm25_search", "dedup_assign",
]


def main() -> None:
    from newsloom.catalog import QUERIES
    from newsloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "newsloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.time()
        # Every row and column is computed and thrown away.
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
