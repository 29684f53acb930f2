"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from lorespark.checks import QUERIES  # noqa: E402
from lorespark.session import local_session  # noqa: E402

HEADLINE = [
    "keyword_channel", "structure_channel", "vector_channel", "hybrid_search", "semantic_pairs",
    "co_occurrence_pairs", "graph_edges", "ingest_documents", "chunk_markdown", "postings_build",
    "exact_duplicates", "upsert_documents", "consistency_issues", "search_hourly", "key_usage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    # Warm the JVM and the Python workers, on the smallest tables where they are at hand.
    small = Path(sf_dir).parent / "sf0.001"
    for name in ("keyword_channel", "vector_channel"):
        QUERIES[name](spark, str(small if small.is_dir() else sf_dir)).write.format("noop").mode(
            "overwrite").save()
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
