"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to a full materialization of all its columns (noop sink).
"""

from __future__ import annotations

import json
import os
import time

from paperweave.plans import load_all
from paperweave.plans.registry import QUERIES
from paperweave.session import build_session

HEADLINE = (
    "coauthor_edges", "degree_strength", "connected_components", "communities_lpa", "semantic_edges",
    "country_network", "subject_cooccurrence", "publication_duplicates", "author_positions", "subgraph_ego",
    "relation_counts", "citations_in", "results_by_type_per_org", "access_per_country", "org_paper_pairs",
    "normalize_text", "embedding_plan", "coauthor_nodes", "exact_duplicates", "source_record_dedupe",
    "knn_lsh",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
