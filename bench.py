"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpusmill.plans import catalog, rules, structure  # noqa: F401  rules and structure register their queries
from corpusmill.session import session

HEADLINE = ["bm25_offline_topk", "bm25_okapi_topk", "rrf_fusion", "ndcg_map_mrr", "vector_topk_cosine", "exact_dup_groups", "content_type_classify", "token_hash_vector", "contamination_join", "snapshot_diff", "session_windows", "family_collapse", "quality_checks", "near_dup_kept", "quality_report", "heading_paths"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
