"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "url_canonical", "html_to_text", "links_classified", "query_tokens", "coverage_scores", "prerank_topk", "postrank_topk", "passages_best", "bm25_topk", "exact_dupes",
    "shingle_jaccard", "minhash_neardup", "containment_join", "cache_evict", "consumed_anti", "grade_components", "error_rate_windows", "capacity_controller", "star_revenue_by_region", "star_window",
]


def main() -> None:
    from lucerna.plans import catalogue
    from lucerna.session import local, ship

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "256k"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
