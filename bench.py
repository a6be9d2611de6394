"""Seconds of the headline queries: one JSON line. BENCH_SF_DIR names the tables' folder, BENCH_CPUS the threads."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "province_stats", "province_stats_10s", "visitor_stats", "product_stats", "order_wide", "payment_interval_join", "user_jump",
    "unique_visit", "new_visitor_repair", "cdc_route_dim", "keyword_stats", "keyword_product_c2r",
]


def main() -> None:
    from tidewater.plans import catalog
    from tidewater.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 2)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
