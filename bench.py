"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetsift.plans import load_all  # noqa: E402
from fleetsift.plans.registry import QUERIES  # noqa: E402
from fleetsift.session import build_session  # noqa: E402

HEADLINE = (
    "s10_duplicate_detect", "s14_line_cache", "d03_rank_threshold", "p09_scoped_match", "x02_ios_entries",
    "c21_fleet_evaluate", "a12_observations", "b05_outliers", "t05_cluster", "t12_field_dedupe", "h01_scrub_line",
    "l05_chain_verify",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    spark.sparkContext.setLogLevel("OFF")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
