"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is fully executed with the ``noop`` sink (all rows produced,
nothing collected to the driver), after one untimed warm-up pass of the same
queries on a smaller scale factor.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedlens.plans.queries import QUERIES  # noqa: E402
from feedlens.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "daily_pivot", "avg_sentiment", "last_comment", "stars_matrix",
    "word_cloud", "ngrams_all", "top_bigrams",
    "stratified_split", "balanced_set", "quota_sample",
    "eval_by_source", "eval_loss", "retrieve_topk", "answers", "decode_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), "feedlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # Warm-up: the same plans once on a smaller scale factor (JIT and codegen caches), not timed.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm):
        for n in names:
            QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
