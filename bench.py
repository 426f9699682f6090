"""Headline timings: prints one JSON line."""

import json
import os
import time

from emberline.plans.catalog import QUERIES
from emberline.plans.load import load_catalog
from emberline.session import local_session

HEADLINE = ["screen_components", "screen_parameters", "loo_scale", "trend_screen", "ridge_oof_sigma", "lolo_cv", "sensor_enrichment", "upload_profile", "forecast_metrics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_catalog()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).replace("sf", "")}))


if __name__ == "__main__":
    main()
