"""Benchmark of the headline workloads.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each workload is forced to completion (``noop`` sink or an aggregate) so
no result is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def session(cpus: int) -> SparkSession:
    from mixdetect.plans.session import recommended_conf

    b = SparkSession.builder.master(f"local[{cpus}]").appName("mixdetect-bench")
    for k, v in recommended_conf(cpus).items():
        b = b.config(k, v)
    spark = b.config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = session(cpus)

    from mixdetect import Detector, DetectorParams
    from mixdetect.operators.evaluate import fold_assignment
    from mixdetect.operators.gmm import estep
    from mixdetect.operators.order_stats import auc_frame
    from mixdetect.plans.em import train_em
    from mixdetect.sources import (MIXED_EVENTS_SPEC, MIXED_LINES_SPEC, MIXED_ORDERS_SPEC, WIDE_EMBEDDINGS_SPEC,
                                   mixed_events, mixed_lines, mixed_orders, wide_embeddings)
    from mixdetect.spec import given_gmm

    # The original main's settings (k=2, lambda 0.1, reg 0.001, lr 1 / speed 0.2,
    # radius 10, ratio 0.2, 49 SGD steps of ~100 rows); 4 mixture components.
    params = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, regularization_parameter=0.001,
                            learning_rate_start=1.0, learning_rate_speed=0.2, normalizing_radius=10.0,
                            anomaly_ratio=0.2, gaussian_num=4, max_iterations=50, minibatch_size=100,
                            em_max_iter=100, seed=42)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # warm-up: JVM start, parquet footer cache, codegen of the scan
    mixed_orders(spark, sf_dir).agg(F.count(F.lit(1))).first()

    lines = mixed_lines(spark, sf_dir)
    model = timed("fit_lines", lambda: Detector(MIXED_LINES_SPEC, params).fit(lines))
    timed("score_flag_lines", lambda: run(model.transform(lines)))

    orders = mixed_orders(spark, sf_dir)
    omodel = timed("fit_orders", lambda: Detector(MIXED_ORDERS_SPEC, params.replace(gaussian_num=3,
                                                                                  anomaly_ratio=0.05)).fit(orders))
    timed("auc_orders", lambda: auc_frame(omodel.score(orders), -F.col("score"), "label").first())
    timed("kfold_orders", lambda: run(fold_assignment(orders.select("row_id", "label"), 5)))

    events = mixed_events(spark, sf_dir)
    timed("em10_events", lambda: train_em(events, MIXED_EVENTS_SPEC, given_gmm(3, 3), max_iter=10, tol=-1.0))

    emb = wide_embeddings(spark, sf_dir)
    timed("estep_wide_embeddings", lambda: estep(emb, given_gmm(3, 64), WIDE_EMBEDDINGS_SPEC, "arrow"))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
