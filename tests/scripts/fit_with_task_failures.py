"""Fit twice in a local[2,4] session: once clean, once with every partition's
first attempt of the input stage failing.  Prints both thresholds and the max
parameter difference as one JSON line."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

from mixdetect import Detector, DetectorParams  # noqa: E402
from mixdetect.sources import MIXED_ORDERS_SPEC, mixed_orders  # noqa: E402


@F.pandas_udf("double")
def fail_first_attempt(x: pd.Series) -> pd.Series:
    tc = TaskContext.get()
    if tc is not None and tc.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return x


params = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, gaussian_num=3, max_iterations=6,
                        em_max_iter=5, kmeans_max_iter=3, anomaly_ratio=0.05)
df = mixed_orders(spark, sys.argv[1]).repartition(3)
clean = Detector(MIXED_ORDERS_SPEC, params).fit(df)
flaky = Detector(MIXED_ORDERS_SPEC, params).fit(df.withColumn("x0", fail_first_attempt("x0")))
print(json.dumps({
    "clean": clean.threshold, "flaky": flaky.threshold,
    "max_diff": float(max(np.abs(clean.logistic.W - flaky.logistic.W).max(),
                          np.abs(clean.gmm.means - flaky.gmm.means).max())),
}))
spark.stop()
