"""SGD in a barrier stage in a local[2,4] session: once clean, once with a task of the stage's first attempt failing in
the second step.  Prints the steps taken and the max parameter difference as one JSON line."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

from mixdetect.operators.encode import profile, slot_layout  # noqa: E402
from mixdetect.plans import sgd  # noqa: E402
from mixdetect.sources import MIXED_ORDERS_SPEC, mixed_orders  # noqa: E402
from mixdetect.spec import given_logistic  # noqa: E402

df = mixed_orders(spark, sys.argv[1])
prof = profile(df, MIXED_ORDERS_SPEC)
layout = slot_layout(prof, MIXED_ORDERS_SPEC)


def train(loop):
    return sgd.train_sgd(df, MIXED_ORDERS_SPEC, layout, prof.n, given_logistic(2, 2, layout.n_slots, 0.1), max_iterations=5, minibatch_size=100,
                         reg=0.001, lr0=1.0, lr_speed=0.2, radius=1.0, seed=4, hash_kind="xxhash", loop=loop, tasks=2)


clean, steps = train("task"), sgd.partial_gradient
marker = os.path.join(tempfile.mkdtemp(), "failed")  # one machine: the second attempt sees it
calls = []


def failing(*args):
    calls.append(1)
    if TaskContext.get().partitionId() == 1 and len(calls) == 2 and not os.path.exists(marker):
        open(marker, "w").close()
        raise RuntimeError("injected task failure")
    return steps(*args)


sgd.partial_gradient = failing
flaky = train("barrier")
print(json.dumps({"failed": os.path.exists(marker), "steps": len(flaky.history), "rows": [h[1] for h in flaky.history] == [h[1] for h in clean.history],
                  "max_diff": float(np.abs(clean.params.W - flaky.params.W).max())}))
spark.stop()
