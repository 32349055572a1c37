"""Draws by the portable hash: in Arrow batches, one pass for all models, folds in several tasks."""

import math

import pytest
from pyspark.sql import functions as F

from mixdetect.functions.columns import (HASH_PRIMES, HASH_RANGE, STREAM_KMEANS, STREAM_SELECT, STREAM_SLOT, modular_hash, modular_uniform,
                                         selection_cutoff)
from mixdetect.operators.logistic import hot_slot_sql, minibatch_fraction, minibatches
from mixdetect.operators.packed import ALL, kmeans_draws
from mixdetect.plans import crossval
from mixdetect.plans.sgd import SgdModel, drawn_rows
from mixdetect.spec import DetectorParams, LogisticParams, MixedSpec, SlotLayout

SPEC = MixedSpec(cat_cols=("c0",), cont_cols=("x0",))
IDS = [*range(300), -1, -7, 2**31, 2**31 + 11, 2**40 + 3, 2**62, -2**63, 2**63 - 1, None, 5, 5]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, k % 3, k / 10.0, None if k % 50 == 49 else k % 4, k % 2) for k, i in enumerate(IDS)]
    return spark.createDataFrame(data, "row_id long, c0 int, x0 double, part int, label int")


def test_uniforms_in_batches_equal_the_column_hash(rows):
    want = (modular_hash(F.col("row_id"), 3, 42, STREAM_KMEANS).cast("double") + F.lit(0.5)) / F.lit(float(HASH_RANGE))
    got = rows.select(want.alias("want"), modular_uniform(F.col("row_id"), 3, 42, STREAM_KMEANS).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("fraction", [0.02, 0.4, 1.0])
def test_minibatches_equal_the_column_filter(rows, fraction):
    got = minibatches(rows, SPEC, 7, [1, 2, 5], fraction, 42, "modular")
    stepped = rows.select("row_id", "c0", "x0", F.explode(F.array(*map(F.lit, [1, 2, 5]))).alias("step"))
    cutoff = selection_cutoff(fraction)
    if cutoff < HASH_RANGE:
        stepped = stepped.where(modular_hash(F.col("row_id"), F.col("step"), 42, STREAM_SELECT) < cutoff)
    want = stepped.withColumn("slot", (modular_hash(F.col("row_id"), F.col("step"), 42, STREAM_SLOT) % 7).cast("int"))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _models(sizes, left_out):
    layouts = [SlotLayout(("c0",), (2 + k % 2,)) for k in range(len(sizes))]
    return [SgdModel(a, n, LogisticParams(None, None, 1.0), f) for a, n, f in zip(layouts, sizes, left_out, strict=True)]


def test_models_draw_together_what_each_draws_alone(rows):
    models = _models([240, 60, 10], [0, 1, 2])
    got = drawn_rows(rows, SPEC, models, "part", 6, 20, 42, "modular")
    want = None
    for k, m in enumerate(models):
        own = (minibatches(rows.where(F.col("part") != m.left_out), SPEC, m.layout.n_slots, list(range(1, 6)), minibatch_fraction(m.n, 20), 42, "modular")
               .withColumn("hot", F.coalesce(F.expr(hot_slot_sql(m.layout)), F.lit(False))).withColumn("model", F.lit(k)))
        want = own if want is None else want.unionByName(own)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_pass_draws_for_all_models(rows):
    plan = drawn_rows(rows, SPEC, _models([240] * 5, range(5)), "part", 50, 20, 42, "modular")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("Generate ") == 1


def test_folds_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(crossval, "ROWS_PER_FOLD_TASK", 50)
    seen, fit_folds = [], crossval.Detector.fit_folds

    def fit(self, df, *args):
        seen.append(df.rdd.getNumPartitions())
        return fit_folds(self, df, *args)

    monkeypatch.setattr(crossval.Detector, "fit_folds", fit)
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("c0"),
                                 (F.col("id") / 300).alias("x0"))
    params = DetectorParams(subspace_dimension=2, gaussian_num=2, max_iterations=3, em_max_iter=2, hash_kind="modular")
    got = crossval.cross_validate(df, SPEC, params, 3).collect()
    assert sum(r["n_pos"] + r["n_neg"] for r in got) == 300 and all(math.isfinite(r["auc"]) for r in got)
    assert seen[0] > 1


def test_hashes_of_a_fit_stand_in_no_filter_or_packing_expression(rows):
    """As expressions they repeat their argument in every product, too long to be compiled."""
    drawn = drawn_rows(rows, SPEC, _models([240], [ALL]), None, 50, 20, 42, "modular")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and str(HASH_PRIMES[0]) in line]
    packed = rows.select("*", *kmeans_draws(SPEC, 42, "modular"))._jdf.queryExecution().executedPlan().toString()
    assert str(HASH_PRIMES[0]) not in packed and packed.count("ArrowEvalPython") == 1
