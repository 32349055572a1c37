
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from mixdetect.operators.encode import one_hot_long, profile, slot_layout
from mixdetect.operators.evaluate import auc_evaluator, fold_assignment, kfold_long
from mixdetect.operators.gmm import estep, with_responsibilities
from mixdetect.operators.logistic import regularised_update, with_cat_loglik
from mixdetect.operators.order_stats import auc_frame, global_positions, kth_largest, kth_smallest
from mixdetect.plans.detector import DetectorModel
from mixdetect.plans.em import train_em
from mixdetect.sources import MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, mixed_events, mixed_orders
from mixdetect.spec import DetectorParams, given_gmm, given_logistic, random_logistic


def test_responsibilities_sum_to_one(spark):
    df = mixed_events(spark, SF_SMALL)
    t = with_responsibilities(df, given_gmm(3, 3), MIXED_EVENTS_SPEC)
    worst = t.agg(F.max(F.abs(F.col("r0") + F.col("r1") + F.col("r2") - 1.0))).first()[0]
    assert worst < 1e-12


def test_em_loglik_non_decreasing_without_floor(spark):
    df = mixed_events(spark, SF_SMALL)
    res = train_em(df, MIXED_EVENTS_SPEC, given_gmm(3, 3), max_iter=8, tol=-1.0, min_covar=0.0)
    lls = [ll for _, ll, _ in res.history]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(lls, lls[1:])), lls


def test_generated_and_arrow_estep_agree(spark):
    df = mixed_events(spark, SF_SMALL)
    a = estep(df, given_gmm(3, 3), MIXED_EVENTS_SPEC, "generated")
    b = estep(df, given_gmm(3, 3), MIXED_EVENTS_SPEC, "arrow")
    assert a.rows == b.rows
    np.testing.assert_allclose([a.ll], [b.ll], rtol=1e-9)
    np.testing.assert_allclose(a.n, b.n, rtol=1e-9)
    np.testing.assert_allclose(a.s1, b.s1, rtol=1e-9)
    np.testing.assert_allclose(a.s2, b.s2, rtol=1e-9)


def test_one_hot_has_one_hot_slot_per_column(spark):
    df = mixed_orders(spark, SF_SMALL)
    layout = slot_layout(profile(df, MIXED_ORDERS_SPEC), MIXED_ORDERS_SPEC)
    long = one_hot_long(df, layout)
    per_row = long.groupBy("row_id").agg(F.sum("hot").alias("h"), F.count(F.lit(1)).alias("n"))
    assert per_row.where((F.col("h") != 3) | (F.col("n") != layout.n_slots)).count() == 0


def test_projection_never_exceeds_radius():
    p = given_logistic(3, 4, 20, 0.1)
    rng = np.random.default_rng(0)
    q = regularised_update(p, rng.normal(size=p.W.shape) * 5, rng.normal(size=p.V.shape) * 5, 1.0, 0.001, 0.35)
    assert np.sqrt((q.W ** 2).sum(axis=0)).max() <= 0.35 + 1e-12
    assert np.sqrt((q.V ** 2).sum(axis=0)).max() <= 0.35 + 1e-12


def test_predict_proba_columns_sum_to_one(spark):
    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    m = DetectorModel(spec, layout, given_logistic(2, 2, layout.n_slots, 0.1), given_gmm(3, 2), DetectorParams())
    m.fit_range(df)
    t = m.predict_proba(df)
    assert t.agg(F.max(F.abs(F.col("p0") + F.col("p1") - 1.0))).first()[0] < 1e-12
    assert t.agg(F.min("p0"), F.max("p0")).first() == (0.0, 1.0)


@pytest.mark.parametrize("shuffle", [False, True])
def test_folds_partition_the_rows(spark, shuffle):
    df = mixed_orders(spark, SF_SMALL).select("row_id", "label")
    a = fold_assignment(df, 7, shuffle=shuffle, seed=3, n_buckets=5)  # several buckets on purpose
    sizes = sorted(r["count"] for r in a.groupBy("fold").count().collect())
    n = df.count()
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    long = kfold_long(a, 7)
    tests = long.where(F.col("split") == "test").groupBy("row_id").count()
    assert tests.count() == n and tests.where(F.col("count") != 1).count() == 0
    assert long.where(F.col("split") == "train").count() == 6 * n


def test_contiguous_folds_follow_row_order(spark):
    df = mixed_orders(spark, SF_SMALL).select("row_id", "label")
    a = fold_assignment(df, 4, n_buckets=3).orderBy("row_id").collect()
    folds = [r["fold"] for r in a]
    assert folds == sorted(folds)


def test_global_positions_match_row_number(spark):
    df = mixed_orders(spark, SF_SMALL).select("row_id")
    pos = global_positions(df, ["row_id"], n_buckets=6).orderBy("row_id").collect()
    assert [r["pos"] for r in pos] == list(range(len(pos)))


def test_score_independent_of_partitioning(spark):
    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    m = DetectorModel(spec, layout, random_logistic(2, 2, layout.n_slots, 0.1, 1), given_gmm(3, 2), DetectorParams())
    a = {r["row_id"]: r["score"] for r in m.score(df.repartition(1)).select("row_id", "score").collect()}
    b = {r["row_id"]: r["score"] for r in m.score(df.repartition(7)).select("row_id", "score").collect()}
    assert a == b


def test_kth_smallest_exact_with_narrowing_and_skew(spark):
    # one value holds a third of all rows; force several narrowing rounds
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.normal(size=300) * 50])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    srt = np.sort(vals)
    for k in (1, 17, 1500, 2600, 3000, 4100, len(vals)):
        got = kth_smallest(df, "v", k, cells=16)
        assert got == srt[k - 1], k
        assert kth_largest(df, "v", k, cells=16) == srt[len(vals) - k]


def test_auc_frame_matches_evaluator(spark):
    df = mixed_orders(spark, SF_MID)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    m = DetectorModel(spec, layout, given_logistic(2, 2, layout.n_slots, 0.1), given_gmm(3, 2), DetectorParams())
    s = m.score(df).withColumn("neg", -F.col("score"))
    a = auc_frame(s, "neg", "label", n_buckets=9).first()["auc"]
    assert a == pytest.approx(auc_evaluator(s, "neg"), abs=1e-9)


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.5, 0)], "s double, label int")
    # pairs (pos, neg): (1,1)->0.5, (1,0.5)->1, (2,1)->1, (2,0.5)->1  => 3.5/4
    assert auc_frame(df, "s").first()["auc"] == pytest.approx(0.875)


def test_scoring_plan_is_one_stage_without_python(spark):
    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    m = DetectorModel(spec, layout, given_logistic(2, 2, layout.n_slots, 0.1), given_gmm(3, 2), DetectorParams(),
                      threshold=-5.0)
    plan = m.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double" in \
        m.transform(df)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_cat_loglik_stable_for_huge_margins(spark):
    df = spark.createDataFrame([(1, 0, 1000.0), (2, 0, -1000.0)], "row_id long, c0 int, x0 double")
    from mixdetect.spec import LogisticParams, MixedSpec, SlotLayout

    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0",), label=None)
    layout = SlotLayout(("c0",), (2,))
    p = LogisticParams(np.array([[1.0, 0.0]]), np.array([[1.0, -1.0]]), 1.0)
    out = {r["row_id"]: r["log_p_cat"] for r in with_cat_loglik(df, p, spec, layout).collect()}
    assert out[1] == pytest.approx(0.0, abs=1e-12)  # slot 0 hot with margin +1000, slot 1 cold with -1000
    assert out[2] == pytest.approx(-2000.0)  # both slots wrong by a margin of 1000


def test_global_positions_split_a_hot_key(spark):
    """One key holds a third of all rows: positions stay exact and the copies
    are spread over several range partitions instead of one task."""
    base = mixed_orders(spark, SF_SMALL).select("row_id")
    n = base.count()
    hot = spark.range(n // 2).select(F.lit(7).cast("long").alias("row_id"))  # 1/3 of the union
    df = base.unionByName(hot)
    total = df.count()
    pos = global_positions(df, ["row_id"], n_buckets=6)
    got = pos.select("row_id", "pos").collect()
    assert sorted(r["pos"] for r in got) == list(range(total))
    ordered = [r["row_id"] for r in sorted(got, key=lambda r: r["pos"])]
    assert ordered == sorted(ordered)
    per_part = pos.where(F.col("row_id") == 7).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_part) >= 2 and max(r["count"] for r in per_part) < total / 2


def test_minibatch_sampler_follows_independent_bernoulli_law(spark):
    from math import comb

    from mixdetect.operators.logistic import minibatches

    df = mixed_orders(spark, SF_MID)
    n, steps = df.count(), 49
    f = 100 / n
    mb = minibatches(df, MIXED_ORDERS_SPEC, 12, list(range(1, steps + 1)), f, 7, "xxhash")
    total = mb.count()
    assert abs(total - n * f * steps) < 4 * (n * f * steps) ** 0.5
    mult = {r[0]: r[1] for r in mb.groupBy("row_id").count().groupBy("count").count().collect()}
    for m in (1, 2):
        expected = n * comb(steps, m) * f ** m * (1 - f) ** (steps - m)
        assert abs(mult.get(m, 0) - expected) < 5 * expected ** 0.5 + 2, (m, mult, expected)


def test_minibatch_tiny_fraction_still_draws(spark):
    """At 1e11 rows a 100-row minibatch is f = 1e-9: the production sampler has no floor on f."""
    from mixdetect.operators.logistic import minibatches
    from mixdetect.spec import MixedSpec

    big = spark.range(2_000_000).select(F.col("id").alias("row_id"), F.lit(0).alias("c0"), F.lit(0.5).alias("x0"))
    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0",), label=None)
    k = minibatches(big, spec, 1, list(range(1, 50)), 1e-6, 42, "xxhash").count()
    assert 50 <= k <= 160  # expected 98
    k = minibatches(big, spec, 1, list(range(1, 50)), 1e-6, 42, "modular").count()
    assert 50 <= k <= 160


def test_arrow_scoring_equals_expression_scoring(spark, monkeypatch):
    """Very wide models score on Arrow batches; both paths give the same values."""
    import mixdetect.operators.gmm as G
    import mixdetect.operators.logistic as L

    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    m = DetectorModel(spec, layout, random_logistic(3, 2, layout.n_slots, 0.1, 5), given_gmm(3, 2), DetectorParams())
    bad = df.withColumn("c1", F.when(F.col("row_id") % 97 == 0, 9).otherwise(F.col("c1")))  # unseen codes too
    want = {r["row_id"]: (r["log_p_cont"], r["log_p_cat"]) for r in m.score(bad).collect()}
    monkeypatch.setattr(L, "WIDE_EXPR_LIMIT", 0)
    monkeypatch.setattr(G, "WIDE_EXPR_LIMIT", 0)
    t = m.score(bad)
    assert "ArrowEvalPython" in t._jdf.queryExecution().executedPlan().toString()
    got = {r["row_id"]: (r["log_p_cont"], r["log_p_cat"]) for r in t.collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k][0] == pytest.approx(a, rel=1e-9, abs=1e-9)
        assert got[k][1] == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_sql_double_literals_round_trip(spark):
    """Generated expressions carry parameters as SQL text: every double must parse back exactly."""
    from mixdetect.functions import sql as S

    vals = [0.0, 1e-300, -1e-300, 1.5e-05, -2.5e20, 123456789.123, -0.4, 1 / 3, float("inf"), float("-inf"),
            5e-324, 1.7976931348623157e308]
    row = spark.range(1).selectExpr(*[f"{S.num(v)} AS v{i}" for i, v in enumerate(vals)],
                                    f"typeof({S.num(0.5)}) AS t").first()
    assert [row[f"v{i}"] for i in range(len(vals))] == vals
    assert row["t"] == "double"


def test_sgd_step_over_cached_single_partition_has_no_exchange(spark):
    from mixdetect.operators.logistic import gradient_global_frame, minibatches

    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    mb = minibatches(df, spec, layout.n_slots, list(range(1, 10)), 0.1, 1, "xxhash").repartition(1).persist()
    try:
        mb.count()  # materialised, the cached relation reports its single partition
        plan = gradient_global_frame(mb.where(F.col("step") == 2), random_logistic(2, 2, layout.n_slots, 0.1, 1),
                                     spec, layout)._jdf.queryExecution().executedPlan().toString()
        top = plan.split("InMemoryRelation")[0]  # the cached plan's own shuffle is listed below it
        assert "Exchange" not in top and "HashAggregate" in top
    finally:
        mb.unpersist()


def test_grouped_and_global_gradient_agree(spark, monkeypatch):
    """k*J above the limit sums the gradient by groupBy(slot); both paths give the same numbers."""
    import mixdetect.operators.logistic as L

    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    mb = L.minibatches(df, spec, layout.n_slots, [1, 2, 3], 0.2, 5, "xxhash").where(F.col("step") == 2)
    p = random_logistic(3, 2, layout.n_slots, 0.1, 9)
    gW1, gV1, n1 = L.gradient(mb, p, spec, layout)
    monkeypatch.setattr(L, "GLOBAL_GRADIENT_LIMIT", 0)
    gW2, gV2, n2 = L.gradient(mb, p, spec, layout)
    assert n1 == n2 > 0
    np.testing.assert_allclose(gW1, gW2, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(gV1, gV2, rtol=1e-12, atol=1e-12)
