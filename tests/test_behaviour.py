
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mixdetect import Detector, DetectorParams
from mixdetect.operators.encode import profile, slot_layout, validate
from mixdetect.operators.scoring import combined_score, threshold
from mixdetect.plans.detector import DetectorModel
from mixdetect.plans.em import train_em
from mixdetect.plans.sgd import train_sgd
from mixdetect.sources import MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, mixed_events, mixed_orders
from mixdetect.spec import MixedSpec, given_gmm, given_logistic

QUICK = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, regularization_parameter=0.001,
                       learning_rate_speed=0.2, gaussian_num=3, max_iterations=6, em_max_iter=5,
                       anomaly_ratio=0.05, kmeans_max_iter=5)


def _model(spark, **kw):
    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    p = DetectorParams().replace(**kw)
    return df, DetectorModel(spec, layout, given_logistic(2, 2, layout.n_slots, 0.1), given_gmm(3, 2), p)


def test_t1_joint_and_product_scores(spark):
    df, m = _model(spark)
    j = m.score(df).select("log_p_cont", "log_p_cat", "score").collect()
    assert all(r["score"] == pytest.approx(r["log_p_cont"] + r["log_p_cat"]) for r in j)
    df, m = _model(spark, mode="product")
    p = m.score(df).select("log_p_cont", "log_p_cat", "score").collect()
    assert all(r["score"] == pytest.approx(r["log_p_cont"] * r["log_p_cat"]) for r in p)
    with pytest.raises(ValueError):
        combined_score(F.lit(1.0), F.lit(1.0), "nope")


def test_t2_t3_threshold_orders(spark):
    df = spark.createDataFrame([(0, 9.0), (1, 1.0), (1, 5.0), (0, 7.0)], "label int, score double")
    # original: top(3) of (label, score) tuples is (1,5),(1,1),(0,9) -> threshold 9
    assert threshold(df, 4, 0.75, order="label_score", tail="high") == 9.0
    assert threshold(df, 4, 0.75, order="score", tail="high") == 5.0  # 3rd largest
    assert threshold(df, 4, 0.75, order="score", tail="low") == 7.0  # 3rd smallest
    assert threshold(df, 4, 0.01) == 1.0  # k = max(1, int(n * ratio))


def test_t3_low_tail_flags_exactly_k_distinct_scores(spark):
    df, m = _model(spark)
    s = m.score(df)
    n = s.count()
    m.threshold = threshold(s, n, 0.05)
    assert m.transform(df).where("is_anomaly").count() == int(n * 0.05)


def test_t4_flag_is_a_boolean_column(spark):
    df, m = _model(spark)
    m.threshold = -10.0
    t = m.predict(df)
    assert dict(t.dtypes)["is_anomaly"] == "boolean" and dict(t.dtypes)["prediction"] == "int"
    assert t.where((F.col("score") <= -10.0) != F.col("is_anomaly")).count() == 0


def test_t5_gaussian_num_is_honoured(spark):
    m = Detector(MIXED_ORDERS_SPEC, QUICK.replace(gaussian_num=2)).fit(mixed_orders(spark, SF_SMALL))
    assert m.gmm.K == 2


def test_t7_constant_start_stays_rank_one(spark):
    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    prof = profile(df, spec)
    layout = slot_layout(prof, spec)
    from mixdetect.spec import constant_logistic

    r = train_sgd(df, spec, layout, prof.n, constant_logistic(3, 2, layout.n_slots, 0.1), max_iterations=6,
                  minibatch_size=100, reg=0.001, lr0=1.0, lr_speed=0.2, radius=10.0, seed=1, hash_kind="xxhash")
    assert np.allclose(r.params.W[0], r.params.W[1]) and np.allclose(r.params.V[0], r.params.V[2])


def test_t10_unseen_category(spark):
    df, m = _model(spark)
    bad = df.withColumn("c1", F.when(F.col("row_id") == df.first()["row_id"], 17).otherwise(F.col("c1")))
    assert m.score(bad).count() == df.count()  # all_zero: no slot of c1 lights up
    _, m_err = _model(spark, on_unseen="error")
    with pytest.raises(Exception, match="unseen"):
        m_err.score(bad).collect()


@pytest.mark.parametrize("value", [-1, 1.5])
def test_t10_negative_or_fractional_codes_rejected(spark, value):
    df = mixed_orders(spark, SF_SMALL).withColumn("c0", F.when(F.col("row_id") == 1, F.lit(value))
                                                  .otherwise(F.col("c0")).cast("double"))
    with pytest.raises(ValueError, match="negative or fractional"):
        validate(profile(df, MIXED_ORDERS_SPEC), MIXED_ORDERS_SPEC)


def test_null_feature_rejected(spark):
    df = mixed_orders(spark, SF_SMALL).withColumn("x0", F.when(F.col("row_id") == 1, F.lit(None))
                                                  .otherwise(F.col("x0")))
    with pytest.raises(ValueError, match="null"):
        Detector(MIXED_ORDERS_SPEC, QUICK).fit(df)


def test_t11_all_continuous_and_all_categorical(spark):
    df = mixed_orders(spark, SF_SMALL)
    cont = MixedSpec(cont_cols=("x0", "x1"))
    m = Detector(cont, QUICK).fit(df)
    s = m.score(df).agg(F.max(F.abs(F.col("log_p_cat")))).first()[0]
    assert s == 0.0 and m.threshold is not None
    cat = MixedSpec(cat_cols=("c0", "c1", "c2"))
    m = Detector(cat, QUICK).fit(df)
    assert m.gmm is None
    assert m.score(df).agg(F.max(F.abs("log_p_cont"))).first()[0] == 0.0


def test_t12_empty_and_too_few_rows(spark):
    df = mixed_orders(spark, SF_SMALL)
    with pytest.raises(ValueError, match="0 rows"):
        Detector(MIXED_ORDERS_SPEC, QUICK).fit(df.limit(0))
    with pytest.raises(ValueError, match="too few for 3 components"):
        Detector(MIXED_ORDERS_SPEC, QUICK).fit(df.limit(2))


def test_constant_column_gets_variance_floor(spark):
    df = mixed_events(spark, SF_SMALL).withColumn("x2", F.lit(0.5))
    res = train_em(df, MIXED_EVENTS_SPEC, given_gmm(3, 3), max_iter=3, tol=-1.0)
    assert np.all(res.params.covars[:, 2] >= 1e-3 - 1e-12)
    assert np.all(np.isfinite(res.params.covars))


def test_t14_tolerance_on_mean_or_total(spark):
    df = mixed_events(spark, SF_SMALL)
    mean = train_em(df, MIXED_EVENTS_SPEC, given_gmm(3, 3), max_iter=50, tol=1e-3, tol_on="mean")
    total = train_em(df, MIXED_EVENTS_SPEC, given_gmm(3, 3), max_iter=50, tol=1e-3, tol_on="total")
    assert mean.converged and len(mean.history) <= len(total.history)


def test_t15_t17_history_and_step_count(spark):
    m = Detector(MIXED_ORDERS_SPEC, QUICK).fit(mixed_orders(spark, SF_SMALL))
    assert [h[0] for h in m.history.sgd] == [1, 2, 3, 4, 5]  # max_iterations - 1 steps
    assert all(h[1] > 0 for h in m.history.sgd)


def test_t18_fit_is_deterministic(spark):
    df = mixed_orders(spark, SF_SMALL)
    a = Detector(MIXED_ORDERS_SPEC, QUICK).fit(df)
    b = Detector(MIXED_ORDERS_SPEC, QUICK).fit(df.repartition(5))
    np.testing.assert_allclose(a.logistic.W, b.logistic.W, rtol=1e-9, atol=1e-12)
    assert a.threshold == pytest.approx(b.threshold, rel=1e-9)


def test_a12_parameters(spark):
    p = DetectorParams()
    assert p.subspace_dimension == 10 and p.gaussian_num == 4 and p.max_iterations == 50
    q = p.replace(logistic_lambda=0.1)
    assert q.as_dict()["logistic_lambda"] == 0.1 and p.logistic_lambda == 1.0
    assert "anomaly_ratio" in DetectorParams.param_names()
    with pytest.raises(ValueError):
        p.replace(not_a_param=1)


def test_fit_on_wide_array_input(spark):
    """All-continuous 64-dim array input: hashed k-means start, Arrow E-step, GMM-only score."""
    from mixdetect.sources import WIDE_EMBEDDINGS_SPEC, wide_embeddings

    df = wide_embeddings(spark, SF_SMALL)
    m = Detector(WIDE_EMBEDDINGS_SPEC, QUICK.replace(gaussian_num=3, anomaly_ratio=0.1)).fit(df)
    assert m.gmm.means.shape == (3, 64) and len(m.history.em) >= 1
    s = m.transform(df)
    assert s.where("is_anomaly").count() == int(df.count() * 0.1)
    assert s.agg(F.max(F.abs("log_p_cat"))).first()[0] == 0.0


def test_t18_deterministic_with_duplicate_row_ids(spark):
    """mixed_lines repeats row_id; the fit must still not depend on partitioning."""
    from mixdetect.sources import MIXED_LINES_SPEC, mixed_lines

    df = mixed_lines(spark, SF_SMALL)
    p = QUICK.replace(gaussian_num=4, anomaly_ratio=0.2)
    a = Detector(MIXED_LINES_SPEC, p).fit(df.repartition(1))
    b = Detector(MIXED_LINES_SPEC, p).fit(df.repartition(6))
    np.testing.assert_allclose(a.gmm.means, b.gmm.means, rtol=1e-9, atol=1e-12)
    assert a.threshold == pytest.approx(b.threshold, rel=1e-9)


def test_approximate_threshold_is_within_sketch_rank_error(spark):
    df, m = _model(spark)
    s = m.score(df).persist()
    n = s.count()
    exact = threshold(s, n, 0.05)
    approx = threshold(s, n, 0.05, exact=False, accuracy=1000)
    k = int(n * 0.05)
    rank = s.where(F.col("score") <= approx).count()
    assert abs(rank - k) <= n / 1000 + 1
    assert s.where(F.col("score") <= exact).count() >= k
    s.unpersist()


def test_no_step_is_empty(spark):
    """minibatch_size=1 draws no row for ~37% of the steps; each of them takes the row with the least hash."""
    from mixdetect.plans.sgd import draw_minibatches

    df = mixed_orders(spark, SF_SMALL)
    spec = MIXED_ORDERS_SPEC
    prof = profile(df, spec)
    layout = slot_layout(prof, spec)
    mb, _ = draw_minibatches(df, spec, layout, prof.n, 41, 1, 3, "xxhash")
    counts = {r["step"]: r["count"] for r in mb.groupBy("step").count().collect()}
    assert sorted(counts) == list(range(1, 41))
    assert sum(counts.values()) < 40 * 4  # still ~1 row per step, not whole copies of other steps


def test_detector_parameter_methods():
    d = Detector(MIXED_ORDERS_SPEC)
    assert d.set_params(gaussian_num=2, anomaly_ratio=0.2) is d
    assert d.get_params()["gaussian_num"] == 2 and d.params.anomaly_ratio == 0.2
    assert "logistic_lambda" in d.get_param_names()
    with pytest.raises(ValueError):
        d.set_params(no_such_parameter=1)


def test_memberships_and_infer_spec(spark):
    from mixdetect import infer_spec

    df, m = _model(spark)
    assert infer_spec(df) == MixedSpec(cat_cols=("c0", "c1", "c2"), cont_cols=("x0", "x1"))
    t = m.memberships(df)
    row = t.agg(F.max(F.abs(F.col("r0") + F.col("r1") + F.col("r2") - 1.0)).alias("err"),
                F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).first()
    assert row["err"] < 1e-12 and 0 <= row["lo"] <= row["hi"] <= 2


def test_t6_em_returns_post_mstep_parameters(spark):
    from mixdetect.operators.gmm import estep, mstep

    df = mixed_events(spark, SF_SMALL)
    start = given_gmm(3, 3)
    res = train_em(df, MIXED_EVENTS_SPEC, start, max_iter=1, tol=-1.0)
    want = mstep(estep(df, start, MIXED_EVENTS_SPEC), start, 1e-3)
    np.testing.assert_allclose(res.params.means, want.means, rtol=1e-12)
    np.testing.assert_allclose(res.params.covars, want.covars, rtol=1e-12)


def test_t8_gradient_keeps_the_original_scaling(spark):
    """One row, one slot: gradW[:, j] = -s z h and gradV = -s z W[:, j] (x) [x, 1], s = sigmoid(-z w / lambda),
    with no extra 1/lambda factor."""
    from mixdetect.operators.logistic import gradient
    from mixdetect.spec import LogisticParams, SlotLayout

    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0", "x1"), label=None)
    layout = SlotLayout(("c0",), (3,))
    row = spark.createDataFrame([(1, 2, 0.3, -0.7, 1)], "row_id long, c0 int, x0 double, x1 double, slot int")
    p = LogisticParams(np.array([[0.2, -0.1, 0.3], [0.5, 0.4, -0.2]]),
                       np.array([[0.1, -0.3, 0.6], [0.2, 0.7, -0.4]]), 0.25)
    gW, gV, n = gradient(row, p, spec, layout)
    x1 = np.array([0.3, -0.7, 1.0])
    h = p.V @ x1
    j, z = 1, -1.0  # slot 1 is not the row's hot slot (code 2)
    w = h @ p.W[:, j]
    s = 1.0 / (1.0 + np.exp(z * w / p.lam))
    assert n == 1
    np.testing.assert_allclose(gW[:, j], -s * z * h, rtol=1e-12)
    np.testing.assert_allclose(np.delete(gW, j, axis=1), 0.0)
    np.testing.assert_allclose(gV, -s * z * np.outer(p.W[:, j], x1), rtol=1e-12)
