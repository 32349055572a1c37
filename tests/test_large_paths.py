"""Both sides of every switch give the same answers, and nothing is capped, skipped or lost."""

import math
import os
import shutil
import time

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from mixdetect import ConditionalLogistic, Detector, DetectorParams, Mixture
from mixdetect.functions.columns import HASH_PRIMES, HASH_RANGE, modular_hash, stream_salt, xx_hash
from mixdetect.operators.encode import profile, slot_layout, validate
from mixdetect.operators.gmm import hashed_kmeans_means, sparse_variance, with_cont_loglik
from mixdetect.operators.logistic import gradient, minibatches, with_cat_loglik
from mixdetect.operators.order_stats import auc_frame, kth_largest, kth_smallest
from mixdetect.operators.scoring import flag_expr, threshold
from mixdetect.plans.detector import DetectorModel
from mixdetect.plans.em import start_params, train_em
from mixdetect.sources import MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, mixed_events, mixed_orders
from mixdetect.spec import LogisticParams, MixedSpec, SlotLayout, given_gmm, given_logistic, random_logistic

QUICK = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, regularization_parameter=0.001, learning_rate_speed=0.2,
                       gaussian_num=3, max_iterations=6, em_max_iter=5, anomaly_ratio=0.05, kmeans_max_iter=5)
ODD = "row_id long, label int, c0 double, x0 double, x1 double, v array<double>, big long, t string"


def odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 0.0, 0.1, 0.2, [0.1, 0.2], 9007199254740993, "a"), (2, 0, 1.5, 0.1, 0.2, [0.1, 0.2], None, None),
            (3, 1, 7.0, 0.3, 0.4, [0.3, 0.4], 1, "b"), (4, 0, None, 0.5, 0.6, [0.5, 0.6], None, "c"),
            (5, 0, -1.0, None, 0.6, None, 2, "d"), (6, 0, 1.0, nan, 0.6, [nan, 0.6], 3, "e"),
            (7, 0, 2.0, 0.2, None, [0.2, None], 4, None), (8, 1, nan, 0.9, 0.1, [0.9, 0.1], None, "f"),
            (9, 0, 1.0, inf, 0.1, [inf, 0.1], 5, "g"), (10, 0, 0.0, -1e308, 1e308, [-1e308, 1e308], 6, "h")]
    return spark.createDataFrame(rows, ODD)


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return a == b or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("spec", [MixedSpec(cat_cols=("c0",), cont_cols=("x0", "x1")),
                                  MixedSpec(cat_cols=("c0",), cont_array="v", cont_dim=2)])
def test_expression_and_arrow_scoring_agree_on_odd_rows(spark, spec):
    df = odd_rows(spark)
    lp = random_logistic(2, 2, 3, 0.5, 3)
    layout = SlotLayout(("c0",), (3,))
    frames = []
    for limit in (10 ** 6, 0):
        t = with_cat_loglik(with_cont_loglik(df, given_gmm(2, 2), spec, "g", wide_limit=limit), lp, spec, layout, "c", wide_limit=limit)
        assert [(f.name, f.dataType) for f in t.schema][:8] == [(f.name, f.dataType) for f in df.schema]
        frames.append({r.row_id: r for r in t.collect()})
    for k, a in frames[0].items():
        b = frames[1][k]
        assert same(a.g, b.g) and same(a.c, b.c), (k, a, b)
        assert (a.big, a.t, a.v) == (b.big, b.t, b.v) or math.isnan(a.v[0])


def test_wide_profile_and_responsibilities_agree(spark):
    from mixdetect.operators.gmm import with_responsibilities

    df = odd_rows(spark)
    spec = MixedSpec(cat_cols=("c0",), cont_array="v", cont_dim=2)
    narrow, wide = profile(df, spec), profile(df, spec, wide=1)
    assert (narrow.n, narrow.widths, narrow.bad_codes, narrow.cat_nulls) == (wide.n, wide.widths, wide.bad_codes, wide.cat_nulls)
    assert narrow.cont_bad == wide.cont_bad and narrow.cont_inf == wide.cont_inf
    clean = df.where("row_id < 5")
    assert profile(clean, spec).cont_var == pytest.approx(profile(clean, spec, wide=1).cont_var)
    a, b = ({r.row_id: (r.r0, r.r1) for r in with_responsibilities(clean, given_gmm(2, 2), spec, wide_limit=w).collect()} for w in (100, 0))
    assert all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("strategy", ["grouped", "arrow"])
def test_gradient_strategies_agree_on_odd_codes(spark, strategy):
    df = odd_rows(spark).where("x0 is not null and x1 is not null and not isnan(x0) and abs(x0) < 10")
    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0", "x1"))
    layout = SlotLayout(("c0",), (3,))
    mb = df.withColumn("slot", (F.col("row_id") % 3).cast("int"))
    p = random_logistic(2, 2, 3, 0.5, 9)
    for a, b in zip(gradient(mb, p, spec, layout, "global"), gradient(mb, p, spec, layout, strategy)):
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-15)


def test_many_slots_make_no_large_plan(spark):
    J, k = 20_000, 10
    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0",))
    layout = SlotLayout(("c0",), (J,))
    mb = spark.range(100).selectExpr("id AS row_id", "CAST(id * 190 AS INT) AS c0", "id / 100.0D AS x0", "CAST(id * 97 AS INT) AS slot").persist()
    p = random_logistic(k, 1, J, 0.1, 1)
    gradient(mb, p, spec, layout)
    t = time.time()
    gW, _, n = gradient(mb, p, spec, layout)
    assert n == 100 and (np.abs(gW).sum(axis=0) > 0).sum() == 100
    assert time.time() - t < 5
    mb.unpersist()


# -- hashes and minibatches ------------------------------------------------------------------------


def test_portable_hash(spark):
    ids = [0, 1, 2, 2 ** 31, HASH_PRIMES[0], HASH_PRIMES[1], -5, 2 ** 62, 10 ** 18] + list(range(1000, 3000))
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    for h in (modular_hash, xx_hash):
        got = [r[0] for r in df.select(h(F.col("i"), 3, 42, 0)).collect()]
        assert len(set(got)) == len(ids) and all(0 <= g < HASH_RANGE for g in got)
        u = np.array(got[9:], dtype=float) / HASH_RANGE
        assert abs(u.mean() - 0.5) < 0.03 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.08 and (u < 0.1).mean() == pytest.approx(0.1, abs=0.03)
    salts = {(s, t): stream_salt(s, t) for s in range(50) for t in range(5)}
    assert len(set(salts.values())) == len(salts)


@pytest.mark.parametrize("kind", ["modular", "xxhash"])
def test_small_fractions_are_drawn(spark, kind):
    """At fractions below one in a million rows are still drawn (the old integer hash drew none)."""
    big = spark.range(3_000_000).select(F.col("id").alias("row_id"), F.lit(0).alias("c0"), F.lit(0.5).alias("x0"))
    spec = MixedSpec(cat_cols=("c0",), cont_cols=("x0",), label=None)
    k = minibatches(big, spec, 1, list(range(1, 40)), 100 / 6e7, 42, kind).count()
    assert 120 <= k <= 280  # expected 195
    slots = minibatches(big.limit(20000), spec, 3_000_000, [1], 1.0, 42, kind).agg(F.max("slot")).first()[0]
    assert slots > 2_900_000


def test_partitioned_and_single_minibatches_train_alike(spark, monkeypatch):
    from mixdetect.plans import sgd

    df = mixed_orders(spark, SF_SMALL).persist()
    spec = MIXED_ORDERS_SPEC
    p = profile(df, spec)
    layout = slot_layout(p, spec)
    args = dict(max_iterations=6, minibatch_size=40, reg=0.001, lr0=1.0, lr_speed=0.2, radius=1.0, seed=4, hash_kind="xxhash")
    one = sgd.train_sgd(df, spec, layout, p.n, given_logistic(2, 2, layout.n_slots, 0.1), **args)
    monkeypatch.setattr(sgd, "ROWS_PER_MB_PARTITION", 30)
    mb, folder = sgd.draw_minibatches(df, spec, layout, p.n, 6, 40, 4, "xxhash")
    assert folder and "PartitionFilters: [isnotnull(step" in mb.where("step = 3")._jdf.queryExecution().executedPlan().toString()
    two = sgd.train_sgd(df, spec, layout, p.n, given_logistic(2, 2, layout.n_slots, 0.1), **args)
    np.testing.assert_allclose(one.params.W, two.params.W, rtol=1e-10)
    assert [h[1] for h in one.history] == [h[1] for h in two.history]
    monkeypatch.setattr(sgd, "ROWS_PER_MB_PARTITION", 3)
    args["minibatch_size"] = 1  # many steps draw no row of their own
    assert all(h[1] >= 1 for h in sgd.train_sgd(df, spec, layout, p.n, given_logistic(2, 2, layout.n_slots, 0.1), **args).history)
    df.unpersist()


def test_stray_code_is_refused(spark):
    df = mixed_orders(spark, SF_SMALL).withColumn("c0", F.when(F.col("row_id") == 1, 2_000_000_000).otherwise(F.col("c0")))
    with pytest.raises(ValueError, match="slots"):
        Detector(MIXED_ORDERS_SPEC, QUICK).fit(df)


# -- mixture ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["packed", "generated", "arrow"])
def test_variances_survive_a_large_offset(spark, strategy):
    rng = np.random.default_rng(0)
    x = 1.7e9 + rng.normal(size=4000)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "row_id long, x0 double")
    spec = MixedSpec(cont_cols=("x0",), label=None)
    start = start_params(np.array([[x.min()], [x.max()]]), np.array([x.var()]))
    res = train_em(df, spec, start, max_iter=15, tol=-1.0, strategy=strategy, min_covar=1e-6)
    ll = [h[2] for h in res.history]
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:]))
    w, mu, var = res.params.weights, res.params.means[:, 0], res.params.covars[:, 0]
    total = (w * (var + (mu - (w * mu).sum()) ** 2)).sum()
    assert total == pytest.approx(x.var(), rel=1e-3)


def test_sparse_variance_checks_and_centres(spark):
    rows = [(1, 0, 1e9 + 1), (2, 0, 1e9 + 2), (3, 0, 1e9 + 3), (1, 1, 4.0)]
    df = spark.createDataFrame(rows, "row_id long, idx int, value double")
    got = {r.idx: r.variance for r in sparse_variance(df, 3, 0.0).collect()}
    assert got[0] == pytest.approx(2 / 3) and got[1] == pytest.approx(np.var([4, 0, 0])) and got[2] == 0
    with pytest.raises(ValueError, match="outside"):
        sparse_variance(df.union(spark.createDataFrame([(2, 9, 5.0)], df.schema)), 3)


def test_lloyd_steps_by_hand(spark):
    import mixdetect.operators.gmm as G

    df = mixed_events(spark, SF_SMALL)
    C = np.array([[0.1, 0.2, 0.3], [0.5, 0.5, 0.5], [0.9, 0.8, 0.7]])
    X = np.array([tuple(r) for r in df.select("x0", "x1", "x2").collect()])
    want = C.copy()
    for _ in range(5):
        at = ((X[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([X[at == m].mean(axis=0) if (at == m).any() else want[m] for m in range(3)])
    np.testing.assert_allclose(G.lloyd(df, MIXED_EVENTS_SPEC, C, 5, -1.0), want, rtol=1e-9)


def test_kmeans_start_sees_all_rows_and_no_partitions(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3000, 2)), rng.normal(size=(12, 2)) + 500])  # a rare far cluster
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "row_id long, x0 double, x1 double")
    spec = MixedSpec(cont_cols=("x0", "x1"), label=None)
    one = hashed_kmeans_means(df.repartition(1), spec, 2, 7)
    two = hashed_kmeans_means(df.repartition(6), spec, 2, 7)
    np.testing.assert_allclose(one, two, rtol=1e-9)
    assert sorted(one[:, 0])[1] == pytest.approx(500, abs=2)
    same_point = spark.createDataFrame([(k, 1.0, 2.0) for k in range(20)], df.schema)
    assert (hashed_kmeans_means(same_point, spec, 3, 7) == [1.0, 2.0]).all()


# -- threshold, ranking ------------------------------------------------------------------------------


def test_kth_on_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    vals = [nan, None, inf, -inf, -inf, 5e-324, 0.0, -0.0, 1e308, -1e308, 1.7976931348623157e308, 3.0, 3.0, 3.0, -1.5, nan]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ranked = sorted(v for v in vals if v is not None and not math.isnan(v))
    for cells in (2, 5, 4096):
        assert [kth_smallest(df, "v", k, cells=cells) for k in range(1, len(ranked) + 1)] == ranked
        assert kth_largest(df, "v", 1, cells=cells) == inf
    assert kth_smallest(df, "v", len(ranked) + 1) is None and kth_smallest(df, "v", 0) is None


def test_label_order_with_many_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 1500)), float(rng.normal())) for _ in range(3000)] + [(None, 0.5), (None, 0.7)]
    df = spark.createDataFrame(rows, "label int, score double")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    for k in (1, 10, 1500, 3000, 3001, 3002):
        assert threshold(df, len(rows), k / len(rows) + 1e-9, "label_score", "high") == order[k - 1][1]


def test_auc_leaves_out_what_cannot_be_ranked(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(rng.normal(), 1)), int(rng.integers(0, 2))) for _ in range(500)]
    odd = [(None, 1), (float("nan"), 0), (1.0, None), (None, None)]
    df = spark.createDataFrame(rows + odd, "s double, label int")
    clean = spark.createDataFrame(rows, "s double, label int")
    want = auc_frame(clean, "s").first()
    for parts in (1, 7):
        got = auc_frame(df, "s", n_buckets=parts, report=True).first()
        assert (got.n_pos, got.n_neg, got.n_unranked) == (want.n_pos, want.n_neg, 4) and got.auc == pytest.approx(want.auc)
    with pytest.raises(ValueError, match="label"):
        auc_frame(spark.createDataFrame([(1.0, 2)], "s double, label int"), "s")


def test_infinite_features_are_refused_and_nan_is_not_flagged(spark):
    df = mixed_events(spark, SF_SMALL).withColumn("x0", F.when(F.col("row_id") == 5, float("inf")).otherwise(F.col("x0")))
    with pytest.raises(ValueError, match="infinite"):
        validate(profile(df, MIXED_EVENTS_SPEC), MIXED_EVENTS_SPEC)
    s = spark.createDataFrame([(float("nan"),), (1.0,), (5.0,)], "s double")
    assert [r[0] for r in s.select(flag_expr(F.col("s"), 2.0)).collect()] == [False, True, False]
    assert not any(r[0] for r in s.select(flag_expr(F.col("s"), float("nan"))).collect())


# -- files, models, folders ----------------------------------------------------------------------------


def test_csv_keeps_what_it_read(spark, tmp_path):
    from mixdetect.sources.files import read_positional_csv

    lines = ["label,0,1", "0,1.7,0.5", "1,-0.5,0.25", "0,1,0.5", "0,1,0.5", "1,0,0.1"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    df, spec = read_positional_csv(spark, str(tmp_path / "a.csv"), 1)
    with pytest.raises(ValueError, match="2 negative or fractional"):
        validate(profile(df, spec), spec)
    (tmp_path / "parts").mkdir()
    for k, part in enumerate((lines[1:3], lines[3:])):
        (tmp_path / "parts" / f"{k}.csv").write_text("\n".join([lines[0], *part[::-1]]))
    split, _ = read_positional_csv(spark, str(tmp_path / "parts"), 1)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, split.collect()))
    assert df.select("row_id").distinct().count() == 5
    (tmp_path / "b.csv").write_text("1,label,0\n0.5,0,1")
    with pytest.raises(Exception, match="(?i)header"):
        read_positional_csv(spark, str(tmp_path / "b.csv"), 1, n_features=2)[0].collect()
    (tmp_path / "c.csv").write_text("key,label,a,b\n77,0,1,0.5\n78,1,0,0.7")
    named, spec = read_positional_csv(spark, str(tmp_path / "c.csv"), 1, id_col="key")
    assert sorted(r.row_id for r in named.collect()) == [77, 78] and spec.d == 1


def test_model_folder_is_complete(spark, tmp_path):
    df = mixed_orders(spark, SF_SMALL)
    path = str(tmp_path / "model")
    mixed = Detector(MIXED_ORDERS_SPEC, QUICK).fit(df)
    mixed.save(spark, path)
    back = DetectorModel.load(spark, path)
    assert back.history == mixed.history
    frames = back.history_frames(spark)
    assert frames["sgd"].count() == len(mixed.history.sgd) and frames["em"].count() == len(mixed.history.em)
    assert {r.part for r in frames["stops"].collect()} == {"sgd", "em"}
    Detector(MixedSpec(cat_cols=("c0", "c1", "c2")), QUICK).fit(df).save(spark, path)
    assert DetectorModel.load(spark, path).gmm is None  # the older mixture is gone
    mixed.save(spark, path)
    shutil.rmtree(f"{path}/gmm")
    with pytest.raises(Exception, match="gmm"):
        DetectorModel.load(spark, path)


def test_failing_part_ends_the_fit(spark):
    df = mixed_orders(spark, SF_SMALL)
    with pytest.raises(ValueError, match="kmeans_init"):
        Detector(MIXED_ORDERS_SPEC, QUICK.replace(kmeans_init="nope")).fit(df)
    assert Detector(MIXED_ORDERS_SPEC, QUICK).fit(df).threshold is not None


def test_cross_validation_leaves_no_folds_behind(spark):
    from mixdetect.plans.crossval import cross_validate
    from mixdetect.plans.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    df = mixed_orders(spark, SF_SMALL).withColumn("payload", F.lit("x" * 100))
    before = set(os.listdir(folder))
    out = cross_validate(df, MIXED_ORDERS_SPEC, QUICK, 3).collect()
    assert [r.fold for r in out] == [0, 1, 2] and sum(r.n_pos + r.n_neg for r in out) == df.count()
    left = [f for d in set(os.listdir(folder)) - before for _, _, fs in os.walk(f"{folder}/{d}") for f in fs]
    assert not left  # folds and minibatches are deleted after use


def test_hash_folds(spark):
    from mixdetect.operators.evaluate import hash_folds

    df = mixed_orders(spark, SF_SMALL)
    sizes = [r["count"] for r in hash_folds(df, 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1.4 * min(sizes)
    assert "Exchange" not in hash_folds(df, 5)._jdf.queryExecution().executedPlan().toString()


def test_estimators_of_their_own(spark):
    df = mixed_orders(spark, SF_SMALL)
    mixture = Mixture(MIXED_ORDERS_SPEC, 3, max_iter=20).fit(df)
    t = mixture.predict(mixture.score(df)).agg(F.max(F.abs(F.col("r0") + F.col("r1") + F.col("r2") - 1)).alias("e"),
                                               F.count("loglik").alias("n"), F.max("cluster").alias("c")).first()
    assert t.e < 1e-9 and t.n == df.count() and t.c <= 2
    ll = [h[2] for h in mixture.fit_result.history]
    assert all(b >= a - 0.02 for a, b in zip(ll, ll[1:]))  # the variance floor is not part of the likelihood
    logistic = ConditionalLogistic(MIXED_ORDERS_SPEC, 2, lam=0.1, reg=0.001, max_iterations=5).fit(df)
    r = logistic.probability(df).agg(F.min("p_cat").alias("lo"), F.max("p_cat").alias("hi")).first()
    assert 0 <= r.lo < r.hi <= 1 and logistic.margins(df).columns[:3] == ["row_id", "h0", "h1"]


# -- streams -------------------------------------------------------------------------------------------


def _model(spark):
    spec = MIXED_EVENTS_SPEC
    layout = slot_layout(profile(mixed_events(spark, SF_SMALL), spec), spec)
    return DetectorModel(spec, layout, LogisticParams(*[getattr(given_logistic(2, 3, layout.n_slots, 0.1), k) for k in ("V", "W", "lam")]),
                         given_gmm(3, 3), DetectorParams(), threshold=-3.0)


def test_stream_query_reads_a_file_or_a_folder(spark, tmp_path):
    from mixdetect.queries import QUERIES

    for name in ("orders", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [sorted(map(tuple, QUERIES["stream_score_events"](spark, sf).collect())) for sf in (SF_SMALL, str(tmp_path))]
    assert rows[0] == rows[1] and len(rows[0]) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_streams_resume_and_read_folders(spark, tmp_path):
    from mixdetect.sources.fixtures import mixed_events_from
    from mixdetect.streaming import score_stream_to_parquet, start_anomaly_sink

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    source, model = str(tmp_path / "events.parquet"), _model(spark)
    events.where("event_id % 2 = 0").repartition(3).write.parquet(source)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    sink, sink_progress = str(tmp_path / "sink"), str(tmp_path / "sink-progress")

    def run():
        stream = mixed_events_from(spark.readStream.schema(events.schema).parquet(source))
        table = score_stream_to_parquet(model, stream, out, progress)
        start_anomaly_sink(model, stream, sink, "flagged", checkpoint_location=sink_progress).awaitTermination(120)
        return sorted(r.row_id for r in table.collect())

    half = sorted(r.event_id for r in events.where("event_id % 2 = 0").collect())
    assert run() == half
    assert run() == half  # nothing new, nothing twice
    events.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    assert run() == sorted(r.event_id for r in events.collect())
    want = sorted(r.row_id for r in model.transform(mixed_events(spark, SF_SMALL)).where("is_anomaly").collect())
    assert sorted(r.row_id for r in spark.read.parquet(sink).collect()) == want
    # a query with other progress counts its batches anew and overwrites nothing
    stream = mixed_events_from(spark.readStream.schema(events.schema).parquet(source))
    start_anomaly_sink(model, stream, sink, "flagged", checkpoint_location=str(tmp_path / "other")).awaitTermination(120)
    assert len(spark.read.parquet(sink).collect()) == 2 * len(want)
