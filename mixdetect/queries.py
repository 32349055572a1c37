"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the test tables through the fixture builders, so its work
grows with them.  Float outputs are rounded (and -0.0 folded) so that the
independent SQL oracles in :mod:`mixdetect.oracles` can compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import rounded
from .operators.encode import one_hot_long, profile, profile_frame, slot_layout
from .operators.evaluate import fold_assignment, kfold_long
from .operators.gmm import (component_logpdf_exprs, estep, hashed_kmeans_means, lloyd_step_frame, sparse_variance, variance_init_frame, with_cont_loglik,
                            with_responsibilities, argmax_component)
from .operators.logistic import gradient, minibatch_fraction, minibatches, with_cat_loglik, with_margins
from .operators.order_stats import auc_frame
from .operators.sparse_gmm import sparse_estep, sparse_rows, with_sparse_responsibilities
from .operators.scoring import (combined_score, flag_expr, interpolate_expr, score_range, target_size,
                                threshold, top_k)
from .plans.detector import Detector
from .plans.em import train_em, train_em_sparse
from .plans.session import spread_rows
from .plans.sgd import history_frame, train_sgd
from .sources.fixtures import (MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, SPARSE_LINES_DIM, WIDE_EMBEDDINGS_SPEC,
                               mixed_events, mixed_orders, sparse_lines, wide_embeddings)
from .spec import DetectorParams, GmmParams, given_gmm, given_logistic

# Fixed values shared with the SQL oracles (FIXTURES.md section 3).
LOGISTIC_K = 2
LAMBDA = 0.1
GMM_K = 3
SEED = 42
MINIBATCH = 100
SGD_STEPS = 49  # max_iterations 50 -> 49 steps
REG = 0.001
LR0 = 1.0
LR_SPEED = 0.2
FIT3_RADIUS = 0.35
MIN_COVAR = 1e-3
FLAG_RATIO = 0.05
PARITY_RATIO = 0.2
QUALITY_THRESHOLD = -3.0
TOPK = 20
FOLDS = 5
DIG = 9  # row-level values from given parameters
FIT_DIG = 7  # values downstream of fitted parameters (aggregate sums feed them)
AGG_DIG = 6  # sums over many rows
SCORE_DIG = 4  # scores of fits that run to convergence

Query = Callable[[SparkSession, str], DataFrame]


def _r(c, digits=DIG):
    return rounded(c, digits)


# ---------------------------------------------------------------------------
# shared set-ups
# ---------------------------------------------------------------------------

def _orders(spark, sf):
    return _profiled_orders(spark, sf)[:-1]


def _profiled_orders(spark, sf):
    df = mixed_orders(spark, sf)
    spec = MIXED_ORDERS_SPEC
    p = profile(df, spec)
    layout = slot_layout(p, spec)
    return df, spec, layout, given_logistic(LOGISTIC_K, spec.d, layout.n_slots, LAMBDA), given_gmm(GMM_K, spec.d), p.n


def _scored_orders(spark, sf, mode="joint"):
    return _scored_and_counted(spark, sf, mode)[0]


def _scored_and_counted(spark, sf, mode):
    df, spec, layout, lp, gp, n = _profiled_orders(spark, sf)
    t = with_cont_loglik(df, gp, spec, "log_p_cont")
    t = with_cat_loglik(t, lp, spec, layout, "log_p_cat")
    return t.withColumn("score", combined_score(F.col("log_p_cont"), F.col("log_p_cat"), mode)), n


def _events(spark, sf):
    return mixed_events(spark, sf), MIXED_EVENTS_SPEC, given_gmm(GMM_K, MIXED_EVENTS_SPEC.d)


def _params_frame(spark, rows, schema="component int, dim int, weight double, mean double, var double"):
    return spark.createDataFrame(rows, schema)


def _gmm_rows(p: GmmParams):
    return [(m, c, float(p.weights[m]), float(p.means[m, c]), float(p.covars[m, c]))
            for m in range(p.K) for c in range(p.d)]


def _rounded_gmm(df: DataFrame) -> DataFrame:
    return df.select("component", "dim", _r(F.col("weight"), FIT_DIG).alias("weight"),
                     _r(F.col("mean"), FIT_DIG).alias("mean"), _r(F.col("var"), FIT_DIG).alias("var"))


# ---------------------------------------------------------------------------
# S: scans and shaping
# ---------------------------------------------------------------------------

def q_mixed_split(spark, sf):
    df = mixed_orders(spark, sf)
    return df.select("row_id", "label", "c0", "c1", "c2", _r(F.col("x0")).alias("x0"), _r(F.col("x1")).alias("x1"))


def q_validate_profile(spark, sf):
    spec = MIXED_ORDERS_SPEC
    p = profile_frame(mixed_orders(spark, sf), spec)
    cols = []
    for f in p.columns:
        cols.append(_r(F.col(f)).alias(f) if f.endswith("_var") else F.col(f))
    return p.select(*cols)


def q_score_table(spark, sf):
    s = _scored_orders(spark, sf, "product")
    return s.select("label", _r(F.col("score")).alias("estimator"))


# ---------------------------------------------------------------------------
# C: categorical preparation
# ---------------------------------------------------------------------------

def q_slot_layout(spark, sf):
    df, spec, layout, _, _ = _orders(spark, sf)
    return layout.to_frame(spark)


def q_one_hot_long(spark, sf):
    df, spec, layout, _, _ = _orders(spark, sf)
    return one_hot_long(df, layout)


# ---------------------------------------------------------------------------
# L: logistic model
# ---------------------------------------------------------------------------

def q_logistic_margin(spark, sf):
    df, spec, layout, lp, _ = _orders(spark, sf)
    return with_margins(df, lp, spec, layout, ["row_id"], DIG)


def q_cat_likelihood(spark, sf):
    df, spec, layout, lp, _ = _orders(spark, sf)
    t = with_cat_loglik(df.select("row_id", *spec.cat_cols, *spec.cont_cols), lp, spec, layout)
    return t.select("row_id", _r(F.col("log_p_cat")).alias("log_p_cat"),
                    _r(F.exp("log_p_cat")).alias("p_cat"))


def q_cat_likelihood_arrow(spark, sf):
    """The Arrow form of the conditional likelihood, which very wide models take."""
    df, spec, layout, lp, _ = _orders(spark, sf)
    t = with_cat_loglik(df.select("row_id", *spec.cat_cols, *spec.cont_cols), lp, spec, layout, wide_limit=0)
    return t.select("row_id", _r(F.col("log_p_cat")).alias("log_p_cat"),
                    _r(F.exp("log_p_cat")).alias("p_cat"))


def q_minibatch_sample(spark, sf):
    df, spec, layout, _, _, n = _profiled_orders(spark, sf)
    mb = minibatches(df, spec, layout.n_slots, list(range(1, SGD_STEPS + 1)), minibatch_fraction(n, MINIBATCH),
                     SEED, "modular")
    return mb.select(F.col("step").cast("int").alias("step"), "row_id", "slot")


def q_sgd_gradient_grouped(spark, sf):
    return q_sgd_gradient(spark, sf, "grouped")


def q_sgd_gradient_arrow(spark, sf):
    return q_sgd_gradient(spark, sf, "arrow")


def q_sgd_gradient(spark, sf, strategy="global"):
    df, spec, layout, lp, _, n = _profiled_orders(spark, sf)
    mb = minibatches(df, spec, layout.n_slots, [1], minibatch_fraction(n, MINIBATCH), SEED, "modular")
    gW, gV, cnt = gradient(mb, lp, spec, layout, strategy)
    rows = [("V", r, c, float(gV[r, c] / cnt), cnt) for r in range(lp.k) for c in range(gV.shape[1])]
    rows += [("W", r, j, float(gW[r, j] / cnt), cnt) for r in range(lp.k) for j in range(gW.shape[1])]
    t = spark.createDataFrame(rows, "matrix string, r int, c int, value double, n long")
    return t.select("matrix", "r", "c", _r(F.col("value"), FIT_DIG).alias("value"), "n")


def _sgd_fit(spark, sf, steps, **form):
    df, spec, layout, lp, _, n = _profiled_orders(spark, sf)
    return train_sgd(df, spec, layout, n, lp, max_iterations=steps + 1, minibatch_size=MINIBATCH, reg=REG,
                     lr0=LR0, lr_speed=LR_SPEED, radius=FIT3_RADIUS, seed=SEED, hash_kind="modular", **form)


def q_sgd_fit_barrier(spark, sf):
    """The steps inside a barrier stage of two tasks, which exchange their gradients."""
    return q_sgd_fit_3(spark, sf, loop="barrier", tasks=2)


def q_sgd_fit_jobs(spark, sf):
    """An aggregate job for each step, which many drawn rows take."""
    return q_sgd_fit_3(spark, sf, loop="jobs")


def q_sgd_fit_3(spark, sf, **form):
    res = _sgd_fit(spark, sf, 3, **form)
    t = res.params.to_frame(spark)
    return t.select("matrix", "r", "c", _r(F.col("value"), FIT_DIG).alias("value"))


def q_sgd_history(spark, sf):
    res = _sgd_fit(spark, sf, 3)
    t = history_frame(spark, res.history)
    return t.select("iter", "n", _r(F.col("grad_l1"), FIT_DIG).alias("grad_l1"), _r(F.col("lr")).alias("lr"))


# ---------------------------------------------------------------------------
# G: Gaussian mixture
# ---------------------------------------------------------------------------

def q_gmm_var_init(spark, sf):
    df, spec, _ = _events(spark, sf)
    t = variance_init_frame(df, spec, MIN_COVAR)
    return t.select(*[_r(F.col(c)).alias(c) for c in t.columns])


def q_sparse_variance(spark, sf):
    t = sparse_variance(sparse_lines(spark, sf), SPARSE_LINES_DIM, MIN_COVAR)
    return t.select("idx", _r(F.col("variance")).alias("variance"))


def _given_centres(K, d):
    return np.array([[(m + 0.5) / K for _ in range(d)] for m in range(K)])


def q_kmeans_lloyd_step(spark, sf):
    df, spec, _ = _events(spark, sf)
    t = lloyd_step_frame(df, spec, _given_centres(GMM_K, spec.d))
    return t.select("component", "n", *[_r(F.col(f"centre{c}")).alias(f"centre{c}") for c in range(spec.d)])


def q_gmm_kmeans_init(spark, sf):
    df, spec, _ = _events(spark, sf)
    centres = hashed_kmeans_means(df, spec, GMM_K, SEED, hash_kind="modular")
    rows = [(m, *[float(v) for v in centres[m]]) for m in range(centres.shape[0])]
    schema = "component int, " + ", ".join(f"centre{c} double" for c in range(spec.d))
    return spark.createDataFrame(rows, schema).select("component", *[_r(F.col(f"centre{c}"), AGG_DIG).alias(f"centre{c}")
                                                                     for c in range(spec.d)])


def q_gmm_component_logpdf(spark, sf):
    df, spec, gp = _events(spark, sf)
    exprs = component_logpdf_exprs(gp, spec, with_weight=False)
    return df.select("row_id", *[_r(e).alias(f"lp{m}") for m, e in enumerate(exprs)])


def q_gmm_loglik(spark, sf):
    df, spec, gp = _events(spark, sf)
    return with_cont_loglik(df, gp, spec, "loglik").select("row_id", _r(F.col("loglik")).alias("loglik"))


def q_gmm_loglik_arrow(spark, sf):
    """The Arrow form of the mixture's log-likelihood, which very wide models take."""
    df, spec, gp = _events(spark, sf)
    return with_cont_loglik(df, gp, spec, "loglik", wide_limit=0).select("row_id", _r(F.col("loglik")).alias("loglik"))


def q_gmm_responsibilities(spark, sf):
    df, spec, gp = _events(spark, sf)
    t = with_responsibilities(df, gp, spec, "r")
    return t.select("row_id", *[_r(F.col(f"r{m}")).alias(f"r{m}") for m in range(gp.K)])


def q_gmm_estep(spark, sf):
    df, spec, gp = _events(spark, sf)
    return _estep_rows(spark, estep(df, gp, spec, "generated"), gp)


def q_gmm_estep_wide(spark, sf):
    df = wide_embeddings(spark, sf)
    gp = given_gmm(GMM_K, WIDE_EMBEDDINGS_SPEC.d)
    return _estep_rows(spark, estep(df, gp, WIDE_EMBEDDINGS_SPEC, "arrow"), gp)


def _sparse_rows(spark, sf):
    """Sparse vectors of up to seven quantities, as shares of the largest."""
    return sparse_rows(sparse_lines(spark, sf).withColumn("value", F.col("value") / 50.0)), given_gmm(GMM_K, SPARSE_LINES_DIM)


def q_gmm_estep_sparse(spark, sf):
    rows, gp = _sparse_rows(spark, sf)
    return _estep_rows(spark, sparse_estep(rows, gp), gp)


def q_gmm_fit_sparse_3(spark, sf):
    rows, gp = _sparse_rows(spark, sf)
    return _rounded_gmm(_params_frame(spark, _gmm_rows(train_em_sparse(rows, gp, max_iter=3, tol=-1.0, min_covar=MIN_COVAR).params)))


def q_gmm_predict_sparse(spark, sf):
    rows, gp = _sparse_rows(spark, sf)
    t = with_sparse_responsibilities(rows, gp)
    return t.select("row_id", _r(F.col("loglik")).alias("loglik"), *[_r(F.col(f"r{m}")).alias(f"r{m}") for m in range(gp.K)], "component")


def _estep_rows(spark, st, gp):
    """Statistics about zero, from those about the means."""
    n = st.n[:, None]
    s1 = st.s1 + gp.means * n
    s2 = st.s2 + 2 * gp.means * st.s1 + gp.means ** 2 * n
    rows = [(m, c, float(st.n[m]), float(s1[m, c]), float(s2[m, c]), float(st.ll)) for m in range(gp.K) for c in range(gp.d)]
    t = spark.createDataFrame(rows, "component int, dim int, n double, s1 double, s2 double, ll double")
    return t.select("component", "dim", *[_r(F.col(c), AGG_DIG).alias(c) for c in ("n", "s1", "s2", "ll")])


def _em(spark, sf, iters):
    df, spec, gp = _events(spark, sf)
    return df, spec, train_em(df, spec, gp, max_iter=iters, tol=-1.0, min_covar=MIN_COVAR)


def q_gmm_em_step(spark, sf):
    _, spec, res = _em(spark, sf, 1)
    return _rounded_gmm(_params_frame(spark, _gmm_rows(res.params)))


def q_gmm_fit_3(spark, sf):
    _, spec, res = _em(spark, sf, 3)
    return _rounded_gmm(_params_frame(spark, _gmm_rows(res.params)))


OFFSET = 2.0 ** 20  # exact in doubles next to values of some 1e-10


def q_gmm_fit_offset(spark, sf):
    """Three EM steps on a column far from zero, with the means reported without the offset."""
    df, spec, gp = _events(spark, sf)
    shifted = df.withColumn("x0", F.col("x0") + F.lit(OFFSET))
    gp.means[:, 0] += OFFSET
    res = train_em(shifted, spec, gp, max_iter=3, tol=-1.0, min_covar=MIN_COVAR)
    res.params.means[:, 0] -= OFFSET
    t = _params_frame(spark, _gmm_rows(res.params))
    return t.select("component", "dim", *[_r(F.col(c), 6).alias(c) for c in ("weight", "mean", "var")])


def q_gmm_predict(spark, sf):
    df, spec, res = _em(spark, sf, 1)
    t = with_responsibilities(df, res.params, spec, "r")
    return t.select("row_id", *[_r(F.col(f"r{m}"), FIT_DIG).alias(f"r{m}") for m in range(res.params.K)])


def q_gmm_assign(spark, sf):
    df, spec, res = _em(spark, sf, 1)
    t = with_responsibilities(df, res.params, spec, "r")
    return t.select("row_id", argmax_component(res.params.K, "r").alias("cluster"))


# ---------------------------------------------------------------------------
# A: combined detector
# ---------------------------------------------------------------------------

def _score_cols(s):
    return s.select("row_id", "label", _r(F.col("log_p_cont")).alias("log_p_cont"),
                    _r(F.col("log_p_cat")).alias("log_p_cat"), _r(F.col("score")).alias("score"))


def q_score_product(spark, sf):
    return _score_cols(_scored_orders(spark, sf, "product"))


def q_score_joint(spark, sf):
    return _score_cols(_scored_orders(spark, sf, "joint"))


def q_stream_score_events(spark, sf):
    """A3 on Structured Streaming: the events table read as a file stream,
    scored per micro-batch by the same projection as batch scoring."""
    import uuid

    from .plans.detector import DetectorModel
    from .plans.session import ensure_checkpoint_dir
    from .sources.fixtures import mixed_events_from, table
    from .streaming import score_stream_to_parquet

    df, spec, gp = _events(spark, sf)
    layout = slot_layout(profile(df, spec), spec)
    model = DetectorModel(spec, layout, given_logistic(LOGISTIC_K, spec.d, layout.n_slots, LAMBDA), gp,
                          DetectorParams())
    # as a pattern the path may be one file or a folder of part files
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    cols = ["row_id", "label", _r(F.col("log_p_cont")).alias("log_p_cont"),
            _r(F.col("log_p_cat")).alias("log_p_cat"), _r(F.col("score")).alias("score")]
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scored-events-{uuid.uuid4().hex}"
    return score_stream_to_parquet(model, mixed_events_from(stream), f"{folder}/data", f"{folder}/progress", cols)


def q_gmm_loglik_wide(spark, sf):
    """All-continuous array input: mixture log-likelihood over 64-dim embeddings."""
    df = wide_embeddings(spark, sf)
    gp = given_gmm(GMM_K, WIDE_EMBEDDINGS_SPEC.d)
    t = with_cont_loglik(df, gp, WIDE_EMBEDDINGS_SPEC, "loglik")
    return t.select("row_id", _r(F.col("loglik")).alias("loglik"))


def _given_model(spark, sf, thr=None):
    """(orders, the model of the given parameters)."""
    from .plans.detector import DetectorModel

    df, spec, layout, lp, gp = _orders(spark, sf)
    return df, DetectorModel(spec, layout, lp, gp, DetectorParams(), threshold=thr)


def q_score_quality(spark, sf):
    """Counts of dirty rows that ride on one scoring pass over orders with planted nulls, NaNs, infinities and codes."""
    df, model = _given_model(spark, sf, QUALITY_THRESHOLD)
    key = F.col("row_id")
    dirty = df.withColumns({
        "x0": F.when(key % 31 == 0, None).when(key % 53 == 0, float("inf")).otherwise(F.col("x0")),
        "x1": F.when(key % 37 == 0, float("nan")).otherwise(F.col("x1")),
        "c0": F.when(key % 43 == 0, -1).otherwise(F.col("c0")),
        "c1": F.when(key % 41 == 0, 9).otherwise(F.col("c1")),
        "c2": F.when(key % 47 == 0, None).otherwise(F.col("c2"))})
    scored, counts = model.transform_observed(dirty)
    scored.write.format("noop").mode("overwrite").save()
    got = counts.get
    return spark.createDataFrame([(name, int(got[name])) for name in sorted(got)], "metric string, n long")


def _lines_folder(spark, lines, name):
    """Lines as text files in the shared folder."""
    import uuid

    from .plans.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


def _order_fields(spark, sf):
    """Orders as text fields of whole numbers: label, three codes, two values."""
    df = mixed_orders(spark, sf)
    whole = {"x0": F.floor(F.col("x0") * 500000.0).cast("string"), "x1": F.col("row_id").cast("string")}
    return df.select("row_id", F.col("label").cast("string").alias("y"), *[F.col(c).cast("string").alias(c) for c in ("c0", "c1", "c2")],
                     *[e.alias(c) for c, e in whole.items()])


def _split_rows(clean, rejects, to_line):
    """Rejected lines with their reasons, and the lines that the clean rows stand for."""
    return rejects.select("line", F.concat_ws("; ", "reasons").alias("reasons")).unionByName(clean.select(to_line.alias("line"), F.lit("").alias("reasons")))


def q_csv_rejects(spark, sf):
    """A written CSV with planted bad lines, split into clean rows and rejects with reasons."""
    from .sources.rejects import read_csv_with_rejects

    kind = F.col("row_id") % 101
    t = _order_fields(spark, sf)
    fields = [F.when(kind == 5, "NaN").otherwise(F.col("y")), F.when(kind == 6, "-1").when(kind == 9, "?").otherwise(F.col("c0")),
              F.when(kind == 1, "x").otherwise(F.col("c1")), F.when(kind == 7, "1.5").otherwise(F.col("c2")),
              F.when(kind == 4, "").when(kind == 8, "Infinity").otherwise(F.col("x0")),
              F.when(kind == 9, "").when(kind == 3, F.concat("x1", F.lit(",7"))).otherwise(F.col("x1"))]
    lines = t.select(F.when(kind == 2, F.concat_ws(",", *fields[:5])).otherwise(F.concat_ws(",", *fields)).alias("value"))
    clean, rejects, spec = read_csv_with_rejects(spark, _lines_folder(spark, lines, "csv-rejects"), 3, 5, header=False)
    cols = ["label", *spec.cat_cols, *spec.cont_cols]
    return _split_rows(clean, rejects, F.concat_ws(",", *[F.col(c).cast("long") for c in cols]))


def q_libsvm_rejects(spark, sf):
    """Written libsvm lines with planted bad ones, split into clean rows and rejects with reasons."""
    from .sources.rejects import read_libsvm_with_rejects

    kind = F.col("row_id") % 101
    t = _order_fields(spark, sf)
    pairs = [F.concat(F.lit(f"{i}:"), F.col(c)) for i, c in enumerate(("c0", "c1", "c2", "x0", "x1"), 1)]
    label = F.when(kind == 1, "y").otherwise(F.col("y"))
    pairs = [F.when(kind == 2, "1").when(kind == 6, "1:0.5").otherwise(pairs[0]), F.when(kind == 3, "1:0").otherwise(pairs[1]), pairs[2],
             F.when(kind == 5, "4:NaN").otherwise(pairs[3]), F.when(kind == 4, "6:1").otherwise(pairs[4])]
    lines = t.select(F.concat_ws(" ", label, *pairs).alias("value"))
    clean, rejects, spec = read_libsvm_with_rejects(spark, _lines_folder(spark, lines, "libsvm-rejects"), 5, 3)
    cols = [*spec.cat_cols, *spec.cont_cols]
    line = F.concat_ws(" ", F.col("label").cast("long"), *[F.concat(F.lit(f"{i}:"), F.col(c).cast("long")) for i, c in enumerate(cols, 1)])
    return _split_rows(clean, rejects, line)


def q_sql_function_score(spark, sf):
    """The model as SQL functions: score, flag and probability inside ``spark.sql``."""
    from .plans.sql_function import register_score_functions

    df, model = _given_model(spark, sf)
    scored = model.score(df)
    model.threshold = threshold(scored, df.count(), FLAG_RATIO)
    model.score_min, model.score_max = score_range(scored)
    register_score_functions(spark, model, "mixed_order_score", "mixed_order_flag", "mixed_order_probability")
    t = spark.sql("SELECT row_id, mixed_order_score(c0, c1, c2, x0, x1) AS score FROM {orders}", orders=df)
    t = spark.sql("SELECT row_id, score, mixed_order_flag(score) AS is_anomaly, mixed_order_probability(score) AS p0 FROM {scored}", scored=t)
    return t.select("row_id", _r(F.col("score")).alias("score"), "is_anomaly", _r(F.col("p0")).alias("p0"))


def q_threshold_sketch(spark, sf):
    """Threshold and range from mergeable sketches of the parts of a table, held against the exact ranks."""
    from .operators.sketches import SKETCH_K, rank_error, rank_report, score_sketch, whole_sketch

    scored = _scored_orders(spark, sf)
    whole = whole_sketch(score_sketch(scored, by=["c1"]))
    # three times the sketch's 99 % error: its draws are its own, so the bound must hold at every run
    report = rank_report(scored, whole, FLAG_RATIO)
    return report.select("n", "target", (F.col("error") <= 3 * rank_error(SKETCH_K)).alias("within_bound"),
                         _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


def q_topk_anomalies(spark, sf):
    s = _scored_orders(spark, sf, "joint")
    return top_k(s, TOPK).select("row_id", "label", _r(F.col("score")).alias("score"))


def _thr(spark, sf, mode, ratio, order, tail):
    s, n = _scored_and_counted(spark, sf, mode)
    return s, n, threshold(s, n, ratio, order, tail)


def _one_row(spark, k, thr):
    t = spark.createDataFrame([(int(k), thr)], "k long, threshold double")
    return t.select("k", _r(F.col("threshold")).alias("threshold"))


def q_threshold_score(spark, sf):
    s, n, thr = _thr(spark, sf, "joint", FLAG_RATIO, "score", "low")
    return _one_row(spark, target_size(n, FLAG_RATIO), thr)


def q_threshold_label_score(spark, sf):
    s, n, thr = _thr(spark, sf, "product", PARITY_RATIO, "label_score", "high")
    return _one_row(spark, target_size(n, PARITY_RATIO), thr)


def q_flag_anomalies(spark, sf):
    s, n, thr = _thr(spark, sf, "joint", FLAG_RATIO, "score", "low")
    return s.select("row_id", _r(F.col("score")).alias("score"), flag_expr(F.col("score"), thr).alias("is_anomaly"))


def q_predict_labels(spark, sf):
    s, n, thr = _thr(spark, sf, "joint", FLAG_RATIO, "score", "low")
    return s.select("row_id", flag_expr(F.col("score"), thr).cast("int").alias("prediction"))


def q_predict_proba(spark, sf):
    s = _scored_orders(spark, sf, "joint")
    lo, hi = score_range(s)
    t = interpolate_expr(F.col("score"), lo, hi)
    return s.select("row_id", _r(t).alias("p0"), _r(F.lit(1.0) - t).alias("p1"))


def q_auc(spark, sf):
    s = _scored_orders(spark, sf, "joint")
    a = auc_frame(s, -F.col("score"), "label", digits=DIG)
    return a.select(_r(F.col("auc")).alias("auc"), "n_pos", "n_neg")


def q_auc_many_ranges(spark, sf):
    """AUC over many range partitions, as on large data."""
    s = _scored_orders(spark, sf, "joint")
    a = auc_frame(s, -F.col("score"), "label", n_buckets=13, digits=DIG)
    return a.select(_r(F.col("auc")).alias("auc"), "n_pos", "n_neg")


def q_kfold_many_ranges(spark, sf):
    a = fold_assignment(mixed_orders(spark, sf).select("row_id", "label"), FOLDS, shuffle=False, n_buckets=11)
    return kfold_long(a, FOLDS)


def q_kfold_contiguous(spark, sf):
    a = fold_assignment(mixed_orders(spark, sf).select("row_id", "label"), FOLDS, shuffle=False)
    return kfold_long(a, FOLDS)


def q_kfold_shuffled(spark, sf):
    a = fold_assignment(mixed_orders(spark, sf).select("row_id", "label"), FOLDS, shuffle=True, seed=SEED,
                        hash_kind="modular")
    return kfold_long(a, FOLDS)


def q_kfold_normal_only(spark, sf):
    a = fold_assignment(mixed_orders(spark, sf).select("row_id", "label"), FOLDS, shuffle=False)
    return kfold_long(a, FOLDS, normal_only=True)


FIT_PARAMS = DetectorParams(subspace_dimension=LOGISTIC_K, logistic_lambda=LAMBDA, regularization_parameter=REG,
                            learning_rate_start=LR0, learning_rate_speed=LR_SPEED, gaussian_num=GMM_K,
                            anomaly_ratio=FLAG_RATIO, seed=SEED)


FULL_FIT = FIT_PARAMS.replace(hash_kind="modular")  # the whole default fit, with row choices that SQL can follow


def q_fit_end_to_end(spark, sf):
    df = spread_rows(mixed_orders(spark, sf))
    model = Detector(MIXED_ORDERS_SPEC, FULL_FIT).fit(df)
    return model.transform(df).select("row_id", "label", _r(F.col("score"), SCORE_DIG).alias("score"), "is_anomaly")


SMALL_FIT = FIT_PARAMS.replace(init="given", hash_kind="modular", max_iterations=3, em_max_iter=2,
                               normalizing_radius=FIT3_RADIUS)


def q_fit_end_to_end_small(spark, sf):
    df = spread_rows(mixed_orders(spark, sf))
    model = Detector(MIXED_ORDERS_SPEC, SMALL_FIT).fit(df)
    return model.transform(df).select("row_id", "label", _r(F.col("score"), FIT_DIG).alias("score"), "is_anomaly")


PARITY_FIT = FIT_PARAMS.replace(init="constant", hash_kind="modular", max_iterations=3, em_max_iter=2, em_tol_on="total",
                                mode="product", order="label_score", tail="high", anomaly_ratio=PARITY_RATIO,
                                normalizing_radius=FIT3_RADIUS)


def _parity_fit(spark, sf):
    df = spread_rows(mixed_orders(spark, sf))
    return df, Detector(MIXED_ORDERS_SPEC, PARITY_FIT, gmm_start=given_gmm(GMM_K, MIXED_ORDERS_SPEC.d)).fit(df)


def q_fit_parity_small(spark, sf):
    """The original's settings together: constant start, product score, label-first threshold, high tail."""
    df, model = _parity_fit(spark, sf)
    return model.transform(df).select("row_id", "label", _r(F.col("score"), AGG_DIG).alias("score"), "is_anomaly")


def q_auc_parity_small(spark, sf):
    """AUC of the raw product score, as the original evaluates it."""
    df, model = _parity_fit(spark, sf)
    a = auc_frame(model.score(df), "score", "label", digits=AGG_DIG)
    return a.select(_r(F.col("auc")).alias("auc"), "n_pos", "n_neg")


def q_cv_auc(spark, sf):
    from .plans.crossval import cross_validate

    df = mixed_orders(spark, sf)
    t = cross_validate(df, MIXED_ORDERS_SPEC, FULL_FIT, FOLDS, normal_only=True, digits=SCORE_DIG)
    return t.select("fold", _r(F.col("auc"), SCORE_DIG).alias("auc"), "n_pos", "n_neg")


def q_cv_auc_small(spark, sf):
    """Five folds, each fitted from the given start (2 SGD + 2 EM steps) on its
    normal-only train rows and scored on the held-out fold."""
    from .plans.crossval import cross_validate

    t = cross_validate(mixed_orders(spark, sf), MIXED_ORDERS_SPEC, SMALL_FIT, FOLDS, normal_only=True,
                       digits=AGG_DIG)
    return t.select(F.col("fold").cast("int").alias("fold"), _r(F.col("auc")).alias("auc"), "n_pos", "n_neg")


QUERIES: dict[str, Query] = {
    "mixed_split": q_mixed_split,
    "validate_profile": q_validate_profile,
    "score_table": q_score_table,
    "slot_layout": q_slot_layout,
    "one_hot_long": q_one_hot_long,
    "logistic_margin": q_logistic_margin,
    "cat_likelihood": q_cat_likelihood,
    "cat_likelihood_arrow": q_cat_likelihood_arrow,
    "minibatch_sample": q_minibatch_sample,
    "sgd_gradient": q_sgd_gradient,
    "sgd_gradient_arrow": q_sgd_gradient_arrow,
    "sgd_gradient_grouped": q_sgd_gradient_grouped,
    "sgd_fit_3": q_sgd_fit_3,
    "sgd_fit_barrier": q_sgd_fit_barrier,
    "sgd_fit_jobs": q_sgd_fit_jobs,
    "sgd_history": q_sgd_history,
    "gmm_var_init": q_gmm_var_init,
    "sparse_variance": q_sparse_variance,
    "kmeans_lloyd_step": q_kmeans_lloyd_step,
    "gmm_kmeans_init": q_gmm_kmeans_init,
    "gmm_component_logpdf": q_gmm_component_logpdf,
    "gmm_loglik": q_gmm_loglik,
    "gmm_loglik_arrow": q_gmm_loglik_arrow,
    "gmm_responsibilities": q_gmm_responsibilities,
    "gmm_estep": q_gmm_estep,
    "gmm_estep_wide": q_gmm_estep_wide,
    "gmm_estep_sparse": q_gmm_estep_sparse,
    "gmm_fit_sparse_3": q_gmm_fit_sparse_3,
    "gmm_predict_sparse": q_gmm_predict_sparse,
    "gmm_loglik_wide": q_gmm_loglik_wide,
    "gmm_em_step": q_gmm_em_step,
    "gmm_fit_3": q_gmm_fit_3,
    "gmm_fit_offset": q_gmm_fit_offset,
    "gmm_predict": q_gmm_predict,
    "gmm_assign": q_gmm_assign,
    "score_product": q_score_product,
    "score_joint": q_score_joint,
    "stream_score_events": q_stream_score_events,
    "score_quality": q_score_quality,
    "csv_rejects": q_csv_rejects,
    "libsvm_rejects": q_libsvm_rejects,
    "sql_function_score": q_sql_function_score,
    "threshold_sketch": q_threshold_sketch,
    "topk_anomalies": q_topk_anomalies,
    "threshold_score": q_threshold_score,
    "threshold_label_score": q_threshold_label_score,
    "flag_anomalies": q_flag_anomalies,
    "predict_labels": q_predict_labels,
    "predict_proba": q_predict_proba,
    "auc": q_auc,
    "auc_many_ranges": q_auc_many_ranges,
    "kfold_contiguous": q_kfold_contiguous,
    "kfold_many_ranges": q_kfold_many_ranges,
    "kfold_shuffled": q_kfold_shuffled,
    "kfold_normal_only": q_kfold_normal_only,
    "fit_end_to_end": q_fit_end_to_end,
    "fit_end_to_end_small": q_fit_end_to_end_small,
    "auc_parity_small": q_auc_parity_small,
    "fit_parity_small": q_fit_parity_small,
    "cv_auc": q_cv_auc,
    "cv_auc_small": q_cv_auc_small,
}
