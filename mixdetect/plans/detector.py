"""The mixed-type density detector: fit -> model -> transform.

``Detector.fit`` runs: one profile aggregate (count, widths, validation,
variances) -> persist the pruned input -> concurrently, SGD (one draw pass +
one small aggregate per step) and k-means start + EM (one aggregate per
iteration) -> exact threshold over the training scores -> unpersist.  Only
parameters and aggregate rows reach the driver.

``DetectorModel.transform`` is a single projection with the parameters as
literals: no shuffle, no Python, and valid on streaming frames.
"""

from __future__ import annotations

import dataclasses
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.encode import leave_one_out_profiles, profile, slot_layout, validate
from ..operators.gmm import argmax_component, kmeans_means, with_cont_loglik, with_responsibilities
from ..operators.logistic import with_cat_loglik
from ..operators.packed import ALL, kmeans_draws, packed_kmeans, packed_rows, run_passes
from ..operators.quality import observed
from ..operators.scoring import (combined_score, flag_expr, interpolate_expr, score_range, threshold)
from ..spec import (DetectorParams, FitHistory, GmmParams, LogisticParams, MixedSpec, SlotLayout,
                    constant_logistic, given_gmm, given_logistic, random_logistic)
from .em import EmResult, em_passes, start_params
from .session import delete_folder
from .sgd import MAX_SLOTS, SgdModel, SgdResult, history_frame, train_sgd_models


@dataclass
class DetectorModel:
    spec: MixedSpec
    layout: SlotLayout
    logistic: LogisticParams
    gmm: GmmParams | None
    params: DetectorParams
    n_train: int = 0
    threshold: float | None = None
    score_min: float | None = None
    score_max: float | None = None
    history: FitHistory = field(default_factory=FitHistory)

    # -- scoring -----------------------------------------------------------
    def score(self, df: DataFrame) -> DataFrame:
        """Adds log_p_cont, log_p_cat and score (``params.mode``)."""
        t = df
        if self.gmm is not None and self.spec.d > 0:
            t = with_cont_loglik(t, self.gmm, self.spec, "log_p_cont")
        else:
            t = t.withColumn("log_p_cont", F.lit(0.0))
        t = with_cat_loglik(t, self.logistic, self.spec, self.layout, "log_p_cat", self.params.on_unseen)
        return t.withColumn("score", combined_score(F.col("log_p_cont"), F.col("log_p_cat"), self.params.mode))

    decision_function = score

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores plus ``is_anomaly`` against the fitted threshold."""
        s = self.score(df)
        return s.withColumn("is_anomaly", flag_expr(F.col("score"), self.threshold, self.params.tail))

    def transform_observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """``transform`` and an Observation that counts null, non-finite and unseen values, dirty and flagged rows on the
        way: its ``get`` answers once an action has read the scored rows."""
        counts = Observation("mixdetect_quality")
        return observed(self.transform(df), self.spec, self.layout, counts), counts

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df).withColumn("prediction", F.col("is_anomaly").cast("int"))

    def fit_range(self, df: DataFrame) -> "DetectorModel":
        """min/max of the scores over ``df`` (one aggregate), used by predict_proba."""
        self.score_min, self.score_max = score_range(self.score(df))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        s = self.score(df)
        t = interpolate_expr(F.col("score"), self.score_min, self.score_max)
        return s.select("*", t.alias("p0"), (F.lit(1.0) - t).alias("p1"))

    def memberships(self, df: DataFrame) -> DataFrame:
        if self.gmm is None:
            raise ValueError("model has no continuous part")
        t = with_responsibilities(df, self.gmm, self.spec, "r")
        return t.withColumn("cluster", argmax_component(self.gmm.K, "r"))

    # -- persistence ------------------------------------------------------
    def parameter_frames(self, spark) -> dict[str, DataFrame]:
        out = {"logistic": self.logistic.to_frame(spark), "slots": self.layout.to_frame(spark)}
        if self.gmm is not None:
            out["gmm"] = self.gmm.to_frame(spark)
        return out

    def save(self, spark, path: str) -> None:
        """Write the model as small parquet tables plus one JSON line under ``path``
        (any filesystem Spark can write to, so a streaming job elsewhere can load it)."""
        import json

        meta = {"spec": dataclasses.asdict(self.spec), "params": self.params.as_dict(), "lam": self.logistic.lam,
                "n_train": self.n_train, "threshold": self.threshold, "score_min": self.score_min,
                "score_max": self.score_max, "has_gmm": self.gmm is not None,
                "history": {"sgd": self.history.sgd, "em": self.history.em, "sgd_converged": self.history.sgd_converged,
                            "em_converged": self.history.em_converged}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")
        for name, frame in self.parameter_frames(spark).items():
            frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.gmm is None:  # a mixture that an earlier model left here is not this one's
            delete_folder(spark, f"{path}/gmm")

    def history_frames(self, spark) -> dict[str, DataFrame]:
        """SGD steps (iter, n, grad_l1, lr), EM rounds (iter, total_loglik, mean_loglik) and why each part stopped."""
        h = self.history
        stops = [("sgd", len(h.sgd), bool(h.sgd_converged)), ("em", len(h.em), bool(h.em_converged))]
        return {"sgd": history_frame(spark, h.sgd),
                "em": spark.createDataFrame([(int(i), float(t), float(m)) for i, t, m in h.em],
                                            "iter int, total_loglik double, mean_loglik double"),
                "stops": spark.createDataFrame([(p, n, "converged" if c else "iteration limit" if n else "not run") for p, n, c in stops],
                                               "part string, iterations int, reason string")}

    @classmethod
    def load(cls, spark, path: str) -> "DetectorModel":
        import json

        from ..spec import SlotLayout

        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        sd = meta["spec"]
        spec = MixedSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in sd.items()})
        slots = sorted(spark.read.parquet(f"{path}/slots").collect(), key=lambda r: r["offset"])
        layout = SlotLayout(tuple(r["cat_col"] for r in slots), tuple(int(r["width"]) for r in slots))
        lg = spark.read.parquet(f"{path}/logistic").collect()  # k x (d+1) + k x J values
        k = 1 + max(r["r"] for r in lg)
        V = np.zeros((k, spec.d + 1))
        W = np.zeros((k, layout.n_slots))
        for r in lg:
            (V if r["matrix"] == "V" else W)[r["r"], r["c"]] = r["value"]
        gmm = None
        if meta["has_gmm"]:
            g = spark.read.parquet(f"{path}/gmm").collect()  # K x d values
            K = 1 + max(r["component"] for r in g)
            gmm = GmmParams(np.zeros(K), np.zeros((K, spec.d)), np.zeros((K, spec.d)))
            for r in g:
                gmm.weights[r["component"]] = r["weight"]
                gmm.means[r["component"], r["dim"]] = r["mean"]
                gmm.covars[r["component"], r["dim"]] = r["var"]
        h = meta["history"]
        history = FitHistory([tuple(x) for x in h["sgd"]], [tuple(x) for x in h["em"]])
        history.sgd_converged, history.em_converged = h["sgd_converged"], h["em_converged"]
        return cls(spec, layout, LogisticParams(V, W, meta["lam"]), gmm, DetectorParams(**meta["params"]),
                   meta["n_train"], meta["threshold"], meta["score_min"], meta["score_max"], history)


FIT_GROUP = "mixdetect-fit"


def _cancel(df: DataFrame) -> None:
    try:
        df.sparkSession.sparkContext.cancelJobGroup(FIT_GROUP)
    except Exception:  # noqa: BLE001 -- Spark Connect: no job groups
        pass


def _use_pool(df: DataFrame, pool: str) -> None:
    """Jobs of this thread go to their own scheduler pool: under FAIR scheduling
    the one-task SGD jobs then interleave with the wide EM stages instead of
    queueing behind them (no effect under the default FIFO mode)."""
    try:
        sc = df.sparkSession.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", pool)
        sc.setJobGroup(FIT_GROUP, pool)
    except Exception:  # noqa: BLE001 -- Spark Connect: no local properties
        pass


class Detector:
    def __init__(self, spec: MixedSpec, params: DetectorParams = DetectorParams(),
                 logistic_start: LogisticParams | None = None, gmm_start: GmmParams | None = None):
        self.spec = spec
        self.params = params
        self.logistic_start = logistic_start
        self.gmm_start = gmm_start

    # parameter access under the original detector's method names
    def set_params(self, **params) -> "Detector":
        self.params = self.params.replace(**params)
        return self

    def get_params(self) -> dict:
        return self.params.as_dict()

    def get_param_names(self) -> list[str]:
        return DetectorParams.param_names()

    def _logistic_start(self, d: int, J: int) -> LogisticParams:
        p = self.params
        if self.logistic_start is not None:
            return self.logistic_start.copy()
        k = p.subspace_dimension
        if p.init == "constant":
            return constant_logistic(k, d, J, p.logistic_lambda)
        if p.init == "given":
            return given_logistic(k, d, J, p.logistic_lambda)
        if p.init == "random":
            return random_logistic(k, d, J, p.logistic_lambda, p.seed)
        raise ValueError(f"unknown init {p.init!r}")

    def _fit_logistics(self, data: DataFrame, models: list[SgdModel], part: str | None = None) -> list[SgdResult]:
        p = self.params
        _use_pool(data, "mixdetect-sgd")
        return train_sgd_models(data, self.spec, models, part, max_iterations=p.max_iterations, minibatch_size=p.minibatch_size,
                                reg=p.regularization_parameter, lr0=p.learning_rate_start,
                                lr_speed=p.learning_rate_speed, radius=p.normalizing_radius,
                                seed=p.seed, hash_kind=p.hash_kind, no_progress_tol=p.no_progress_tol,
                                no_progress_steps=p.no_progress_steps)

    def _fit_mixtures(self, data: DataFrame, variances: list, part: str | None = None, left_out: tuple[int, ...] = (ALL,)) -> list[EmResult]:
        """The mixture of every model, one for each part left out, in shared passes."""
        p, spec = self.params, self.spec
        _use_pool(data, "mixdetect-mixture")
        K, left_out = p.gaussian_num, list(left_out)
        given = self.gmm_start if self.gmm_start is not None else given_gmm(K, spec.d) if p.init == "given" else None
        if given is None and p.kmeans_init not in ("hash", "kmeans||"):
            raise ValueError(f"unknown kmeans_init {p.kmeans_init!r}")
        draws = kmeans_draws(spec, p.seed, p.hash_kind) if given is None and p.kmeans_init == "hash" else []
        options = {"max_iter": p.em_max_iter, "tol": p.em_tol, "tol_on": p.em_tol_on, "min_covar": p.min_covar}
        spread = [np.array([(x or 0.0) + p.min_covar for x in var]) for var in variances]
        means = None
        if given is None and not draws:
            means = [kmeans_means(data if f == ALL else data.where(F.col(part) != f), spec, K, p.seed, p.kmeans_max_iter) for f in left_out]
        kmeans_max_iter = p.kmeans_max_iter

        def fitted(passes, which):
            skip = [left_out[f] for f in which]
            if given is not None:
                starts = [given.copy() for _ in which]
            else:
                centres = packed_kmeans(passes, skip, K, kmeans_max_iter) if means is None else [means[f] for f in which]
                starts = [start_params(c, spread[f]) for c, f in zip(centres, which, strict=True)]
            return em_passes(passes, starts, skip, **options)

        with packed_rows(data, spec, part, draws) as packed:
            return run_passes(packed, fitted, len(left_out))

    def _fit_parts(self, data: DataFrame, profiles: list, part: str | None = None, left_out: tuple[int, ...] = (ALL,)) -> list[DetectorModel]:
        """One model for each part left out, in shared jobs; without thresholds."""
        p, spec = self.params, self.spec
        models = []
        for prof, skip in zip(profiles, left_out, strict=True):
            validate(prof, spec, p.gaussian_num if spec.d > 0 else None)
            layout = slot_layout(prof, spec)
            if layout.n_slots > MAX_SLOTS:
                raise ValueError(f"the codes span {layout.n_slots} slots, more than {MAX_SLOTS}; codes are expected to be dense from 0")
            models.append(SgdModel(layout, prof.n, self._logistic_start(spec.d, layout.n_slots), skip))
        # The logistic models and the mixtures do not depend on each other:
        # their job chains run concurrently from two driver threads, so the
        # small SGD jobs overlap the EM scans instead of adding to them.
        with ThreadPoolExecutor(max_workers=2, thread_name_prefix="mixdetect-fit") as pool:
            sgd_f = pool.submit(self._fit_logistics, data, models, part)
            em_f = pool.submit(self._fit_mixtures, data, [prof.cont_var for prof in profiles], part, left_out) if spec.d > 0 else None
            chains = [f for f in (sgd_f, em_f) if f is not None]
            done, running = wait(chains, return_when=FIRST_EXCEPTION)
            if running and any(f.exception() for f in done):  # one has failed: the other need not go on
                _cancel(data)
            sgd = sgd_f.result()
            em = em_f.result() if em_f is not None else [None] * len(models)
        out = []
        for m, s, e in zip(models, sgd, em, strict=True):
            hist = FitHistory(s.history, e.history if e is not None else [])
            hist.sgd_converged, hist.em_converged = s.converged, e is not None and e.converged
            out.append(DetectorModel(spec, m.layout, s.params, e.params if e is not None else None, p, m.n, history=hist))
        return out

    def _kept_columns(self) -> list[str]:
        spec = self.spec
        return list(dict.fromkeys(spec.key_cols() + list(spec.cat_cols) + ([spec.cont_array] if spec.cont_array else list(spec.cont_cols))))

    def fit_folds(self, df: DataFrame, folds: int, fold: str = "fold") -> list[DetectorModel]:
        """For each fold the model of the rows outside it, all in one fit: every pass over the rows serves all models
        that have not stopped.  The models equal those of separate fits; they have no thresholds."""
        data = df.select(*self._kept_columns(), F.col(fold).cast("int").alias(fold)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit_parts(data, leave_one_out_profiles(data, self.spec, fold, folds), fold, tuple(range(folds)))
        finally:
            data.unpersist()

    def fit(self, df: DataFrame) -> DetectorModel:
        p, spec = self.params, self.spec
        # few passes read this frame: the profile, the draw, the packing and the threshold
        data = df.select(*self._kept_columns()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # the profile is the first action on the cached frame: one source scan
            # both fills the cache and answers every shape question
            prof = profile(data, spec)
            model = self._fit_parts(data, [prof])[0]
            model.threshold = threshold(model.score(data), prof.n, p.anomaly_ratio, p.order, p.tail, "score", spec.label,
                                        exact=p.threshold_exact)
        finally:
            data.unpersist()
        return model
