"""The two halves of the detector as estimators of their own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import profile, slot_layout, validate
from ..operators.gmm import argmax_component, hashed_kmeans_means, kmeans_means, with_cont_loglik, with_responsibilities
from ..operators.logistic import with_cat_loglik, with_margins
from ..spec import GmmParams, LogisticParams, MixedSpec, SlotLayout, constant_logistic, random_logistic
from .em import EmResult, start_params, train_em
from .sgd import SgdResult, train_sgd


@dataclass
class MixtureModel:
    spec: MixedSpec
    params: GmmParams
    fit_result: EmResult | None = None

    def score(self, df: DataFrame, out: str = "loglik") -> DataFrame:
        """Adds log p(x)."""
        return with_cont_loglik(df, self.params, self.spec, out)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the responsibilities r0.. and the component with the largest one as ``cluster``."""
        return with_responsibilities(df, self.params, self.spec, "r").withColumn("cluster", argmax_component(self.params.K, "r"))


class Mixture:
    """Diagonal Gaussian mixture over the continuous columns of ``spec``: k-means start, then EM."""

    def __init__(self, spec: MixedSpec, n_components: int = 4, max_iter: int = 100, tol: float = 1e-3, tol_on: str = "mean",
                 min_covar: float = 1e-3, kmeans_init: str = "hash", kmeans_max_iter: int = 100, seed: int = 42,
                 start: GmmParams | None = None):
        if kmeans_init not in ("hash", "kmeans||"):
            raise ValueError(f"unknown kmeans_init {kmeans_init!r}")
        self.spec = MixedSpec(row_id=spec.row_id, label=spec.label, cont_cols=spec.cont_cols, cont_array=spec.cont_array,
                              cont_dim=spec.cont_dim)
        self.n_components, self.max_iter, self.tol, self.tol_on, self.min_covar = n_components, max_iter, tol, tol_on, min_covar
        self.kmeans_init, self.kmeans_max_iter, self.seed, self.start = kmeans_init, kmeans_max_iter, seed, start

    def fit(self, df: DataFrame) -> MixtureModel:
        spec = self.spec
        data = df.select(spec.row_id, *([spec.cont_array] if spec.cont_array else spec.cont_cols)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = profile(data, spec)
            validate(found, spec, self.n_components)
            start = self.start
            if start is None:
                seeds = hashed_kmeans_means if self.kmeans_init == "hash" else kmeans_means
                means = seeds(data, spec, self.n_components, self.seed, self.kmeans_max_iter)
                start = start_params(means, np.array([(v or 0.0) + self.min_covar for v in found.cont_var]))
            result = train_em(data, spec, start, max_iter=self.max_iter, tol=self.tol, tol_on=self.tol_on, min_covar=self.min_covar)
        finally:
            data.unpersist()
        return MixtureModel(spec, result.params, result)


@dataclass
class ConditionalModel:
    spec: MixedSpec
    layout: SlotLayout
    params: LogisticParams
    fit_result: SgdResult | None = None

    def score(self, df: DataFrame, out: str = "log_p_cat") -> DataFrame:
        """Adds log P(y|x)."""
        return with_cat_loglik(df, self.params, self.spec, self.layout, out)

    def probability(self, df: DataFrame, out: str = "p_cat") -> DataFrame:
        return self.score(df, "__lp").withColumn(out, F.exp("__lp")).drop("__lp")

    def margins(self, df: DataFrame) -> DataFrame:
        """(row id, h0.., w0..): the values behind the slots' probabilities."""
        return with_margins(df, self.params, self.spec, self.layout, [self.spec.row_id])


class ConditionalLogistic:
    """Low-rank logistic model of the categorical slots given the continuous columns, by minibatch SGD."""

    def __init__(self, spec: MixedSpec, subspace_dimension: int = 10, lam: float = 1.0, reg: float = 1.0, learning_rate_start: float = 1.0,
                 learning_rate_speed: float = 0.1, radius: float = 10.0, max_iterations: int = 50, minibatch_size: int = 100,
                 init: str = "random", seed: int = 42, hash_kind: str = "xxhash", start: LogisticParams | None = None):
        if init not in ("random", "constant"):
            raise ValueError(f"unknown init {init!r}")
        self.spec, self.k, self.lam, self.init, self.seed, self.start = spec, subspace_dimension, lam, init, seed, start
        self.options = {"max_iterations": max_iterations, "minibatch_size": minibatch_size, "reg": reg, "lr0": learning_rate_start,
                        "lr_speed": learning_rate_speed, "radius": radius, "seed": seed, "hash_kind": hash_kind}

    def fit(self, df: DataFrame) -> ConditionalModel:
        spec = self.spec
        conts = [spec.cont_array] if spec.cont_array else list(spec.cont_cols)
        data = df.select(*dict.fromkeys([*spec.key_cols(), *spec.cat_cols, *conts])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = profile(data, spec)
            validate(found, spec)
            layout = slot_layout(found, spec)
            start = self.start
            if start is None:
                start = (constant_logistic(self.k, spec.d, layout.n_slots, self.lam) if self.init == "constant"
                         else random_logistic(self.k, spec.d, layout.n_slots, self.lam, self.seed))
            result = train_sgd(data, spec, layout, found.n, start, **self.options)
        finally:
            data.unpersist()
        return ConditionalModel(spec, layout, result.params, result)
