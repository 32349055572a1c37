"""Column spec, hyper-parameters and fitted-parameter containers.

Parameters are small (k x (d+1), k x J, K x d): they live on the driver as
NumPy arrays and enter Spark plans as literals.  Rows never leave executors.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class MixedSpec:
    """Which columns of a frame play which role.

    ``cat_cols`` hold non-negative integer codes, ``cont_cols`` doubles.
    ``cont_array`` names one array<double> column instead of ``cont_cols``
    (wide inputs such as embeddings); ``cont_dim`` is its length.
    """

    row_id: str = "row_id"
    label: str | None = "label"
    cat_cols: tuple[str, ...] = ()
    cont_cols: tuple[str, ...] = ()
    cont_array: str | None = None
    cont_dim: int = 0

    @property
    def d(self) -> int:
        return self.cont_dim if self.cont_array else len(self.cont_cols)

    def cont_exprs(self):
        from pyspark.sql import functions as F

        if self.cont_array:
            return [F.col(self.cont_array).getItem(i).cast("double") for i in range(self.cont_dim)]
        return [F.col(c).cast("double") for c in self.cont_cols]

    def key_cols(self) -> list[str]:
        out = [self.row_id]
        if self.label:
            out.append(self.label)
        return out


def infer_spec(df: DataFrame, row_id: str = "row_id", label: str | None = "label") -> MixedSpec:
    """Canonical schema: integer columns ``c*`` categorical, double ``x*`` continuous."""
    cats, conts = [], []
    for f in df.schema.fields:
        if f.name in (row_id, label):
            continue
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            cats.append(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            conts.append(f.name)
    return MixedSpec(row_id=row_id, label=label, cat_cols=tuple(cats), cont_cols=tuple(conts))


@dataclass(frozen=True)
class DetectorParams:
    """Hyper-parameters (defaults of the original detector, plus explicit options).

    ``mode``: "joint" = log p(x) + log P(y|x) (default); "product" = their
    product, as in the original code.  ``order``/``tail`` choose how the
    threshold is taken (see README, behaviour decisions).
    """

    # The original detector's defaults and constants (same results need the same values).
    subspace_dimension: int = 10
    regularization_parameter: float = 1.0
    learning_rate_start: float = 1.0
    learning_rate_speed: float = 0.1
    gaussian_num: int = 4
    normalizing_radius: float = 10.0
    max_iterations: int = 50
    logistic_lambda: float = 1.0
    minibatch_size: int = 100
    anomaly_ratio: float = 0.1
    em_max_iter: int = 100
    em_tol: float = 1e-3
    min_covar: float = 1e-3
    no_progress_tol: float = 1e-5
    no_progress_steps: int = 10
    # Options of this engine
    em_tol_on: str = "mean"  # "mean" (default) or "total" (original behaviour)
    kmeans_max_iter: int = 100  # k-means default of the original's library
    kmeans_init: str = "hash"  # "hash" (k-means|| by row hashes, partition-independent) or "kmeans||" (Spark ML)
    mode: str = "joint"  # or "product" (original)
    order: str = "score"  # or "label_score" (original)
    tail: str = "low"  # or "high" (original)
    threshold_exact: bool = True  # False: one percentile_approx pass
    on_unseen: str = "all_zero"  # or "error"
    init: str = "random"  # "random", "constant" (original), "given"
    seed: int = 42
    hash_kind: str = "xxhash"  # "xxhash" or "modular" (SQL-portable)

    def replace(self, **kw) -> "DetectorParams":
        unknown = set(kw) - {f.name for f in dataclasses.fields(self)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return dataclasses.replace(self, **kw)

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def param_names(cls) -> list[str]:
        return [f.name for f in dataclasses.fields(cls)]


@dataclass(frozen=True)
class SlotLayout:
    """One-hot layout: block of ``width`` slots per categorical column."""

    cat_cols: tuple[str, ...]
    widths: tuple[int, ...]

    @property
    def offsets(self) -> tuple[int, ...]:
        out, acc = [], 0
        for w in self.widths:
            out.append(acc)
            acc += w
        return tuple(out)

    @property
    def n_slots(self) -> int:
        return int(sum(self.widths))

    def slot_owner(self) -> list[tuple[int, int]]:
        """(column index, code) of every slot."""
        return [(i, v) for i, w in enumerate(self.widths) for v in range(w)]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, int(o), int(w)) for c, o, w in zip(self.cat_cols, self.offsets, self.widths)]
        return spark.createDataFrame(rows, "cat_col string, offset int, width int")


@dataclass
class LogisticParams:
    V: np.ndarray  # k x (d+1), last column = intercept
    W: np.ndarray  # k x J
    lam: float

    @property
    def k(self) -> int:
        return self.V.shape[0]

    def copy(self) -> "LogisticParams":
        return LogisticParams(self.V.copy(), self.W.copy(), self.lam)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("V", r, c, float(self.V[r, c])) for r in range(self.V.shape[0]) for c in range(self.V.shape[1])]
        rows += [("W", r, c, float(self.W[r, c])) for r in range(self.W.shape[0]) for c in range(self.W.shape[1])]
        return spark.createDataFrame(rows, "matrix string, r int, c int, value double")


@dataclass
class GmmParams:
    weights: np.ndarray  # K
    means: np.ndarray  # K x d
    covars: np.ndarray  # K x d (diagonal variances)

    @property
    def K(self) -> int:
        return self.weights.shape[0]

    @property
    def d(self) -> int:
        return self.means.shape[1]

    def copy(self) -> "GmmParams":
        return GmmParams(self.weights.copy(), self.means.copy(), self.covars.copy())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m, c, float(self.weights[m]), float(self.means[m, c]), float(self.covars[m, c]))
                for m in range(self.K) for c in range(self.d)]
        return spark.createDataFrame(rows, "component int, dim int, weight double, mean double, var double")


@dataclass
class FitHistory:
    sgd: list[tuple[int, int, float, float]] = field(default_factory=list)  # (iter, n, grad_l1, lr)
    em: list[tuple[int, float, float]] = field(default_factory=list)  # (iter, total_loglik, mean_loglik)
    sgd_converged: bool = False
    em_converged: bool = False


# ---------------------------------------------------------------------------
# Given starting points (fixed values shared with the SQL oracles)
# ---------------------------------------------------------------------------

def given_logistic(k: int, d: int, J: int, lam: float) -> LogisticParams:
    """V[r][c] = ((3r + 5c) mod 7 - 3)/10 ;  W[r][j] = ((5r + 2j) mod 9 - 4)/10."""
    V = np.array([[((3 * r + 5 * c) % 7 - 3) / 10.0 for c in range(d + 1)] for r in range(k)])
    W = np.array([[((5 * r + 2 * j) % 9 - 4) / 10.0 for j in range(J)] for r in range(k)])
    return LogisticParams(V, W, lam)


def constant_logistic(k: int, d: int, J: int, lam: float) -> LogisticParams:
    """The original start: every entry 0.5 (keeps the model rank 1)."""
    return LogisticParams(np.full((k, d + 1), 0.5), np.full((k, J), 0.5), lam)


def random_logistic(k: int, d: int, J: int, lam: float, seed: int) -> LogisticParams:
    rng = np.random.default_rng(seed)
    return LogisticParams(rng.uniform(-0.5, 0.5, (k, d + 1)), rng.uniform(-0.5, 0.5, (k, J)), lam)


def given_gmm(K: int, d: int) -> GmmParams:
    """weight 1/K, mean (m + 0.5)/K in every dimension, variance 0.05."""
    return GmmParams(np.full(K, 1.0 / K),
                     np.array([[(m + 0.5) / K for _ in range(d)] for m in range(K)]),
                     np.full((K, d), 0.05))
