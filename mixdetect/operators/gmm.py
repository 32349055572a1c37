"""Diagonal-covariance Gaussian mixture over the continuous columns.

Row-level quantities are generated column expressions with the parameters
as literals.  The E-step is one aggregate job: generated ``sum``s while the
statistic count K(1+2d) is small, otherwise NumPy partial sums per Arrow
batch (``mapInPandas``) followed by a ``groupBy(i).sum`` of a few rows per
partition.  The M-step is arithmetic on K x d driver arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions.columns import LN_2PI
from ..spec import GmmParams, MixedSpec

GENERATED_STATS_LIMIT = 60
LP = "__lp"


def component_logpdf_sql(p: GmmParams, xs: list[str], with_weight: bool) -> list[str]:
    """log N(x; mu_m, diag var_m) (+ log weight_m), one SQL expression per component."""
    d = p.d
    out = []
    for m in range(p.K):
        const = -0.5 * (d * LN_2PI + float(np.sum(np.log(p.covars[m]))))
        if with_weight:
            const += float(np.log(p.weights[m])) if p.weights[m] > 0 else -np.inf
        quad = S.add([f"({xs[c]} - {S.num(p.means[m, c])}) * ({xs[c]} - {S.num(p.means[m, c])}) * "
                      f"{S.num(1.0 / p.covars[m, c])}" for c in range(d)])
        out.append(f"({S.num(const)} - 0.5D * {quad})")
    return out


def component_logpdf_exprs(p: GmmParams, spec: MixedSpec, with_weight: bool) -> list[Column]:
    return [F.expr(e) for e in component_logpdf_sql(p, S.cont_refs(spec), with_weight)]


def with_weighted_logpdf(df: DataFrame, p: GmmParams, spec: MixedSpec, keep: list[str] | None = None) -> DataFrame:
    """Adds ``__lp*`` (weighted component log-densities) and ``__lpmax`` (their maximum)."""
    cols = S.keep(keep if keep is not None else df.columns)
    lps = component_logpdf_sql(p, S.cont_refs(spec), True)
    t = df.selectExpr(*cols, *[S.aliased(e, f"{LP}{m}") for m, e in enumerate(lps)])
    names = [f"{LP}{m}" for m in range(p.K)]
    mx = f"greatest({', '.join(names)})" if p.K > 1 else names[0]
    return t.selectExpr("*", S.aliased(mx, f"{LP}max"))


def loglik_sql(K: int) -> str:
    if K == 1:
        return f"{LP}0"
    return f"({LP}max + ln({S.add([f'exp({LP}{m} - {LP}max)' for m in range(K)])}))"


def with_cont_loglik(df: DataFrame, p: GmmParams, spec: MixedSpec, out: str = "log_p_cont",
                     wide_limit: int | None = None) -> DataFrame:
    """Adds ``out`` = log p(x) under the mixture.

    Mixtures of more than ``wide_limit`` (WIDE_EXPR_LIMIT) terms are evaluated
    in Arrow batches instead of one generated expression, with the same answers.
    """
    if spec.d == 0:
        return df.withColumn(out, F.lit(0.0))
    if p.K * p.d > (WIDE_EXPR_LIMIT if wide_limit is None else wide_limit):
        return _cont_loglik_arrow(df, p, spec, out)
    cols = df.columns
    return with_weighted_logpdf(df, p, spec).selectExpr(*S.keep(cols), S.aliased(loglik_sql(p.K), out))


WIDE_EXPR_LIMIT = 2048  # K*d generated terms; above it scoring runs on Arrow batches


def feature_input(spec: MixedSpec) -> tuple[Column, Column]:
    """(one column with all continuous features, whether it has no null): arguments for Arrow functions."""
    if spec.cont_array:
        c = F.col(spec.cont_array)
        return c, F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    cols = [F.col(c).cast("double") for c in spec.cont_cols]
    return F.array(*cols), F.array_position(F.array(*[c.isNull() for c in cols]), True) == 0


def matrix(features: pd.Series, d: int) -> np.ndarray:
    """Rows of an Arrow function's array column as an n x d matrix; a null row or value is NaN."""
    rows = features.to_list()
    if rows and all(r is not None and len(r) == d for r in rows):
        return np.concatenate(rows).astype(np.float64, copy=False).reshape(len(rows), d) if d else np.empty((len(rows), 0))
    out = np.full((len(features), d), np.nan)
    for i, row in enumerate(rows):
        if row is not None and len(row) == d:
            out[i] = row
    return out


def feature_frame(df: DataFrame, spec: MixedSpec) -> DataFrame:
    """The continuous columns alone, as doubles: input of partition-wise Arrow functions."""
    if spec.cont_array:
        return df.select(F.col(spec.cont_array).cast("array<double>").alias("features"))
    return df.select(*[F.col(c).cast("double").alias(c) for c in spec.cont_cols])


def batch_matrix(batch: pa.RecordBatch, d: int, is_array: bool) -> np.ndarray:
    """Rows of a batch of :func:`feature_frame` as an n x d matrix; nulls are NaN."""
    if not is_array:
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
    flat = batch.column(0).flatten()
    if batch.column(0).null_count == 0 and flat.null_count == 0 and len(flat) == batch.num_rows * d:
        return flat.to_numpy().reshape(-1, d)
    return matrix(batch.column(0).to_pandas(), d)


def mixture_logpdf(X: np.ndarray, p: GmmParams) -> np.ndarray:
    """n x K weighted component log-densities, in K passes of n x d."""
    const = -0.5 * (p.d * LN_2PI + np.log(p.covars).sum(axis=1))
    lp = np.empty((len(X), p.K))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        const = const + np.log(p.weights)
        for m in range(p.K):
            lp[:, m] = const[m] - 0.5 * (((X - p.means[m]) ** 2) / p.covars[m]).sum(axis=1)
    return lp


def row_loglik(lp: np.ndarray) -> np.ndarray:
    mx = lp.max(axis=1)
    with np.errstate(invalid="ignore"):
        return mx + np.log(np.exp(lp - mx[:, None]).sum(axis=1))


def _cont_loglik_arrow(df: DataFrame, p: GmmParams, spec: MixedSpec, out: str) -> DataFrame:
    """The same for very wide inputs: an Arrow function over the features alone, so that no other column leaves
    the JVM.  A null feature gives null and a NaN gives NaN, as in the generated expression."""
    p = p.copy()

    @F.pandas_udf("double")
    def loglik(features: pd.Series) -> pd.Series:
        return pd.Series(row_loglik(mixture_logpdf(matrix(features, p.d), p)))

    features, whole = feature_input(spec)
    return df.withColumn(out, F.when(whole, F.coalesce(loglik(features), F.lit(float("nan")))))  # Arrow returns NaN as null


def with_responsibilities(df: DataFrame, p: GmmParams, spec: MixedSpec, prefix: str = "r", wide_limit: int | None = None) -> DataFrame:
    """Adds ``r0``.. (``prefix``), the components' posterior probabilities; very wide mixtures run on Arrow batches."""
    if p.K * p.d > (WIDE_EXPR_LIMIT if wide_limit is None else wide_limit):
        p = p.copy()

        @F.pandas_udf("array<double>")
        def posterior(features: pd.Series) -> pd.Series:
            lp = mixture_logpdf(matrix(features, p.d), p)
            return pd.Series(list(np.exp(lp - row_loglik(lp)[:, None])))

        features, whole = feature_input(spec)
        t = df.withColumn("__r", F.when(whole, posterior(features)))
        return t.select(*df.columns, *[F.col("__r")[m].alias(f"{prefix}{m}") for m in range(p.K)])
    cols = df.columns
    t = with_weighted_logpdf(df, p, spec).selectExpr("*", S.aliased(loglik_sql(p.K), "__ll"))
    return t.selectExpr(*S.keep(cols), *[S.aliased(f"exp({LP}{m} - __ll)", f"{prefix}{m}") for m in range(p.K)])


def argmax_component(K: int, prefix: str = "r") -> Column:
    """Index of the largest responsibility (first one on ties)."""
    arr = F.array(*[F.col(f"{prefix}{m}") for m in range(K)])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


# ---------------------------------------------------------------------------
# E-step
# ---------------------------------------------------------------------------

class Stats:
    """Sufficient statistics of one E-step: s1 and s2 are sums of r (x - mean) and r (x - mean)^2 about the means
    that went in, so that no large offset of the data cancels in the variances."""

    def __init__(self, ll: float, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, rows: int):
        self.ll, self.n, self.s1, self.s2, self.rows = ll, n, s1, s2, rows


def estep_frame_generated(df: DataFrame, p: GmmParams, spec: MixedSpec) -> DataFrame:
    """One-row aggregate of all sufficient statistics, written as one SQL projection."""
    K, d = p.K, p.d
    src = [spec.cont_array] if spec.cont_array else list(spec.cont_cols)
    t = with_weighted_logpdf(df, p, spec, keep=src)
    xs = S.cont_refs(spec)
    t = t.selectExpr(*S.keep(src), *[f"{LP}{m}" for m in range(K)], S.aliased(loglik_sql(K), "__ll"))
    t = t.selectExpr(*S.keep(src), "__ll", *[S.aliased(f"exp({LP}{m} - __ll)", f"__r{m}") for m in range(K)])
    aggs = ["count(1) AS rows", "sum(__ll) AS ll"]
    aggs += [f"sum(__r{m}) AS n{m}" for m in range(K)]
    off = [[f"({xs[c]} - {S.num(p.means[m, c])})" for c in range(d)] for m in range(K)]
    aggs += [f"sum(__r{m} * {off[m][c]}) AS s1_{m}_{c}" for m in range(K) for c in range(d)]
    aggs += [f"sum(__r{m} * {off[m][c]} * {off[m][c]}) AS s2_{m}_{c}" for m in range(K) for c in range(d)]
    return t.selectExpr(*aggs)


def _partial_sums_fn(p: GmmParams, spec: MixedSpec):
    p = p.copy()
    K, d = p.K, p.d

    is_array = bool(spec.cont_array)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(2 + K + 2 * K * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            X = batch_matrix(batch, d, is_array)
            lp = mixture_logpdf(X, p)
            ll = row_loglik(lp)
            R = np.exp(lp - ll[:, None])
            acc[0] += len(X)
            acc[1] += ll.sum()
            acc[2:2 + K] += R.sum(axis=0)
            for m in range(K):
                off = X - p.means[m]
                acc[2 + K + m * d:2 + K + (m + 1) * d] += R[:, m] @ off
                acc[2 + K + (K + m) * d:2 + K + (K + m + 1) * d] += R[:, m] @ (off * off)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size, dtype=np.int32)), pa.array(acc)], ["i", "v"])

    return fn


def estep_frame_arrow(df: DataFrame, p: GmmParams, spec: MixedSpec) -> DataFrame:
    """Long (i, v) totals: per-partition NumPy partials, then a tiny groupBy."""
    return (feature_frame(df, spec).mapInArrow(_partial_sums_fn(p, spec), "i int, v double")
            .groupBy("i").agg(F.sum("v").alias("v")))


def estep(df: DataFrame, p: GmmParams, spec: MixedSpec, strategy: str = "auto") -> Stats:
    K, d = p.K, p.d
    if strategy == "auto":
        strategy = "generated" if K * (1 + 2 * d) <= GENERATED_STATS_LIMIT else "arrow"
    if strategy == "generated":
        row = estep_frame_generated(df, p, spec).first()
        n = np.array([row[f"n{m}"] or 0.0 for m in range(K)])
        s1 = np.array([[row[f"s1_{m}_{c}"] or 0.0 for c in range(d)] for m in range(K)])
        s2 = np.array([[row[f"s2_{m}_{c}"] or 0.0 for c in range(d)] for m in range(K)])
        return Stats(float(row["ll"] or 0.0), n, s1, s2, int(row["rows"]))
    if strategy == "arrow":
        acc = np.zeros(2 + K + 2 * K * d)
        for row in estep_frame_arrow(df, p, spec).collect():  # 2 + K + 2Kd rows
            acc[int(row["i"])] = row["v"]
        return Stats(float(acc[1]), acc[2:2 + K], acc[2 + K:2 + K + K * d].reshape(K, d),
                     acc[2 + K + K * d:].reshape(K, d), int(round(acc[0])))
    raise ValueError(f"unknown E-step strategy {strategy!r}")


def mstep(st: Stats, old: GmmParams, min_covar: float) -> GmmParams:
    """weights n_k / sum n; with the shift s1/n_k of a mean, variances s2/n_k - shift^2 + min_covar.

    A component with no mass keeps its previous mean and variance; a
    variance that cancellation drives to <= 0 is floored at ``min_covar``.
    """
    n = st.n
    total = n.sum()
    weights = n / total if total > 0 else old.weights.copy()
    safe = np.where(n > 0, n, 1.0)
    shift = st.s1 / safe[:, None]
    means = np.where((n > 0)[:, None], old.means + shift, old.means)
    covars = np.where((n > 0)[:, None], st.s2 / safe[:, None] - shift ** 2 + min_covar, old.covars)
    covars = np.where(covars > 0, covars, min_covar)
    return GmmParams(weights, means, covars)


# ---------------------------------------------------------------------------
# Starting points
# ---------------------------------------------------------------------------

def variance_init_frame(df: DataFrame, spec: MixedSpec, min_covar: float = 1e-3) -> DataFrame:
    """Population variance of every continuous column + floor, one job."""
    xs = spec.cont_exprs()
    names = spec.cont_cols if not spec.cont_array else [f"{spec.cont_array}_{j}" for j in range(spec.cont_dim)]
    return df.agg(*[(F.var_pop(x) + F.lit(min_covar)).alias(f"{n}_var") for x, n in zip(xs, names)])


def sparse_variance(long_df: DataFrame, dim: int, min_covar: float = 1e-3, n_rows: int | None = None,
                    row_id: str = "row_id", idx: str = "idx", value: str = "value") -> DataFrame:
    """Per-dimension variance of long-form sparse vectors; absent entries are 0.

    N is the number of vectors (distinct ``row_id``), not of entries.  The
    result has all ``dim`` dimensions, so dimensions without entries get
    variance 0 + floor.  An entry outside 0..dim-1 is an error.
    """
    spark = long_df.sparkSession
    outside = F.sum(F.when((F.col(idx) >= 0) & (F.col(idx) < dim), 0).otherwise(1)).alias("outside")
    checked = long_df.agg(outside, *([F.countDistinct(row_id).alias("n")] if n_rows is None else [])).first()
    if checked["outside"]:
        raise ValueError(f"{checked['outside']} entries have an index outside 0..{dim - 1}")
    n_rows = checked["n"] if n_rows is None else n_rows
    n = F.lit(float(n_rows))
    # mean and variance of a dimension's entries, then put together with its zeros: nothing large cancels
    own = (long_df.groupBy(idx).agg(F.count(value).cast("double").alias("k"), F.avg(value).alias("m"),
                                    F.var_pop(value).alias("v")))
    dims = spark.range(dim).select(F.col("id").cast("int").alias(idx))
    t = dims.join(own, idx, "left")
    mean = F.col("k") * F.col("m") / n
    spread = F.col("k") * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean)) + (n - F.col("k")) * mean * mean
    return t.select(idx, (F.coalesce(spread / n, F.lit(0.0)) + F.lit(min_covar)).alias("variance"))


def kmeans_means(df: DataFrame, spec: MixedSpec, K: int, seed: int, max_iter: int = 100) -> np.ndarray:
    """k-means|| centres from Spark ML (distributed) as the EM start means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if spec.cont_array:
        vec = df.select(array_to_vector(F.col(spec.cont_array)).alias("features"))
    else:
        vec = VectorAssembler(inputCols=list(spec.cont_cols), outputCol="features").transform(
            df.select(*spec.cont_cols)).select("features")
    model = KMeans(k=K, seed=seed, maxIter=max_iter, initMode="k-means||", featuresCol="features").fit(vec)
    centres = np.array([np.asarray(c, dtype=float) for c in model.clusterCenters()])
    if centres.shape[0] < K:  # fewer distinct points than components
        reps = int(np.ceil(K / centres.shape[0]))
        centres = np.tile(centres, (reps, 1))[:K]
    return centres


KMEANS_ROUNDS = 5


def hashed_kmeans_means(df: DataFrame, spec: MixedSpec, K: int, seed: int, max_iter: int = 100, tol: float = 1e-4,
                        hash_kind: str = "xxhash", rounds: int = KMEANS_ROUNDS, oversampling: float | None = None,
                        form: str = "auto") -> np.ndarray:
    """Partition-independent k-means|| start and Lloyd steps, over all rows.

    The first seed is the row with the least seeded hash of ``row_id``.  In
    each round every row becomes a candidate with probability
    min(1, l d^2 / sum d^2), l = 2K by default, decided by its hash for that
    round: some l rows are expected.  Candidates weigh the rows nearest to
    them; the heaviest one is the first seed, and each further seed is the
    candidate with the largest weight x squared distance to the seeds before.
    Lloyd steps over the weighted candidates, then over all rows, follow until no centre moves by ``tol``; an empty cluster
    keeps its centre.
    """
    from .packed import ALL, kmeans_draws, packed_kmeans, packed_rows, run_passes

    with packed_rows(df, spec, draws=kmeans_draws(spec, seed, hash_kind, rounds)) as packed:
        return run_passes(packed, lambda passes, which: packed_kmeans(passes, [ALL], K, max_iter, tol, oversampling), form=form)[0]


def _weighted_lloyd(points: np.ndarray, weight: np.ndarray, centres: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """k-means steps over the few weighted candidates: most of the way, without a pass over the rows."""
    for _ in range(max_iter):
        at = np.argmin(((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), axis=1)
        new = centres.copy()
        for m in range(len(centres)):
            if weight[at == m].sum() > 0:
                new[m] = (weight[at == m, None] * points[at == m]).sum(axis=0) / weight[at == m].sum()
        moved = float(np.sqrt(((new - centres) ** 2).sum(axis=1)).max())
        centres = new
        if moved < tol:
            break
    return centres


def lloyd(df: DataFrame, spec: MixedSpec, centres: np.ndarray, max_iter: int, tol: float, form: str = "auto") -> np.ndarray:
    """k-means steps over all rows until no centre moves by ``tol``."""
    from .packed import ALL, packed_lloyd, packed_rows, run_passes

    with packed_rows(df, spec) as packed:
        return run_passes(packed, lambda passes, which: packed_lloyd(passes, [centres], [ALL], max_iter, tol), form=form)[0]


def _assigned(df: DataFrame, spec: MixedSpec, centres: np.ndarray) -> DataFrame:
    xs = S.cont_refs(spec)
    K, d = centres.shape
    dists = [S.add([f"({xs[c]} - {S.num(centres[m, c])}) * ({xs[c]} - {S.num(centres[m, c])})" for c in range(d)])
             for m in range(K)]
    t = df.selectExpr(*[S.aliased(x, f"__x{c}") for c, x in enumerate(xs)],
                      *[S.aliased(e, f"__d{m}") for m, e in enumerate(dists)])
    arr = f"array({', '.join(f'__d{m}' for m in range(K))})"
    return t.selectExpr(*[f"__x{c}" for c in range(d)],
                        f"CAST(array_position({arr}, array_min({arr})) - 1 AS INT) AS component")


def lloyd_step_frame(df: DataFrame, spec: MixedSpec, centres: np.ndarray) -> DataFrame:
    """One k-means step from given centres: assign to the nearest (first on ties), then average."""
    d = centres.shape[1]
    return _assigned(df, spec, centres).groupBy("component").agg(F.count(F.lit(1)).alias("n"),
                                      *[F.avg(f"__x{c}").alias(f"centre{c}") for c in range(d)])
