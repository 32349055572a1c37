"""EM for the diagonal Gaussian mixture: one aggregate job per iteration.

The continuous columns are packed into persisted matrix blocks once; each
iteration binds its parameters to one fixed pass over them (``operators.packed``,
in one job while the rows fit the tasks, else one job
an iteration), so nothing is compiled anew and the lineage stays flat.  The strategies
"generated" (parameters as literals of generated sums) and "arrow" read the
frame itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators.gmm import estep, mstep
from ..operators.packed import ALL, Passes, packed_estep, packed_rows, run_passes
from ..operators.sparse_gmm import sparse_estep
from ..spec import GmmParams, MixedSpec


@dataclass
class EmResult:
    params: GmmParams
    history: list[tuple[int, float, float]]  # (iter, total loglik, mean loglik) before each M-step
    converged: bool


def start_params(means: np.ndarray, variances: np.ndarray) -> GmmParams:
    """Uniform weights, given means, the same per-dimension variance for every component."""
    K = means.shape[0]
    return GmmParams(np.full(K, 1.0 / K), np.asarray(means, dtype=float), np.tile(variances, (K, 1)))


def iterate_em_models(step, starts: list[GmmParams], *, max_iter: int, tol: float, tol_on: str, min_covar: float) -> list[EmResult]:
    """EM of several models, each until it converges; ``step`` gives the statistics of the models named, under their parameters."""
    if tol_on not in ("mean", "total"):
        raise ValueError("tol_on must be 'mean' or 'total'")
    out = [EmResult(p.copy(), [], False) for p in starts]
    prev: list[float | None] = [None] * len(out)
    running = list(range(len(out)))
    for it in range(max_iter):
        still = []
        for f, st in zip(running, step(running, [out[f].params for f in running]), strict=True):
            out[f].params = mstep(st, out[f].params, min_covar)
            mean = st.ll / max(1, st.rows)
            cur = st.ll if tol_on == "total" else mean
            out[f].history.append((it, st.ll, mean))
            out[f].converged = prev[f] is not None and abs(cur - prev[f]) < tol
            prev[f] = cur
            if not out[f].converged:
                still.append(f)
        running = still
        if not running:
            break
    return out


def iterate_em(step, start: GmmParams, **options) -> EmResult:
    return iterate_em_models(lambda _, params: [step(params[0])], [start], **options)[0]


def em_passes(passes: Passes, starts: list[GmmParams], left_out: list[int], **options) -> list[EmResult]:
    """EM of every model over packed rows: one pass an iteration serves all that have not converged."""
    return iterate_em_models(lambda running, params: packed_estep(passes, params, [left_out[f] for f in running]), starts, **options)


def train_em(df: DataFrame, spec: MixedSpec, start: GmmParams, *, max_iter: int = 100, tol: float = 1e-3,
             tol_on: str = "mean", min_covar: float = 1e-3, strategy: str = "packed", form: str = "auto") -> EmResult:
    options = {"max_iter": max_iter, "tol": tol, "tol_on": tol_on, "min_covar": min_covar}
    if strategy in ("packed", "auto"):
        with packed_rows(df, spec) as packed:
            return run_passes(packed, lambda passes, which: em_passes(passes, [start], [ALL], **options), form=form)[0]
    return iterate_em(lambda p: estep(df, p, spec, strategy), start, **options)


def train_em_sparse(rows: DataFrame, start: GmmParams, *, max_iter: int = 100, tol: float = 1e-3, tol_on: str = "mean",
                    min_covar: float = 1e-3) -> EmResult:
    """EM over sparse rows (row_id, indices, values), which are kept for all passes."""
    rows = rows.select("indices", "values").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return iterate_em(lambda p: sparse_estep(rows, p), start, max_iter=max_iter, tol=tol, tol_on=tol_on, min_covar=min_covar)
    finally:
        rows.unpersist()
