"""Low-rank logistic model of the categorical slots given the continuous columns.

    h   = V . [x, 1]                (k values per row)
    w_j = h . W[:, j]               (one margin per slot)
    log P(y|x) = sum_j log sigmoid(z_j * w_j / lambda),  z_j = +1 if slot j is hot

All of it is generated column expressions with the parameters as literals:
a projection for scoring, one grouped aggregate per SGD step for training.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions.columns import (HASH_RANGE, STREAM_FIRST, STREAM_SELECT, STREAM_SLOT, modular_below, residue_starts,
                                 row_hash, selection_cutoff, uniform)
from ..spec import LogisticParams, MixedSpec, SlotLayout
from .encode import unseen_count
from .gmm import feature_input, matrix

H = "__h"


def h_sql(params: LogisticParams, spec: MixedSpec) -> list[str]:
    """h_r = V[r, :d] . x + V[r, d]."""
    xs = S.cont_refs(spec)
    d = len(xs)
    return [S.add([f"{S.num(params.V[r, c])} * {xs[c]}" for c in range(d)] + [S.num(params.V[r, d])])
            for r in range(params.k)]


def with_h(df: DataFrame, params: LogisticParams, spec: MixedSpec) -> DataFrame:
    return df.selectExpr("*", *[S.aliased(e, f"{H}{r}") for r, e in enumerate(h_sql(params, spec))])


def margin_sql(params: LogisticParams, n_slots: int) -> list[str]:
    """w_j = h . W[:, j]; needs the ``__h*`` columns of :func:`with_h`."""
    return [S.add([f"{H}{r} * {S.num(params.W[r, j])}" for r in range(params.k)]) for j in range(n_slots)]


def slot_sign_sql(layout: SlotLayout) -> list[str]:
    """z_j = +1 if slot j is hot else -1 (unseen codes light no slot)."""
    return [f"(CASE WHEN {S.ident(c)} = {v} THEN 1.0D ELSE -1.0D END)"
            for i, c in enumerate(layout.cat_cols) for v in range(layout.widths[i])]


def cat_loglik_sql(n_slots: int) -> str:
    """Sum of log-sigmoids over the ``__m*`` columns (each margin computed once, below)."""
    return S.add([S.log_sigmoid(f"__m{j}") for j in range(n_slots)])


def with_cat_loglik(df: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout,
                    out: str = "log_p_cat", on_unseen: str = "all_zero", wide_limit: int | None = None) -> DataFrame:
    """Adds ``out`` = log P(y|x); drops the helper columns again.

    Models of more than ``wide_limit`` (WIDE_EXPR_LIMIT) terms are evaluated in
    Arrow batches instead of one generated expression, with the same answers.
    """
    base = df
    if on_unseen == "error" and layout.cat_cols:
        base = base.withColumn("__unseen", unseen_count(layout))
        base = base.where(F.when(F.col("__unseen") > 0,
                                 F.raise_error(F.lit("unseen category code at scoring"))).otherwise(F.lit(True)))
        base = base.drop("__unseen")
    elif on_unseen not in ("all_zero", "error"):
        raise ValueError(f"on_unseen must be 'all_zero' or 'error', not {on_unseen!r}")
    cols = S.keep(df.columns)
    if layout.n_slots == 0:
        return base.selectExpr(*cols, S.aliased("0.0D", out))
    if params.k * layout.n_slots > (WIDE_EXPR_LIMIT if wide_limit is None else wide_limit):
        return _cat_loglik_arrow(base, params, spec, layout, out)
    t = with_h(base, params, spec)
    ms = [f"({z} * {w} / {S.num(params.lam)})" for z, w in zip(slot_sign_sql(layout), margin_sql(params, layout.n_slots))]
    t = t.selectExpr(*cols, *[S.aliased(m, f"__m{j}") for j, m in enumerate(ms)])
    return t.selectExpr(*cols, S.aliased(cat_loglik_sql(layout.n_slots), out))


WIDE_EXPR_LIMIT = 4096  # k*J generated terms; above it scoring runs on Arrow batches
CHUNK_CELLS = 4_000_000  # rows x slots held at once inside one Arrow batch


def row_cat_loglik(X: np.ndarray, codes: np.ndarray, params: LogisticParams, layout: SlotLayout) -> np.ndarray:
    """log P(y|x) of rows of features and codes, in chunks of at most CHUNK_CELLS margins."""
    V, W, lam = params.V, params.W, float(params.lam)
    d = V.shape[1] - 1
    rows_per_chunk = max(1, CHUNK_CELLS // max(1, layout.n_slots))
    res = np.zeros(len(X))
    for a in range(0, len(X), rows_per_chunk):
        with np.errstate(invalid="ignore", over="ignore"):
            M = ((X[a:a + rows_per_chunk] @ V[:, :d].T + V[:, d]) @ W) / lam
            acc = -np.logaddexp(0.0, M).sum(axis=1)
        rows = np.arange(len(M))
        for i, (off, w) in enumerate(zip(layout.offsets, layout.widths)):
            cc = codes[a:a + rows_per_chunk, i]
            ok = (cc >= 0) & (cc < w) & (cc == np.floor(cc))
            acc[ok] += M[rows[ok], off + cc[ok].astype(np.int64)]
        res[a:a + rows_per_chunk] = acc
    return res


def _cat_loglik_arrow(df: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout,
                      out: str) -> DataFrame:
    """log P(y|x) for very many slots: an Arrow function over features and codes alone.

    With m_j = w_j / lambda:  sum_j log sigmoid(z_j m_j) = sum_j log sigmoid(-m_j) + sum_(hot j) m_j,
    evaluated in row chunks of at most CHUNK_CELLS margins.  As in the generated
    expression, a null feature gives null, a NaN gives NaN, and a null,
    fractional or unseen code lights no slot.
    """
    params = params.copy()
    d = params.V.shape[1] - 1

    @F.pandas_udf("double")
    def loglik(features: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series(row_cat_loglik(matrix(features, d), matrix(codes, len(layout.widths)), params, layout))

    features, whole = feature_input(spec)
    codes = F.array(*[F.col(c).cast("double") for c in layout.cat_cols])
    return df.withColumn(out, F.when(whole, F.coalesce(loglik(features, codes), F.lit(float("nan")))))  # Arrow returns NaN as null


def with_margins(df: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout,
                 keep: list[str], digits: int | None = None) -> DataFrame:
    """(keep.., h0.., w0..) -- the bilinear margins themselves."""
    from ..functions.columns import rounded

    def rd(c: Column) -> Column:
        return rounded(c, digits) if digits is not None else c

    hs = [rd(F.col(f"{H}{r}")).alias(f"h{r}") for r in range(params.k)]
    ws = [rd(F.expr(w)).alias(f"w{j}") for j, w in enumerate(margin_sql(params, layout.n_slots))]
    return with_h(df, params, spec).select(*keep, *hs, *ws)


# ---------------------------------------------------------------------------
# SGD building blocks
# ---------------------------------------------------------------------------

def minibatch_fraction(n: int, minibatch_size: int) -> float:
    return min(1.0, float(minibatch_size) / float(n)) if n > 0 else 1.0


def modular_draws(df: DataFrame, row_id: str, steps: list[int], cutoffs: list[int], seed: int, part: str | None = None,
                  left_out: list[int | None] | None = None) -> DataFrame:
    """Rows of ``df`` with each (model, step) that draws them: modular hash of (row, step) below the model's cutoff.

    A model may leave out the rows of one part.  A hash serves all models; only
    ids and parts go to the Arrow function.
    """
    skip = left_out or [None] * len(cutoffs)
    top, n_steps = max(cutoffs), len(steps)

    @F.arrow_udf("array<int>")
    def drawn(ids: pa.Array, parts: pa.Array) -> pa.Array:
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        own, unknown = np.flatnonzero(known), np.flatnonzero(~known)
        of = parts.fill_null(0).to_numpy(zero_copy_only=False)
        has_part = ~parts.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)[own]
        starts = (residue_starts(values, 0), residue_starts(values, 1))
        rows, codes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for i, step in enumerate(steps):
            at, h = modular_below(starts, step, seed, STREAM_SELECT, top)
            at = own[at]
            for m, (cutoff, out) in enumerate(zip(cutoffs, skip)):
                hit = at[h < np.uint64(cutoff)]
                if cutoff >= HASH_RANGE:  # every row, with or without an id
                    hit = np.concatenate([hit, unknown])
                if out is not None:
                    hit = hit[has_part[hit] & (of[hit] != out)]
                rows.append(hit)
                codes.append(np.full(len(hit), m * n_steps + i))
        row, code = np.concatenate(rows), np.concatenate(codes)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[np.argsort(row, kind="stable")], pa.int32()))

    owner = F.lit(0) if part is None else F.col(part)
    t = df.withColumn("__drawn", drawn(F.col(row_id).cast("long"), owner.cast("int")))
    # an inner explode infers a filter on its input, which would call the function a second time
    t = t.select(*df.columns, F.explode_outer("__drawn").alias("__code")).where(F.col("__code").isNotNull())
    at = F.element_at(F.array(*[F.lit(int(s)) for s in steps]), F.col("__code") % n_steps + 1)
    return t.select(*df.columns, at.alias("step"), F.floor(F.col("__code") / n_steps).cast("int").alias("model"))


def minibatches(df: DataFrame, spec: MixedSpec, n_slots: int, steps: list[int], fraction: float,
                seed: int, hash_kind: str) -> DataFrame:
    """Every (step, row) pair the seeded sampler selects, with the slot picked for it.

    One pass over the input for all steps: selection does not depend on the
    parameters, so drawing every minibatch up front gives the same rows as
    drawing them one step at a time.  Each row joins each step independently
    with probability ``fraction``; output size ~ fraction * N * steps.

    ``xxhash`` (production): one 53-bit uniform u0 per row decides whether the
    row is drawn in any step (u0 < 1-(1-f)^S); for those few rows the first
    step is the geometric draw ceil(ln(1-u0)/ln(1-f)) and each later step an
    independent draw -- the same law as S independent Bernoulli(f) trials, at
    one hash per row instead of S, and with no floor on f.
    ``modular`` (SQL-portable, for oracles): one integer hash per (row, step)
    against a cutoff, in Arrow batches (:func:`modular_draws`).
    """
    rid = F.col(spec.row_id)
    cols = [spec.row_id, *spec.cat_cols] + ([spec.cont_array] if spec.cont_array else list(spec.cont_cols))
    base = df.select(*cols)
    step_arr = F.array(*[F.lit(int(s)) for s in steps])
    f = min(1.0, max(0.0, float(fraction)))
    if hash_kind == "modular":
        cutoff = selection_cutoff(f)
        stepped = (base.select("*", F.explode(step_arr).alias("step")) if cutoff >= HASH_RANGE
                   else modular_draws(base, spec.row_id, steps, [cutoff], seed).drop("model"))
    elif hash_kind == "xxhash":
        if f >= 1.0:
            stepped = base.select("*", F.explode(step_arr).alias("step"))
        elif f <= 0.0:
            stepped = base.select("*", F.lit(int(steps[0])).alias("step")).where(F.lit(False))
        else:
            n_steps = len(steps)
            log_keep = math.log1p(-f)
            p_any = -math.expm1(n_steps * log_keep)
            # keyed on the draw's first step label, so a redraw (new labels) is independent
            u0 = uniform(rid, int(steps[0]), seed, STREAM_FIRST)
            cand = base.select("*", u0.alias("__u0")).where(F.col("__u0") < p_any)
            first = F.least(F.greatest(F.ceil(F.log1p(-F.col("__u0")) / log_keep), F.lit(1)), F.lit(n_steps))
            t = cand.select("*", first.cast("int").alias("__g"), F.posexplode(step_arr).alias("__pos", "step"))
            pos = F.col("__pos") + 1
            keep = (pos == F.col("__g")) | ((pos > F.col("__g")) &
                                            (uniform(rid, F.col("step"), seed, STREAM_SELECT) < f))
            stepped = t.where(keep).drop("__u0", "__g", "__pos")
    else:
        raise ValueError(f"unknown hash kind {hash_kind!r}")
    return stepped.withColumn(
        "slot", (row_hash(hash_kind, rid, F.col("step"), seed, STREAM_SLOT) % max(1, n_slots)).cast("int"))


def hot_slot_sql(layout: SlotLayout, slot: str = "slot") -> str:
    """True if ``slot`` names the row's hot slot."""
    conds = [f"({S.ident(c)} >= 0 AND {S.ident(c)} < {w} AND {slot} = {S.ident(c)} + {o})"
             for c, o, w in zip(layout.cat_cols, layout.offsets, layout.widths)]
    return "(" + " OR ".join(conds) + ")" if conds else "false"


GLOBAL_GRADIENT_LIMIT = 256  # k*J conditional sums; above it, group by slot
REFERENCE_GRADIENT_LIMIT = 4096  # k*J parameters as literals; above it, they are bound to an Arrow function


def _gradient_rows(mb: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout) -> DataFrame:
    """Per-row gradient pieces: slot, __h*, __ws* (= W[:, slot]) and __g = -s z."""
    k = params.k
    src = ["slot", *spec.cat_cols] + ([spec.cont_array] if spec.cont_array else list(spec.cont_cols))
    wsl = [f"try_element_at(array({', '.join(S.num(v) for v in params.W[r])}), slot + 1)" for r in range(k)]
    t = mb.selectExpr(*S.keep(src), *[S.aliased(e, f"{H}{r}") for r, e in enumerate(h_sql(params, spec))],
                      *[S.aliased(e, f"__ws{r}") for r, e in enumerate(wsl)],
                      S.aliased(f"CASE WHEN {hot_slot_sql(layout)} THEN 1.0D ELSE -1.0D END", "__z"))
    w = S.add([f"{H}{r} * __ws{r}" for r in range(k)])
    return t.selectExpr("*", S.aliased(f"-{S.sigmoid(f'(-__z * {w} / {S.num(params.lam)})')} * __z", "__g"))


def gradient_frame(mb: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout) -> DataFrame:
    """Per-slot partial gradient sums of one minibatch (<= J rows).

    Only slot j of a row is touched, so each row adds -s z h to column j of
    gradW and -s z W[:, j] (x) [x, 1] to gradV, with s = sigmoid(-z w_j / lambda).
    """
    k = params.k
    xs = S.cont_refs(spec) + ["1.0D"]
    t = _gradient_rows(mb, params, spec, layout)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.expr(f"sum(__g * {H}{r})").alias(f"gw{r}") for r in range(k)]
    aggs += [F.expr(f"sum(__g * __ws{r} * {xs[c]})").alias(f"gv{r}_{c}") for r in range(k) for c in range(len(xs))]
    return t.groupBy("slot").agg(*aggs)


def gradient_global_frame(mb: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout) -> DataFrame:
    """The same sums as one global aggregate (one row, k*J conditional sums for gradW).

    A global aggregate over a single-partition input needs no exchange: the
    per-step job of a small minibatch frame is then one stage of one task.
    """
    k = params.k
    xs = S.cont_refs(spec) + ["1.0D"]
    t = _gradient_rows(mb, params, spec, layout)
    aggs = ["count(1) AS n"]
    aggs += [f"sum(CASE WHEN slot = {j} THEN __g * {H}{r} END) AS gw{r}_{j}"
             for r in range(k) for j in range(layout.n_slots)]
    aggs += [f"sum(__g * __ws{r} * {xs[c]}) AS gv{r}_{c}" for r in range(k) for c in range(len(xs))]
    return t.selectExpr(*aggs)


def partial_gradient(X: np.ndarray, slot: np.ndarray, hot: np.ndarray, params: LogisticParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(gradV, touched slots, their columns of gradW, rows) summed over rows ``X`` = [x, 1] with the slot picked for each."""
    z = np.where(hot, 1.0, -1.0)
    H, Ws = X @ params.V.T, params.W[:, slot].T
    u = -z * (H * Ws).sum(axis=1) / params.lam
    small = np.exp(-np.abs(u))
    g = -np.where(u >= 0, 1.0 / (1.0 + small), small / (1.0 + small)) * z
    touched, at = np.unique(slot, return_inverse=True)
    weighted = g[:, None] * H
    gW = np.array([np.bincount(at, weights=weighted[:, r], minlength=len(touched)) for r in range(params.k)]).reshape(params.k, len(touched))
    return (g[:, None] * Ws).T @ X, touched, gW, len(X)


def gradient_arrow_frame(mb: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout) -> DataFrame:
    """The same sums with the parameters bound by reference: (slot, n, s array) for the touched slots only.

    ``s`` holds the k sums of gradW's column; slot -1 holds gradV row by row.
    Each partition sums its rows, then the slots are summed.
    """
    params, k = params.copy(), params.k
    d = params.V.shape[1] - 1
    offsets, widths = np.array(layout.offsets), np.array(layout.widths)
    features, _ = feature_input(spec)
    codes = F.array(*[F.col(c).cast("double") for c in layout.cat_cols])

    def fn(batches):
        gV, total = np.zeros((k, d + 1)), 0
        sums: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.column_stack([matrix(pdf["features"], d), np.ones(len(pdf))])
            slot, C = pdf["slot"].to_numpy(), matrix(pdf["codes"], len(widths))
            hot = ((C >= 0) & (C < widths) & (slot[:, None] == C + offsets)).any(axis=1)
            own, touched, gW, n = partial_gradient(X, slot, hot, params)
            gV += own
            total += n
            for j, column, count in zip(touched.tolist(), gW.T, np.unique(slot, return_counts=True)[1].tolist()):
                got = sums.setdefault(j, [0, np.zeros(k)])
                got[0] += count
                got[1] += column
        keys = [-1, *sums]
        yield pd.DataFrame({"slot": np.array(keys, dtype=np.int64), "n": [total, *(v[0] for v in sums.values())],
                            "s": [gV.ravel(), *(v[1] for v in sums.values())]})

    rows = mb.select(F.col("slot").cast("long").alias("slot"), features.alias("features"), codes.alias("codes"))
    part = rows.mapInPandas(fn, "slot long, n long, s array<double>")
    return (part.select("slot", "n", F.posexplode("s").alias("i", "v")).groupBy("slot", "i")
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v")))


def gradient(mb: DataFrame, params: LogisticParams, spec: MixedSpec, layout: SlotLayout, strategy: str = "auto"
             ) -> tuple[np.ndarray, np.ndarray, int]:
    """Summed (not yet averaged) gradW, gradV and the minibatch size.

    ``strategy`` says how the sums are made, not what they are: "global" (one
    row), "grouped" (by slot) or "arrow" (parameters by reference, touched
    slots only); "auto" chooses by the number of parameters.
    """
    k, J, d1 = params.k, layout.n_slots, params.V.shape[1]
    if strategy == "auto":
        strategy = ("global" if k * J <= GLOBAL_GRADIENT_LIMIT else "grouped" if k * J <= REFERENCE_GRADIENT_LIMIT else "arrow")
    if strategy not in ("global", "grouped", "arrow"):
        raise ValueError(f"unknown gradient strategy {strategy!r}")
    gW = np.zeros((k, J))
    gV = np.zeros((k, d1))
    if strategy == "global":
        row = gradient_global_frame(mb, params, spec, layout).first()
        for r in range(k):
            for j in range(J):
                gW[r, j] = row[f"gw{r}_{j}"] or 0.0
            for c in range(d1):
                gV[r, c] = row[f"gv{r}_{c}"] or 0.0
        return gW, gV, int(row["n"])
    n = 0
    if strategy == "arrow":
        for row in gradient_arrow_frame(mb, params, spec, layout).collect():  # <= k (J + d + 1) numbers
            j, i, v = row["slot"], row["i"], row["v"]
            if j < 0:
                gV[i // d1, i % d1] += v
                n = int(row["n"])
            else:
                gW[i, j] += v
        return gW, gV, n
    for row in gradient_frame(mb, params, spec, layout).collect():  # <= J rows
        j = int(row["slot"])
        n += int(row["n"])
        for r in range(k):
            gW[r, j] += row[f"gw{r}"]
            for c in range(d1):
                gV[r, c] += row[f"gv{r}_{c}"]
    return gW, gV, n


def regularised_update(p: LogisticParams, gW: np.ndarray, gV: np.ndarray, lr: float, reg: float,
                       radius: float) -> LogisticParams:
    """M <- M - lr (G + 2 reg scale M), then columns longer than ``radius`` are shrunk."""
    k, J = p.W.shape
    d1 = p.V.shape[1]
    scale_w = 1.0 / np.sqrt(J * k) if J > 0 else 0.0
    scale_v = 1.0 / np.sqrt(d1 * k)
    W = p.W - lr * (gW + 2.0 * reg * scale_w * p.W)
    V = p.V - lr * (gV + 2.0 * reg * scale_v * p.V)
    return LogisticParams(_project_columns(V, radius), _project_columns(W, radius), p.lam)


def _project_columns(m: np.ndarray, radius: float) -> np.ndarray:
    if m.size == 0:
        return m
    norms = np.sqrt((m * m).sum(axis=0))
    factor = np.where(norms > radius, radius / np.where(norms > 0, norms, 1.0), 1.0)
    return m * factor[None, :]
