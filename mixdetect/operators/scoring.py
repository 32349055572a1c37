"""Combined score, threshold, flags and probabilities.

Scoring is a stateless projection (works on streaming frames too).  The
threshold is an exact order statistic computed without a global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import kth_largest, kth_smallest


def combined_score(log_p_cont: Column, log_p_cat: Column, mode: str) -> Column:
    """joint: log p(x) + log P(y|x);  product: log P(y|x) * log p(x) (original)."""
    if mode == "joint":
        return log_p_cont + log_p_cat
    if mode == "product":
        return log_p_cat * log_p_cont
    raise ValueError(f"mode must be 'joint' or 'product', not {mode!r}")


def target_size(n: int, ratio: float) -> int:
    return max(1, int(n * ratio))


def threshold(scored: DataFrame, n: int, ratio: float, order: str = "score", tail: str = "low",
              score: str = "score", label: str | None = "label", exact: bool = True,
              accuracy: int = 10_000) -> float | None:
    """Score of the k-th row, k = max(1, int(n * ratio)).

    order="score", tail="low": k-th smallest score (default; low density = anomalous).
    order="score", tail="high": k-th largest score.
    order="label_score": k-th row of the descending (label, score) order, the
    original behaviour (labels sort first).
    exact=False: one ``percentile_approx`` pass instead (rank error <= n/accuracy).
    """
    k = target_size(n, ratio)
    if not exact:
        if order != "score":
            raise ValueError("the approximate threshold supports order='score' only")
        q = k / n if tail == "low" else (n - k + 1) / n
        row = scored.agg(F.percentile_approx(F.col(score), float(min(1.0, q)), accuracy).alias("t")).first()
        return None if row is None or row["t"] is None else float(row["t"])
    if order == "score":
        if tail == "low":
            return kth_smallest(scored, score, k, n)
        if tail == "high":
            return kth_largest(scored, score, k, n)
        raise ValueError(f"tail must be 'low' or 'high', not {tail!r}")
    if order == "label_score":
        if label is None:
            raise ValueError("order='label_score' needs a label column")
        # labels are numeric class codes; rows without one come last
        lab = F.col(label).cast("double")
        known = scored.agg(F.count(lab).alias("n")).first()["n"]
        if k > known:
            return kth_largest(scored.where(F.col(label).isNull()), score, k - known)
        code = kth_largest(scored, lab, k)
        above = scored.agg(F.sum(F.when(lab > F.lit(code), 1).otherwise(0)).alias("n")).first()["n"]
        return kth_largest(scored.where(lab == F.lit(code)), score, k - above)
    raise ValueError(f"order must be 'score' or 'label_score', not {order!r}")


def flag_expr(score: Column, thr: float | None, tail: str = "low") -> Column:
    """low tail: score <= threshold; high tail (original): score < threshold.

    A NaN score, which Spark orders above all numbers, is never flagged; nor is anything against a NaN threshold.
    """
    if thr is None or math.isnan(thr):
        return F.lit(False)
    below = score <= F.lit(float(thr)) if tail == "low" else score < F.lit(float(thr))
    return below & ~F.isnan(score)


def score_range(scored: DataFrame, score: str = "score") -> tuple[float | None, float | None]:
    row = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    return row["lo"], row["hi"]


def interpolate_expr(score: Column, lo: float | None, hi: float | None) -> Column:
    """(v - min)/(max - min); null when the range is empty or zero."""
    if lo is None or hi is None or hi == lo:
        return F.lit(None).cast("double")
    return (score - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def with_proba(scored: DataFrame, lo: float | None, hi: float | None, score: str = "score") -> DataFrame:
    t = interpolate_expr(F.col(score), lo, hi)
    return scored.select("*", t.alias("p0"), (F.lit(1.0) - t).alias("p1"))


def top_k(scored: DataFrame, k: int, score: str = "score", row_id: str = "row_id",
          ascending: bool = True) -> DataFrame:
    """The k most anomalous rows (a report: k is small, TakeOrderedAndProject)."""
    s = F.col(score).asc() if ascending else F.col(score).desc()
    return scored.orderBy(s, F.col(row_id).asc()).limit(int(k))
