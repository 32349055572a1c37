"""Cross-validated evaluation: folds -> one fit of all folds' models -> AUC on the held-out rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import assigned_folds
from ..operators.gmm import feature_input, matrix, mixture_logpdf, row_loglik
from ..operators.logistic import row_cat_loglik
from ..operators.order_stats import ROWS_PER_BUCKET, auc_frame
from ..operators.scoring import combined_score
from ..spec import DetectorParams, MixedSpec
from .detector import Detector, DetectorModel
from .session import delete_checkpoint, local_parallelism

#: Rows from which the numbered folds are dealt to a further task; up to three tasks a core.
ROWS_PER_FOLD_TASK = 100_000


def held_out_scores(folds: DataFrame, models: list[DetectorModel], fold: str = "fold") -> DataFrame:
    """(fold, label, score): every row scored by the model of its fold, in one projection with the parameters by reference."""
    spec, mode = models[0].spec, models[0].params.mode
    kept = [(m.gmm, m.logistic, m.layout) for m in models]
    d, n_cats = spec.d, len(spec.cat_cols)

    @F.pandas_udf("cont double, cat double")
    def logs(features: pd.Series, codes: pd.Series, of: pd.Series) -> pd.DataFrame:
        X, C, at = matrix(features, d), matrix(codes, n_cats), of.to_numpy()
        out = np.zeros((len(X), 2))
        for f in np.unique(at):
            gmm, logistic, layout = kept[int(f)]
            rows = at == f
            if gmm is not None:
                out[rows, 0] = row_loglik(mixture_logpdf(X[rows], gmm))
            out[rows, 1] = row_cat_loglik(X[rows], C[rows], logistic, layout)
        return pd.DataFrame(out, columns=["cont", "cat"])

    codes = F.array(*[F.col(c).cast("double") for c in spec.cat_cols]).cast("array<double>")
    features = feature_input(spec)[0].cast("array<double>")
    t = folds.select(F.col(fold).alias("fold"), F.col(spec.label).alias("label"), logs(features, codes, F.col(fold)).alias("l"))
    return t.select("fold", "label", combined_score(F.col("l.cont"), F.col("l.cat"), mode).alias("score"))


def auc_by_fold(scored: DataFrame, k: int, n: int, digits: int | None = None) -> DataFrame:
    """(fold, auc, n_pos, n_neg) with AUC of -score; ties count one half, rows without score or label are not ranked."""
    spark = scored.sparkSession
    if n > ROWS_PER_BUCKET:
        rows = [(f, *auc_frame(scored.where(F.col("fold") == f), -F.col("score"), "label", digits=digits).first()) for f in range(k)]
        return spark.createDataFrame(rows, "fold int, auc double, n_pos long, n_neg long")
    s = -F.col("score") if digits is None else F.round(-F.col("score"), digits) + F.lit(0.0)
    y = F.col("label")
    g = scored.select("fold", s.alias("s"), "label").groupBy("fold", "s").agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("neg"))
    g = g.where(F.col("s").isNotNull() & ~F.isnan("s"))
    below = F.sum("neg").over(Window.partitionBy("fold").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg")
    sums = g.select("fold", "pos", "neg", (F.col("pos") * (below + 0.5 * F.col("neg"))).alias("c")).groupBy("fold").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("c").alias("c"))
    found = {r["fold"]: r for r in sums.collect()}  # one row a fold
    rows = []
    for f in range(k):
        pos, neg, c = (found[f]["n_pos"], found[f]["n_neg"], found[f]["c"]) if f in found else (None, None, 0.0)
        rows.append((f, c / (float(pos) * float(neg)) if pos and neg else None, pos, neg))
    return spark.createDataFrame(rows, "fold int, auc double, n_pos long, n_neg long")


def cross_validate(df: DataFrame, spec: MixedSpec, params: DetectorParams, k: int, shuffle: bool = False,
                   normal_only: bool = False, digits: int | None = None) -> DataFrame:
    """(fold, auc, n_pos, n_neg) with AUC of -score (low density = anomaly);
    ``digits`` rounds the scores before ranking.

    One fit serves the models of all folds (``Detector.fit_folds``).  Only the
    columns of ``spec`` go through the range shuffle of the folds; its
    checkpoint, if there is one, is deleted at the end.
    """
    keep = spec.key_cols() + list(spec.cat_cols) + ([spec.cont_array] if spec.cont_array else list(spec.cont_cols))
    kept = df.select(*dict.fromkeys(keep))
    n = kept.count()
    folds, checkpoint = assigned_folds(kept, k, shuffle=shuffle, seed=params.seed, hash_kind=params.hash_kind, row_id=spec.row_id, n=n)
    # numbering leaves few partitions (one, of up to ROWS_PER_BUCKET rows); the fits need more tasks than that
    tasks = min(math.ceil(n / ROWS_PER_FOLD_TASK), 3 * (local_parallelism(df.sparkSession) or 8))
    folds = (folds.repartition(tasks) if tasks > math.ceil(n / ROWS_PER_BUCKET) else folds).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = folds.where(F.coalesce(F.col(spec.label) != 1, F.lit(True))) if normal_only else folds
        models = Detector(spec, params).fit_folds(train, k)
        return auc_by_fold(held_out_scores(folds, models), k, n, digits)
    finally:
        folds.unpersist()
        delete_checkpoint(checkpoint)
