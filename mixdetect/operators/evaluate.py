"""Ranking quality and fold splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STREAM_FOLD, full_hash, row_hash
from .order_stats import auc_frame, checkpointed_positions

__all__ = ["assigned_folds", "auc_frame", "auc_evaluator", "fold_assignment", "hash_folds", "kfold_long"]


def auc_evaluator(df: DataFrame, score: str, label: str = "label") -> float:
    """Spark ML's evaluator (exact with numBins=0): a cross-check of auc_frame."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    t = df.select(F.col(score).cast("double").alias("raw"), F.col(label).cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0)
    return ev.evaluate(t)


def fold_assignment(df: DataFrame, k: int, shuffle: bool = False, seed: int = 42, hash_kind: str = "xxhash",
                    row_id: str = "row_id", n: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Adds ``fold``: test fold of each row, like scikit-learn's KFold.

    Contiguous folds by ``row_id`` order (or by a seeded hash order when
    ``shuffle``); the first ``n mod k`` folds hold one extra row.  Where the
    exact sizes do not matter, :func:`hash_folds` needs no shuffle.
    """
    return assigned_folds(df, k, shuffle, seed, hash_kind, row_id, n, n_buckets)[0]


def hash_folds(df: DataFrame, k: int, seed: int = 42, hash_kind: str = "xxhash", row_id: str = "row_id") -> DataFrame:
    """Adds ``fold`` = seeded row hash mod k: a projection, with folds of nearly equal size."""
    return df.withColumn("fold", (row_hash(hash_kind, F.col(row_id), 0, seed, STREAM_FOLD) % k).cast("int"))


def assigned_folds(df: DataFrame, k: int, shuffle: bool = False, seed: int = 42, hash_kind: str = "xxhash",
                   row_id: str = "row_id", n: int | None = None, n_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`fold_assignment` and the checkpointed frame under it."""
    if k < 2:
        raise ValueError("k must be at least 2")
    if shuffle:
        # production: the full 64-bit hash (no ties at any size); modular: the SQL-portable one
        h = (full_hash(F.col(row_id), 0, seed, STREAM_FOLD) if hash_kind == "xxhash"
             else row_hash(hash_kind, F.col(row_id), 0, seed, STREAM_FOLD))
        t = df.withColumn("__h", h)
        order = ["__h", row_id]
    else:
        t = df
        order = [row_id]
    t, n, checkpoint = checkpointed_positions(t, order, n=n, n_buckets=n_buckets, out="__pos")
    if n < k:
        raise ValueError(f"{k} folds need at least {k} rows, the input has {n}")
    q, r = divmod(n, k)
    pos = F.col("__pos")
    big = r * (q + 1)
    fold = F.when(pos < big, F.floor(pos / (q + 1))).otherwise(F.lit(r) + F.floor((pos - big) / q)).cast("int")
    out = t.withColumn("fold", fold).drop("__pos")
    return (out.drop("__h") if shuffle else out), checkpoint


def kfold_long(assigned: DataFrame, k: int, normal_only: bool = False, row_id: str = "row_id",
               label: str = "label") -> DataFrame:
    """(fold, split, row_id): every fold's train and test rows.

    ``normal_only`` drops label-1 rows from the train side only.
    """
    t = assigned.select(row_id, label, "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    split = F.when(F.col("fold") == F.col("f"), F.lit("test")).otherwise(F.lit("train"))
    t = t.select(F.col("f").alias("fold"), split.alias("split"), row_id, label)
    if normal_only:
        t = t.where(~((F.col("split") == "train") & F.coalesce(F.col(label) == 1, F.lit(False))))
    return t.select("fold", "split", row_id)
