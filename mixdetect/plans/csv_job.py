"""The original entry point as one call: positional CSV -> fit -> scores -> AUC."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order_stats import auc_frame
from ..sources.files import read_positional_csv
from ..sources.rejects import read_csv_with_rejects
from ..spec import DetectorParams
from .detector import Detector, DetectorModel


def fit_and_evaluate(spark: SparkSession, path: str, first_continuous: int, params: DetectorParams,
                     n_features: int | None = None, rejects_path: str | None = None) -> tuple[DetectorModel, DataFrame, DataFrame]:
    """Load a CSV whose first column is the label (categorical columns first),
    fit the detector, score every row and rank them by anomaly.

    Returns (model, scored rows with ``is_anomaly``, one-row AUC).  Anomalies
    are ranked by a low score where the threshold takes the low tail, and by
    the raw score where it takes the high one, like the original.  The parsed
    CSV is cached for the fit and the AUC; the returned rows read the file.
    With ``rejects_path`` (and ``n_features``) malformed lines do not stop the
    fit: they are written there as JSON lines, with their reasons.
    """
    if rejects_path is not None:
        if n_features is None:
            raise ValueError("rejects_path needs n_features: a line is judged by the number of its fields")
        df, rejects, spec = read_csv_with_rejects(spark, path, first_continuous, n_features)
        rejects.write.mode("overwrite").json(rejects_path)
    else:
        df, spec = read_positional_csv(spark, path, first_continuous, n_features=n_features)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = Detector(spec, params).fit(cached)
        rank = -F.col("score") if params.tail == "low" else F.col("score")
        auc = auc_frame(model.score(cached), rank, spec.label)
    finally:
        cached.unpersist()
    return model, model.transform(df), auc
