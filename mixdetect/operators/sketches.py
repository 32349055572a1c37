"""Threshold and score range that follow a growing table.

The exact threshold (:mod:`.order_stats`) reads all scores.  Where a table
grows by batches, each batch leaves one KLL sketch of its scores, a few
kilobytes in a Parquet folder; the merged sketches answer the threshold and
the range of the whole table without reading any old row again.

The sketch is approximate, with a rank error of ``rank_error(k)`` of all rows
at 99 % confidence, whatever their number; minimum and maximum are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import delete_folder
from .scoring import target_size

SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Normalized rank error of a quantile at 99 % confidence (fixed values: the sketch library's published fit)."""
    return 2.296 / k ** 0.9723


def score_sketch(scored: DataFrame, score: str = "score", by: list[str] | tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """(by.., n, n_left_out, lo, hi, sketch): one row a group, with map-side partial sketches.

    Null and NaN scores cannot be ranked: they are left out and counted.  A
    group without any other score has n = 0 and a null sketch.
    """
    s = F.col(score).cast("double")
    known = F.when(~F.isnan(s), s)
    t = scored.select(*by, known.alias("__s"))
    aggs = [F.count("__s").alias("n"), (F.count(F.lit(1)) - F.count("__s")).alias("n_left_out"), F.min("__s").alias("lo"), F.max("__s").alias("hi"),
            F.kll_sketch_agg_double("__s", k).alias("sketch")]
    out = t.groupBy(*by).agg(*aggs) if by else t.agg(*aggs)
    return out.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged(sketches: DataFrame, by: list[str] | tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """The sketches of the unions of the groups: same columns as :func:`score_sketch`."""
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_left_out"), F.lit(0)).alias("n_left_out"), F.min("lo").alias("lo"),
            F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", k).alias("sketch")]
    out = sketches.groupBy(*by).agg(*aggs) if by else sketches.agg(*aggs)
    return out.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


@dataclass(frozen=True)
class WholeSketch:
    """A merged sketch on the driver: some tens of kilobytes, whatever the table's size."""

    n: int
    n_left_out: int
    lo: float | None
    hi: float | None
    sketch: bytes | None

    def target(self, ratio: float, tail: str = "low") -> int:
        """Rank of the threshold, counted from 1 by ascending score."""
        if tail not in ("low", "high"):
            raise ValueError(f"tail must be 'low' or 'high', not {tail!r}")
        k = target_size(self.n, ratio)
        return k if tail == "low" else self.n - k + 1

    def threshold(self, spark: SparkSession, ratio: float, tail: str = "low") -> float | None:
        """The ``target_size``-th smallest (low tail) or largest (high tail) score; None without scores."""
        rank = self.target(ratio, tail)
        if self.sketch is None or self.n == 0:
            return None
        t = spark.createDataFrame([(bytearray(self.sketch),)], "sketch binary")
        share = min(1.0, max(0.0, rank / self.n))
        return float(t.select(F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("q")).first()["q"])


def whole_sketch(sketches: DataFrame, k: int = SKETCH_K) -> WholeSketch:
    """The sketch of all rows of a frame of :func:`score_sketch`."""
    row = merged(sketches, k=k).first()
    return WholeSketch(int(row["n"]), int(row["n_left_out"]), row["lo"], row["hi"], bytes(row["sketch"]) if row["sketch"] is not None else None)


class ScoreSketches:
    """The sketches of a growing table in a shared folder, one sub-folder a batch.

    ``add`` overwrites its batch's folder, so a retried batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = SKETCH_K):
        self.spark, self.path, self.k = spark, path.rstrip("/"), k

    def add(self, scored: DataFrame, batch: str | int, score: str = "score") -> None:
        score_sketch(scored, score, k=self.k).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def frame(self) -> DataFrame:
        return self.spark.read.schema("n long, n_left_out long, lo double, hi double, sketch binary, batch string").parquet(self.path)

    def remove(self, batch: str | int) -> None:
        """Forget a batch, as when its rows are deleted or rewritten."""
        delete_folder(self.spark, f"{self.path}/batch={batch}")

    def whole(self) -> WholeSketch:
        """The sketch of all batches so far."""
        return whole_sketch(self.frame(), self.k)

    def follow(self, model):
        """Sets a model's threshold and score range from the batches so far; returns the model."""
        whole = self.whole()
        model.threshold = whole.threshold(self.spark, model.params.anomaly_ratio, model.params.tail)
        model.score_min, model.score_max, model.n_train = whole.lo, whole.hi, whole.n
        return model


def rank_report(scored: DataFrame, whole: WholeSketch, ratio: float, tail: str = "low", score: str = "score") -> DataFrame:
    """How far a sketch's threshold is from the exact rank: (n, target, rank_below, rank_up_to, error, lo, hi).

    ``rank_below`` scores are below the threshold and ``rank_up_to`` are not
    above it; ``error`` is the distance of the target rank to that range, as a
    share of n, so ties cost nothing.
    """
    at, target = whole.threshold(scored.sparkSession, ratio, tail), whole.target(ratio, tail)
    s = F.col(score).cast("double")
    # a NaN is above every number and a null is not counted
    counts = scored.agg(F.count_if(s < F.lit(at)).alias("rank_below"), F.count_if(s <= F.lit(at)).alias("rank_up_to"))
    off = F.greatest(F.lit(0), F.col("rank_below") + 1 - target, F.lit(target) - F.col("rank_up_to"))
    return counts.select(F.lit(whole.n).cast("long").alias("n"), F.lit(target).cast("long").alias("target"), "rank_below", "rank_up_to",
                         (off / F.lit(max(whole.n, 1))).alias("error"),
                         F.lit(whole.lo).cast("double").alias("lo"), F.lit(whole.hi).cast("double").alias("hi"))
