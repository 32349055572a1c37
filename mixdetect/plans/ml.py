"""The detector as a ``pyspark.ml`` Estimator: pipelines, grids, cross-validation, ML persistence.

``MixedDetector`` carries the column roles and every hyper-parameter of
:class:`DetectorParams` as ML ``Param`` s; ``fit`` runs :class:`Detector` and
``MixedDetectorModel.transform`` is the same projection as
``DetectorModel.transform``, plus a raw prediction that is larger for more
anomalous rows, as ML's binary evaluators rank them.
"""

from __future__ import annotations

import dataclasses

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DetectorParams, MixedSpec
from .detector import Detector, DetectorModel

_CONVERTERS = {"int": TypeConverters.toInt, "float": TypeConverters.toFloat, "str": TypeConverters.toString, "bool": TypeConverters.toBoolean}
_HYPER = tuple(dataclasses.fields(DetectorParams))


class _DetectorParams(Params):
    """Column roles and hyper-parameters, shared by the estimator and its model."""

    rowIdCol = Param(Params._dummy(), "rowIdCol", "column of row ids", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column, empty for none", TypeConverters.toString)
    catCols = Param(Params._dummy(), "catCols", "columns of category codes", TypeConverters.toListString)
    contCols = Param(Params._dummy(), "contCols", "continuous columns", TypeConverters.toListString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "output column that ranks rows by anomaly", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column of 0.0 and 1.0", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(rowIdCol="row_id", labelCol="", catCols=[], contCols=[], rawPredictionCol="rawPrediction", predictionCol="prediction",
                         **DetectorParams().as_dict())

    def spec(self) -> MixedSpec:
        return MixedSpec(row_id=self.getOrDefault("rowIdCol"), label=self.getOrDefault("labelCol") or None,
                         cat_cols=tuple(self.getOrDefault("catCols")), cont_cols=tuple(self.getOrDefault("contCols")))

    def hyper_parameters(self) -> DetectorParams:
        return DetectorParams(**{f.name: self.getOrDefault(f.name) for f in _HYPER})


# one Param for each hyper-parameter, under its own name
for _f in _HYPER:
    setattr(_DetectorParams, _f.name, Param(Params._dummy(), _f.name, f"{_f.name} of the detector", _CONVERTERS[_f.type]))


class _EstimatorWriter(MLWriter):
    """The Params alone: an estimator has nothing else."""

    def __init__(self, instance: "MixedDetector"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)


class _ModelWriter(MLWriter):
    """ML metadata beside the model's own Parquet tables."""

    def __init__(self, instance: "MixedDetectorModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.model.save(self.sparkSession, f"{path}/model")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        if isinstance(instance, MixedDetectorModel):
            instance.model = DetectorModel.load(self.sparkSession, f"{path}/model")
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class MixedDetector(Estimator, _DetectorParams, MLReadable, MLWritable):
    """``MixedDetector(catCols=[..], contCols=[..], gaussian_num=3, ..).fit(df)``.

    Rows are never changed or dropped; null, NaN or infinite features and codes
    that are none raise the detector's own validation errors.
    """

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def setParams(self, **params) -> "MixedDetector":
        return self._set(**params)

    def _fit(self, dataset: DataFrame) -> "MixedDetectorModel":
        model = MixedDetectorModel(Detector(self.spec(), self.hyper_parameters()).fit(dataset))
        model._resetUid(self.uid)  # as ML's own models do
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return _EstimatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class MixedDetectorModel(Model, _DetectorParams, MLReadable, MLWritable):
    """A fitted detector as an ML transformer; ``model`` is the :class:`DetectorModel`.

    Adds log_p_cont, log_p_cat, score and is_anomaly, the raw prediction (the
    score, negated where low scores are the anomalous ones) and the prediction
    (1.0 for an anomaly; null where the score is).
    """

    def __init__(self, model: DetectorModel | None = None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = -F.col("score") if self.model.params.tail == "low" else F.col("score")
        return self.model.transform(dataset).withColumns({self.getOrDefault("rawPredictionCol"): raw,
                                                          self.getOrDefault("predictionCol"): F.col("is_anomaly").cast("double")})

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
