"""The detector as a Spark ML estimator: pipelines, persistence, grids."""

import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mixdetect import Detector
from mixdetect.plans.ml import MixedDetector, MixedDetectorModel
from mixdetect.sources import MIXED_ORDERS_SPEC, mixed_orders
from mixdetect.spec import DetectorParams

SMALL = {"subspace_dimension": 2, "logistic_lambda": 0.1, "gaussian_num": 3, "max_iterations": 4, "em_max_iter": 3, "kmeans_max_iter": 3}


def _estimator(**params):
    return MixedDetector(**{"labelCol": "label", "catCols": ["c0", "c1", "c2"], "contCols": ["x0", "x1"], **SMALL, **params})


def _scores(df):
    return sorted(tuple(r) for r in df.select("row_id", "score", "is_anomaly", "rawPrediction", "prediction").collect())


def test_equals_the_detector(spark):
    df = mixed_orders(spark, SF_SMALL)
    got = _estimator().fit(df).transform(df)
    want = Detector(MIXED_ORDERS_SPEC, DetectorParams(**SMALL)).fit(df).predict(df)
    want = want.select("row_id", "score", "is_anomaly", (-F.col("score")).alias("rawPrediction"), F.col("prediction").cast("double"))
    assert _scores(got) == _scores(want)


def test_every_hyper_parameter_is_a_param(spark):
    est = _estimator(tail="high", threshold_exact=False)
    assert est.hyper_parameters() == DetectorParams(**SMALL, tail="high", threshold_exact=False)
    assert {p.name for p in est.params} >= set(DetectorParams.param_names())
    with pytest.raises(TypeError):
        est.setParams(gaussian_num="many")


def test_pipeline_saves_and_loads(spark):
    df = mixed_orders(spark, SF_SMALL)
    pipeline = Pipeline(stages=[SQLTransformer(statement="SELECT *, x0 * 2 AS x2 FROM __THIS__"), _estimator(contCols=["x0", "x2"])])
    folder = tempfile.mkdtemp(prefix="mixdetect-ml-")
    pipeline.write().overwrite().save(f"{folder}/pipeline")
    fitted = Pipeline.load(f"{folder}/pipeline").fit(df)
    fitted.write().overwrite().save(f"{folder}/model")
    back = PipelineModel.load(f"{folder}/model")
    assert isinstance(back.stages[1], MixedDetectorModel) and back.stages[1].uid == fitted.stages[1].uid
    assert back.stages[1].hyper_parameters() == fitted.stages[1].hyper_parameters() == DetectorParams(**SMALL)
    assert _scores(back.transform(df)) == _scores(fitted.transform(df))


def test_a_grid_runs_in_a_cross_validator(spark):
    df = mixed_orders(spark, SF_SMALL)
    est = _estimator()
    grid = ParamGridBuilder().addGrid(est.gaussian_num, [1, 3]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=2, seed=7)
    best = cv.fit(df)
    assert len(best.avgMetrics) == 2 and all(0.0 <= m <= 1.0 for m in best.avgMetrics)
    assert best.bestModel.model.gmm.K == [1, 3][max(range(2), key=lambda i: best.avgMetrics[i])]


def test_without_label_and_with_other_output_names(spark):
    df = mixed_orders(spark, SF_SMALL).drop("label")
    est = MixedDetector(catCols=["c0", "c1", "c2"], contCols=["x0", "x1"], rawPredictionCol="raw", predictionCol="odd", **SMALL)
    out = est.fit(df).transform(df)
    assert {"raw", "odd"} <= set(out.columns) and out.where("odd = 1.0").count() == 150
