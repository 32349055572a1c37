"""File sources (CSV, libsvm) and scoring on a Structured Streaming frame."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mixdetect.operators.encode import profile, slot_layout
from mixdetect.plans.detector import DetectorModel
from mixdetect.sources import (MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, mixed_events, mixed_orders, read_libsvm,
                               read_positional_csv, write_libsvm)
from mixdetect.sources.fixtures import mixed_events_from
from mixdetect.spec import DetectorParams, given_gmm, given_logistic
from mixdetect.streaming import score_stream, start_scoring_query


def _positional(df):
    """label first, then features named by position: categorical, then continuous."""
    cols = [F.col("label")] + [F.col(c).alias(str(i)) for i, c in enumerate(["c0", "c1", "c2", "x0", "x1"])]
    return df.select(*cols)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.mark.parametrize("explicit_schema", [True, False])
def test_csv_scan_positional(spark, explicit_schema):
    src = mixed_orders(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="mixdetect-csv-")
    _positional(src).write.mode("overwrite").option("header", True).csv(path)
    df, spec = read_positional_csv(spark, path, first_continuous=3, n_features=5 if explicit_schema else None)
    assert spec.cat_cols == ("c0", "c1", "c2") and spec.cont_cols == ("x0", "x1")
    cols = ["label", "c0", "c1", "c2", "x0", "x1"]
    assert _rows(df, cols) == _rows(src, cols)
    assert df.select("row_id").distinct().count() == src.count()


def test_libsvm_roundtrip(spark):
    src = mixed_orders(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="mixdetect-libsvm-")
    write_libsvm(src, MIXED_ORDERS_SPEC, path)
    df, spec = read_libsvm(spark, path, n_features=5, first_continuous=3)
    cols = ["label", "c0", "c1", "c2", "x0", "x1"]
    assert _rows(df, cols) == _rows(src, cols)


def test_one_hot_encoder_widths_match_layout(spark):
    from pyspark.ml.feature import OneHotEncoder

    df = mixed_orders(spark, SF_SMALL)
    layout = slot_layout(profile(df, MIXED_ORDERS_SPEC), MIXED_ORDERS_SPEC)
    enc = OneHotEncoder(inputCols=list(layout.cat_cols), outputCols=[c + "_v" for c in layout.cat_cols],
                        handleInvalid="keep").fit(df)
    assert tuple(enc.categorySizes) == layout.widths


def test_stream_scoring_equals_batch(spark):
    df = mixed_events(spark, SF_SMALL)
    spec = MIXED_EVENTS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    model = DetectorModel(spec, layout, given_logistic(2, 3, layout.n_slots, 0.1), given_gmm(3, 3),
                          DetectorParams(), threshold=-3.0)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(SF_SMALL))
    assert score_stream(model, mixed_events_from(stream)).isStreaming
    q = start_scoring_query(model, mixed_events_from(stream), "memory", "scored_events_test")
    q.awaitTermination(120)
    got = spark.sql("SELECT row_id, score, is_anomaly FROM scored_events_test")
    want = model.transform(df).select("row_id", "score", "is_anomaly")
    assert got.count() == want.count() == df.count()
    assert sorted(got.collect()) == sorted(want.collect())


def test_model_save_load_roundtrip(spark):
    from mixdetect import Detector
    from mixdetect.plans.detector import DetectorModel

    df = mixed_orders(spark, SF_SMALL)
    p = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, gaussian_num=3, max_iterations=5, em_max_iter=3,
                       kmeans_max_iter=3)
    model = Detector(MIXED_ORDERS_SPEC, p).fit(df)
    path = tempfile.mkdtemp(prefix="mixdetect-model-")
    model.save(spark, path)
    back = DetectorModel.load(spark, path)
    assert back.threshold == model.threshold and back.params == model.params and back.spec == model.spec
    a = sorted(model.transform(df).select("row_id", "score", "is_anomaly").collect())
    b = sorted(back.transform(df).select("row_id", "score", "is_anomaly").collect())
    assert a == b


def test_anomaly_sink_writes_exactly_the_flagged_rows(spark):
    import uuid

    from mixdetect.streaming import start_anomaly_sink

    df = mixed_events(spark, SF_SMALL)
    spec = MIXED_EVENTS_SPEC
    layout = slot_layout(profile(df, spec), spec)
    model = DetectorModel(spec, layout, given_logistic(2, 3, layout.n_slots, 0.1), given_gmm(3, 3),
                          DetectorParams(), threshold=-3.0)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL))
    out = tempfile.mkdtemp(prefix="mixdetect-sink-")
    q = start_anomaly_sink(model, mixed_events_from(stream), out, f"sink_{uuid.uuid4().hex[:8]}")
    q.awaitTermination(120)
    got = spark.read.parquet(out).select("row_id", "score")
    want = model.transform(df).where("is_anomaly").select("row_id", "score")
    assert want.count() > 0
    assert sorted(got.collect()) == sorted(want.collect())


def test_fit_and_evaluate_positional_csv(spark):
    from mixdetect.plans.csv_job import fit_and_evaluate

    path = tempfile.mkdtemp(prefix="mixdetect-csvjob-")
    _positional(mixed_orders(spark, SF_SMALL)).write.mode("overwrite").option("header", True).csv(path)
    p = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, gaussian_num=3, max_iterations=6, em_max_iter=5,
                       kmeans_max_iter=3, anomaly_ratio=0.2)
    model, scored, auc = fit_and_evaluate(spark, path, first_continuous=3, params=p)
    assert scored.where("is_anomaly").count() == int(1500 * 0.2)
    row = auc.first()
    assert 0.0 <= row["auc"] <= 1.0 and row["n_pos"] == 75 and row["n_neg"] == 1425
