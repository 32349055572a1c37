"""Quality counts on the scoring pass, rejects, score sketches and SQL functions of a model."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mixdetect.operators.encode import profile, slot_layout
from mixdetect.operators.quality import with_issues
from mixdetect.operators.scoring import threshold
from mixdetect.operators.sketches import ScoreSketches, rank_error, rank_report, score_sketch, whole_sketch
from mixdetect.plans.detector import DetectorModel
from mixdetect.plans.sql_function import register_score_functions
from mixdetect.sources import MIXED_EVENTS_SPEC, MIXED_ORDERS_SPEC, mixed_events, mixed_orders, read_csv_with_rejects, read_libsvm_with_rejects
from mixdetect.sources.fixtures import mixed_events_from
from mixdetect.spec import DetectorParams, MixedSpec, given_gmm, given_logistic


def _model(df, spec, thr=-3.0, **params):
    layout = slot_layout(profile(df, spec), spec)
    return DetectorModel(spec, layout, given_logistic(2, spec.d, layout.n_slots, 0.1), given_gmm(3, spec.d), DetectorParams(**params), threshold=thr)


def _dirty_events(df):
    return df.withColumns({"x0": F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("x0")),
                           "x2": F.when(F.col("row_id") % 11 == 0, float("nan")).otherwise(F.col("x2")),
                           "c0": F.when(F.col("row_id") % 13 == 0, 99).otherwise(F.col("c0"))})


def _counted_again(scored, model):
    """The same counts by a pass of their own, over the issues of each row."""
    t = with_issues(scored, model.spec, model.layout)
    out = {r["i"]: r["count"] for r in t.select(F.explode("issues").alias("i")).groupBy("i").count().collect()}
    out |= {"n_rows": t.count(), "n_dirty": t.where(F.size("issues") > 0).count(), "null_scores": t.where("score IS NULL").count(),
            "nan_scores": t.where("isnan(score)").count(), "n_flagged": t.where("is_anomaly").count()}
    return out


def test_observed_counts_equal_a_second_pass(spark):
    df = mixed_events(spark, SF_SMALL)
    model = _model(df, MIXED_EVENTS_SPEC)
    scored, counts = model.transform_observed(_dirty_events(df))
    assert scored.columns == model.transform(df).columns
    scored.write.format("noop").mode("overwrite").save()
    want = _counted_again(model.transform(_dirty_events(df)), model)
    assert {k: v for k, v in counts.get.items() if v} == {k: v for k, v in want.items() if v}
    assert want["null_x0"] > 0 and want["unseen_c0"] > 0 and want["n_flagged"] > 0


def test_observed_counts_of_an_empty_table_and_an_array(spark):
    df = mixed_events(spark, SF_SMALL)
    scored, counts = _model(df, MIXED_EVENTS_SPEC).transform_observed(df.where("false"))
    scored.write.format("noop").mode("overwrite").save()
    assert set(counts.get.values()) == {0}
    spec = MixedSpec(label=None, cont_array="v", cont_dim=2)
    rows = [(1, [0.1, 0.2]), (2, [0.1, None]), (3, None), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [0.1])]
    arrays = spark.createDataFrame(rows, "row_id long, v array<double>")
    got = {r["row_id"]: r["issues"] for r in with_issues(arrays, spec, slot_layout(profile(arrays.limit(1), spec), spec)).collect()}
    assert got == {1: [], 2: ["null_v"], 3: ["null_v"], 4: ["nan_v"], 5: ["inf_v"], 6: ["bad_v"]}


def test_stream_counts_reach_the_listener(spark):
    from mixdetect.streaming import QualityListener, score_stream_observed

    df = mixed_events(spark, SF_SMALL)
    model = _model(df, MIXED_EVENTS_SPEC)
    alerts = []
    listener = QualityListener(max_dirty=0.01, alert=lambda batch, counts: alerts.append((batch, counts["n_dirty"])))
    spark.streams.addListener(listener)
    try:
        schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
        scored = score_stream_observed(model, _dirty_events(mixed_events_from(stream)))
        q = (scored.writeStream.format("noop").option("checkpointLocation", tempfile.mkdtemp(prefix="mixdetect-q-"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        run = str(q.runId)
        for _ in range(100):  # progress events arrive on a thread of their own
            if listener.totals(run):
                break
            import time
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    want = _counted_again(model.transform(_dirty_events(df)), model)
    assert {k: v for k, v in listener.totals(run).items() if v} == {k: v for k, v in want.items() if v}
    assert sum(n for _, n in alerts) == want["n_dirty"]


def _file(text):
    path = f"{tempfile.mkdtemp(prefix='mixdetect-rejects-')}/in.txt"
    with open(path, "w") as out:
        out.write(text)
    return path


def test_csv_rejects_keep_line_and_reasons(spark):
    path = _file('label,0,1,2\n1,0,0.5,2\n0,x,0.5,\n\n0,-1,NaN,1\n0,1,1\n0,1,1,2,3\n,1,Infinity,0\n"a,b",1,1,1\n2,3, 5.5 ,6e3\n1,0,0.5,2\n')
    clean, rejects, spec = read_csv_with_rejects(spark, path, 1, 3)
    assert spec.cat_cols == ("c0",) and spec.cont_cols == ("x0", "x1")
    assert sorted(clean.select("label", "c0", "x0", "x1").collect()) == [(1.0, 0.0, 0.5, 2.0), (1.0, 0.0, 0.5, 2.0), (2.0, 3.0, 5.5, 6000.0)]
    got = {r["line"]: r["reasons"] for r in rejects.collect()}
    assert got == {"0,x,0.5,": ["0: not a number", "2: empty"], "0,-1,NaN,1": ["0: not a code", "1: not finite"],
                   "0,1,1": ["wrong number of fields"], "0,1,1,2,3": ["wrong number of fields"],
                   ",1,Infinity,0": ["label: empty", "1: not finite"], '"a,b",1,1,1': ["label: not a number"]}
    # the verdicts do not hang on the columns that are read
    assert clean.count() == 3 and rejects.count() == 6 and clean.select("x0").distinct().count() == 2
    assert all(r["file"].endswith("in.txt") for r in rejects.select("file").collect())


def test_csv_rejects_ids_empty_file_and_header(spark):
    path = _file("id,label,0,1\n9007199254740993,1,0,0.5\n1.5,1,0,0.5\n")
    clean, rejects, _ = read_csv_with_rejects(spark, path, 1, 2, id_col="id")
    assert [tuple(r) for r in clean.select("row_id", "label", "c0", "x0").collect()] == [(9007199254740993, 1.0, 0.0, 0.5)]
    assert [r["reasons"] for r in rejects.collect()] == [["id: not a whole number"]]
    clean, rejects, _ = read_csv_with_rejects(spark, _file(""), 1, 2)
    assert clean.count() == 0 and rejects.count() == 0
    with pytest.raises(Exception, match="header"):
        read_csv_with_rejects(spark, _file("label,b,a\n1,0,0.5\n"), 1, 2)[0].collect()


def test_libsvm_rejects(spark):
    path = _file("1 1:2 3:0.5\n0\nx 1:1\n0 1:1 1:2\n0 9:1\n0 1:1.5 2:3 3:NaN\n0 3:abc\n0 2:1 # note 3\n\n# only\n0 1:1:2\n0 4:7 3:2\n0 0:1\n")
    clean, rejects, _ = read_libsvm_with_rejects(spark, path, 4, 2)
    assert sorted(tuple(r) for r in clean.select("label", "c0", "c1", "x0", "x1").collect()) == [
        (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0), (1.0, 2.0, 0.0, 0.5, 0.0)]
    assert {r["line"]: r["reasons"] for r in rejects.collect()} == {
        "x 1:1": ["label: not a number"], "0 1:1 1:2": ["index: not ascending"], "0 9:1": ["index: out of range"],
        "0 1:1.5 2:3 3:NaN": ["value: not a code", "value: not finite"], "0 3:abc": ["pair: not index:value"],
        "0 1:1:2": ["pair: not index:value"], "0 4:7 3:2": ["index: not ascending"], "0 0:1": ["index: out of range"]}


def test_libsvm_spaces_labels_with_colons_and_long_lines(spark):
    long = "0 " + " ".join(f"{i}:1" for i in range(1, 20_001))
    path = _file("1\t1:2 \t 4:5#x\n1:1 2:1\n0 1 :2\n0 -1:2\n0 1:\n0 99999999999999999999:1\n" + long + "\n" + long + ":2\n")
    clean, rejects, _ = read_libsvm_with_rejects(spark, path, 4, 2)
    assert [tuple(r) for r in clean.select("label", "c0", "c1", "x0", "x1").collect()] == [(1.0, 2.0, 0.0, 0.0, 5.0)]
    pair = ["pair: not index:value"]
    assert {r["line"]: r["reasons"] for r in rejects.collect()} == {
        "1:1 2:1": ["label: not a number"], "0 1 :2": pair, "0 -1:2": pair, "0 1:": pair, "0 99999999999999999999:1": pair,
        long: ["index: out of range"], long + ":2": pair}


def test_csv_job_writes_rejects_and_fits_the_rest(spark):
    from mixdetect.plans.csv_job import fit_and_evaluate

    rows = mixed_orders(spark, SF_SMALL).select("label", "c0", "c1", "c2", "x0", "x1").collect()
    text = "".join(",".join(str(v) for v in r) + "\n" for r in rows)
    bad = "0,1,oops,1,0.5,0.5\n0,1\n"
    out = tempfile.mkdtemp(prefix="mixdetect-rejected-")
    p = DetectorParams(subspace_dimension=2, logistic_lambda=0.1, gaussian_num=3, max_iterations=4, em_max_iter=3, kmeans_max_iter=3)
    model, scored, _ = fit_and_evaluate(spark, _file("label,0,1,2,3,4\n" + text + bad), 3, p, n_features=5, rejects_path=f"{out}/rejects")
    assert model.n_train == len(rows) == scored.count()
    assert sorted(r["line"] for r in spark.read.json(f"{out}/rejects").collect()) == sorted(bad.split())


@pytest.mark.parametrize("tail", ["low", "high"])
def test_sketches_follow_a_growing_table(spark, tail):
    df = spark.range(60_000).select("id", ((F.col("id") * 48_271) % 60_013).cast("double").alias("score"))
    store = ScoreSketches(spark, f"{tempfile.mkdtemp(prefix='mixdetect-sketch-')}/scores", k=200)
    parts = [df.where(F.col("id") % 4 == i) for i in range(4)]
    for i, part in enumerate(parts):
        store.add(part, i)
    store.add(parts[2], 2)  # a retried batch counts once
    whole, direct = store.whole(), whole_sketch(score_sketch(df, k=200), k=200)
    assert (whole.n, whole.lo, whole.hi) == (direct.n, direct.lo, direct.hi) == (60_000, 0.0, float(df.agg(F.max("score")).first()[0]))
    for sketch in (whole, direct):
        assert rank_report(df, sketch, 0.1, tail).first()["error"] <= 3 * rank_error(200)
    assert len(whole.sketch) < 20_000
    store.remove(3)
    assert store.whole().n == 45_000


def test_sketches_nulls_small_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, float("nan")), (2, 3.0), (2, 3.0), (2, float("inf"))], "p int, score double")
    whole = whole_sketch(score_sketch(df, by=["p"]))
    assert (whole.n, whole.n_left_out, whole.lo, whole.hi) == (3, 2, 3.0, float("inf"))
    assert whole.threshold(spark, 0.5) == 3.0 and whole.threshold(spark, 0.01, "high") == float("inf")
    for none in (df.where("p = 1"), df.where("false")):
        empty = whole_sketch(score_sketch(none, by=["p"]))
        assert empty.n == 0 and empty.sketch is None and empty.threshold(spark, 0.1) is None
    # few scores are all kept: the threshold is exact
    few = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("score"))
    assert whole_sketch(score_sketch(few)).threshold(spark, 0.1) == threshold(few, 500, 0.1)


def test_follow_sets_threshold_and_range(spark):
    df = mixed_orders(spark, SF_SMALL)
    model = _model(df, MIXED_ORDERS_SPEC, None)
    store = ScoreSketches(spark, f"{tempfile.mkdtemp(prefix='mixdetect-sketch-')}/scores")
    store.add(model.score(df), "first")
    exact = threshold(model.score(df), df.count(), model.params.anomaly_ratio)
    store.follow(model)
    assert model.threshold == exact and model.transform(df).where("is_anomaly").count() == 150
    assert (model.score_min, model.score_max) == tuple(model.score(df).agg(F.min("score"), F.max("score")).first())


@pytest.mark.parametrize("mode", ["joint", "product"])
def test_sql_function_equals_transform(spark, mode):
    df = mixed_orders(spark, SF_SMALL).withColumns({
        "x0": F.when(F.col("row_id") % 31 == 0, None).otherwise(F.col("x0")), "c1": F.when(F.col("row_id") % 41 == 0, 9).otherwise(F.col("c1"))})
    model = _model(mixed_orders(spark, SF_SMALL), MIXED_ORDERS_SPEC, -3.0, mode=mode)
    model.fit_range(df)
    names = register_score_functions(spark, model, "score_it", "flag_it", "proba_it")
    assert names == ["score_it", "flag_it", "proba_it"]
    df.createOrReplaceTempView("orders_for_function")
    got = spark.sql("SELECT row_id, score, flag_it(score) AS is_anomaly, proba_it(score) AS p0 FROM "
                    "(SELECT row_id, score_it(c0, c1, c2, x0, x1) AS score FROM orders_for_function)")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = {r["row_id"]: r for r in model.transform(df).join(model.predict_proba(df).select("row_id", "p0"), "row_id").collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 1500
    for r in rows:
        w = want[r["row_id"]]
        assert r["score"] == (None if w["score"] is None else pytest.approx(w["score"], rel=1e-12))
        assert r["is_anomaly"] == w["is_anomaly"] and r["p0"] == (None if w["p0"] is None else pytest.approx(w["p0"], rel=1e-9, abs=1e-12))


def test_sql_function_refuses_what_it_cannot_express(spark):
    df = mixed_orders(spark, SF_SMALL)
    with pytest.raises(ValueError, match="transform"):
        register_score_functions(spark, _model(df, MIXED_ORDERS_SPEC, on_unseen="error"))
    model = _model(df, MIXED_ORDERS_SPEC, None)
    register_score_functions(spark, model, "no_threshold_score", "no_threshold_flag")
    assert spark.sql("SELECT no_threshold_flag(-1e9D) AS f").first()["f"] is False
