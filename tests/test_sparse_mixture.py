"""The mixture over sparse rows equals the dense one on the same rows with their zeros."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from mixdetect.operators.gmm import estep, with_cont_loglik, with_responsibilities
from mixdetect.operators.sparse_gmm import (sparse_estep, sparse_estep_frame, sparse_rows, vector_rows,
                                            with_sparse_responsibilities)
from mixdetect.plans.em import train_em, train_em_sparse
from mixdetect.spec import GmmParams, MixedSpec

DIM = 9
SPEC = MixedSpec(label=None, cont_array="x", cont_dim=DIM)


def params(K=3, seed=2):
    rng = np.random.default_rng(seed)
    w = rng.uniform(0.2, 1, K)
    return GmmParams(w / w.sum(), rng.normal(0, 0.5, (K, DIM)), rng.uniform(0.3, 1.5, (K, DIM)))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    return {k: {i: rng.gauss(0, 1) for i in rng.sample(range(DIM), rng.randint(0, 4))} for k in range(200)}


@pytest.fixture(scope="module")
def long(spark, vectors):
    return spark.createDataFrame([(k, i, x) for k, v in vectors.items() for i, x in v.items()], "row_id long, idx int, value double").repartition(5)


@pytest.fixture(scope="module")
def rows(spark, vectors, long):
    return sparse_rows(long, ids=spark.createDataFrame([(k,) for k in vectors], "row_id long"))


@pytest.fixture(scope="module")
def dense(spark, vectors):
    return spark.createDataFrame([(k, [v.get(i, 0.0) for i in range(DIM)]) for k, v in vectors.items()], "row_id long, x array<double>")


def test_responsibilities(rows, dense):
    p = params()
    want = {r.row_id: r for r in with_responsibilities(with_cont_loglik(dense, p, SPEC, "ll"), p, SPEC).collect()}
    got = with_sparse_responsibilities(rows, p).collect()
    assert len(got) == len(want) == 200
    for r in got:
        w = want[r.row_id]
        assert [r.loglik, r.r0, r.r1, r.r2] == pytest.approx([w.ll, w.r0, w.r1, w.r2], abs=1e-12)
        assert r.component == int(np.argmax([w.r0, w.r1, w.r2]))


def test_statistics_and_fit(rows, dense):
    p = params()
    a, b = sparse_estep(rows, p), estep(dense, p, SPEC, "arrow")
    assert a.rows == b.rows == 200 and a.ll == pytest.approx(b.ll)
    for x, y in ((a.n, b.n), (a.s1, b.s1), (a.s2, b.s2)):
        assert np.allclose(x, y, atol=1e-9)
    one, two = train_em_sparse(rows, p, max_iter=15, tol=1e-6), train_em(dense, SPEC, p, max_iter=15, tol=1e-6, strategy="arrow")
    assert len(one.history) == len(two.history) and np.allclose(one.params.means, two.params.means, atol=1e-8)


def test_only_dimensions_with_entries_are_summed(spark):
    one = spark.createDataFrame([(1, [3], [0.5])], "row_id long, indices array<int>, values array<double>")
    p = GmmParams(np.array([1.0]), np.zeros((1, 100_000)), np.ones((1, 100_000)))
    assert sparse_estep_frame(one, p).count() == 3 + 2  # rows, log-likelihood and mass; two sums of dimension 3


def test_vectors_of_both_kinds(spark, vectors, dense):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("v", VectorUDT())])
    df = spark.createDataFrame([(k, Vectors.sparse(DIM, v) if k % 2 else Vectors.dense([v.get(i, 0.0) for i in range(DIM)]))
                                for k, v in vectors.items()], schema)
    p = params()
    want = {r.row_id: r.ll for r in with_cont_loglik(dense, p, SPEC, "ll").collect()}
    assert {r.row_id: r.loglik for r in with_sparse_responsibilities(vector_rows(df, "v"), p).collect()} == pytest.approx(want)


def test_empty_table_nulls_and_errors(spark, rows):
    p = params()
    assert with_sparse_responsibilities(rows.limit(0), p).count() == 0 and sparse_estep(rows.limit(0), p).rows == 0
    make = lambda i, v: spark.createDataFrame([(1, i, v)], "row_id long, indices array<int>, values array<double>")
    assert np.isnan(with_sparse_responsibilities(make([0], [None]), p).first().loglik)
    for indices, values, said in (([9], [1.0], "outside"), ([-1], [1.0], "outside"), ([2, 2], [1.0, 1.0], "two entries"),
                                  ([None], [1.0], "no index"), ([1, 2], [1.0], "another number")):
        with pytest.raises(Exception, match=said):
            with_sparse_responsibilities(make(indices, values), p).collect()
