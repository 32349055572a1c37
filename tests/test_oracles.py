"""Every registered query against its independent DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from mixdetect.oracles import oracle_sql
from mixdetect.queries import QUERIES

ORACLES = oracle_sql()


def _rows(cols, rows):
    return sorted(tuple(r[c] for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    spark_rows = _rows(cols, [r.asDict() for r in sdf.collect()])
    duck_rows = _rows(cols, [dict(zip(rel.columns, r)) for r in rel.fetchall()])
    assert len(spark_rows) == len(duck_rows)
    assert spark_rows == duck_rows


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "label", "log_p_cont", "log_p_cat", "score", "is_anomaly"]
    assert df.count() == 1500
