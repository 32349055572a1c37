"""The SQL of this subpackage's queries against DuckDB, and the registry."""

import duckdb
import pytest

import __spark_entry__ as entry
from mixdetect.llm.oracles import ORACLES
from mixdetect.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(dict(zip(want.columns, r))[c] for c in cols) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_registry():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
