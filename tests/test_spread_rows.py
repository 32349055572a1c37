"""A fit's rows are dealt to all cores, whatever files and row groups they are read from."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mixdetect import queries
from mixdetect.plans import session
from mixdetect.plans.detector import Detector


@pytest.fixture(scope="module")
def one_row_group(tmp_path_factory):
    """A folder with 2000 orders in one file of one row group."""
    n, folder = 2000, tmp_path_factory.mktemp("sf")
    rows = {"o_orderkey": [7 * k % 3001 for k in range(n)], "o_orderstatus": ["FOP"[k % 3] for k in range(n)],
            "o_totalprice": [1000.0 + 37.0 * (k * k % 12007) for k in range(n)],
            "o_orderdate": pa.array([datetime(1995 + k % 3, 1 + k * k % 12, 1 + k % 28) for k in range(n)], pa.timestamp("us")),
            "o_orderpriority": [f"{1 + k * 3 % 5}-X" for k in range(n)]}
    pq.write_table(pa.table(rows), folder / "orders.parquet", row_group_size=n)
    return str(folder)


def _sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_rows_of_one_row_group_are_dealt_evenly(spark, one_row_group, monkeypatch):
    df = spark.read.parquet(f"{one_row_group}/orders.parquet")
    df = df.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 2))  # nulls and copies
    assert session.spread_rows(df) is df  # few rows stay as they are
    monkeypatch.setattr(session, "SPREAD_ROWS", 2000)
    dealt = session.spread_rows(df)
    assert dealt.columns == df.columns and sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    sizes = _sizes(dealt)
    assert len(_sizes(df)) == 1 and len(sizes) == 4 and sizes[-1] < 1.3 * sizes[0]
    monkeypatch.setattr(session, "ROWS_PER_TASK", 300)
    assert len(_sizes(session.spread_rows(df))) == 8


@pytest.mark.parametrize("name", ["fit_end_to_end", "fit_end_to_end_small"])
def test_a_fit_of_one_row_group_uses_all_cores(spark, one_row_group, monkeypatch, name):
    want = queries.QUERIES[name](spark, one_row_group).collect()
    seen, fit = [], Detector.fit
    monkeypatch.setattr(Detector, "fit", lambda self, df: seen.append(_sizes(df)) or fit(self, df))
    monkeypatch.setattr(session, "SPREAD_ROWS", 500, raising=False)
    scored = queries.QUERIES[name](spark, one_row_group)
    assert len(seen[0]) == len(_sizes(scored)) == 4 and seen[0][-1] < 600
    assert sorted(scored.collect()) == sorted(want)
