import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from mixdetect.plans.session import recommended_conf

    b = SparkSession.builder.master("local[4]").appName("mixdetect-tests")
    for k, v in recommended_conf(4).items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    tables = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
