"""Detector input frames derived from the test tables (see FIXTURES.md).

Each builder reads only the columns it needs (Catalyst prunes the parquet
scan) and is a pure projection, so it also works on streaming sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import MixedSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Category codes of the source tables.
ORDER_STATUS_CODES = {"F": 0, "O": 1}  # anything else -> 2
EVENT_TYPE_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3}  # anything else -> 4
RETURN_FLAG_CODES = {"A": 0, "N": 1}  # anything else -> 2


def _code(col: Column, codes: dict[str, int], other: int) -> Column:
    expr = None
    for k, v in codes.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(other))


def mixed_orders_from(orders: DataFrame) -> DataFrame:
    """3 categorical (widths 3, 5, 4) + 2 continuous, 5 % injected anomalies."""
    key = F.col("o_orderkey")
    label = F.when(key % 20 == 7, 1).otherwise(0).cast("int")
    c2 = F.least(F.lit(3), F.floor(F.col("o_totalprice") / 125000.0)).cast("int")
    x1 = (F.month("o_orderdate") - 1) / 11.0
    b = orders.select(
        key.alias("row_id"),
        label.alias("label"),
        _code(F.col("o_orderstatus"), ORDER_STATUS_CODES, 2).alias("c0"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("c1"),
        c2.alias("c2"),
        (F.col("o_totalprice") / 500000.0).cast("double").alias("x0"),
        x1.cast("double").alias("x1"),
    )
    anomaly = F.col("label") == 1
    return b.select(
        "row_id", "label", "c0", "c1",
        F.when(anomaly, (F.col("c2") + 2) % 4).otherwise(F.col("c2")).cast("int").alias("c2"),
        "x0",
        F.when(anomaly, F.col("x1") * 0.5 + 0.55).otherwise(F.col("x1")).cast("double").alias("x1"),
    )


def mixed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_orders_from(table(spark, sf_dir, "orders"))


MIXED_ORDERS_SPEC = MixedSpec(cat_cols=("c0", "c1", "c2"), cont_cols=("x0", "x1"))


def mixed_events_from(events: DataFrame) -> DataFrame:
    """2 categorical (widths 5, 4) + 3 continuous, 10 % anomalies (x0 shifted)."""
    eid = F.col("event_id")
    anomaly = eid % 10 == 3
    hour = F.hour("ts")
    return events.select(
        eid.alias("row_id"),
        F.when(anomaly, 1).otherwise(0).cast("int").alias("label"),
        _code(F.col("event_type"), EVENT_TYPE_CODES, 4).alias("c0"),
        F.floor(hour / 6).cast("int").alias("c1"),
        (F.log(1 + F.col("value")) / 6.5 + F.when(anomaly, 0.25).otherwise(0.0)).cast("double").alias("x0"),
        (hour / 23.0).cast("double").alias("x1"),
        ((F.col("user_id") % 7) / 6.0).cast("double").alias("x2"),
    )


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_events_from(table(spark, sf_dir, "events"))


MIXED_EVENTS_SPEC = MixedSpec(cat_cols=("c0", "c1"), cont_cols=("x0", "x1", "x2"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark frame: 3 categorical + 4 continuous; row_id is not unique."""
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    return li.select(
        (ok * 8 + F.col("l_linenumber")).alias("row_id"),
        F.when(ok % 50 == 11, 1).otherwise(0).cast("int").alias("label"),
        _code(F.col("l_returnflag"), RETURN_FLAG_CODES, 2).alias("c0"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("c1"),
        (F.col("l_linenumber") - 1).alias("c2"),
        (F.col("l_quantity") / 50.0).cast("double").alias("x0"),
        (F.col("l_extendedprice") / 105000.0).cast("double").alias("x1"),
        (F.col("l_discount") * 10.0).cast("double").alias("x2"),
        (F.col("l_tax") * 12.5).cast("double").alias("x3"),
    )


MIXED_LINES_SPEC = MixedSpec(cat_cols=("c0", "c1", "c2"), cont_cols=("x0", "x1", "x2", "x3"))


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form sparse vectors (row_id, idx, value), 7 dimensions."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey", "l_linenumber")
            .agg(F.sum("l_quantity").cast("double").alias("value"))
            .select(F.col("l_orderkey").alias("row_id"),
                    (F.col("l_linenumber") - 1).alias("idx"), "value"))


SPARSE_LINES_DIM = 7


def wide_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), "label",
                      F.col("embedding").cast("array<double>").alias("embedding"))


WIDE_EMBEDDINGS_SPEC = MixedSpec(label=None, cont_array="embedding", cont_dim=64)
