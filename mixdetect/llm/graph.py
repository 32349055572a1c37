"""Connected components as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"),
                    F.sum(F.pmod(h, F.lit(2_147_483_647))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Each round hangs neighbours on the least one they know.  All state stays in
    DataFrames, minima are combined before the shuffle, and the written edges
    of a round cut the lineage.  Nodes without an edge are not listed.
    """
    edge = stored(edges.where(F.col(a) != F.col(b))
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    state = _state(edge)
    while state[0]:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, F.col("u") == F.col("w"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "cc-large")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        inner = (large.join(least, F.col("u") == F.col("w")).where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edge = stored(inner.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "cc-edges")
        now = _state(edge)
        if now == state:
            break
        state = now
    roots = edge.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
