"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixdetect.plans.session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows up to which a per-key table is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 200_000
SALTS = 32


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col):
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n_table: int) -> DataFrame:
    """Left join rows to a table with one row per key (null keys match).

    The table is broadcast when its counted size allows; otherwise both sides
    are shuffled with a salt, so that one hot key spreads over SALTS tasks.
    """
    renamed = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                           *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if n_table <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(renamed), on, "left")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t in ("bigint", "string", "int")]),
                                                  F.lit(SALTS)).cast("int"))
        spread = renamed.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(spread, [*on, F.col("__salt") == F.col("__salt2")], "left").drop("__salt", "__salt2")
    return out.drop(*[f"__k_{k}" for k in keys])
