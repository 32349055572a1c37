"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of a total.  A source cannot give
more than ``max_epochs`` times its size: it is clamped there, and the excess
goes to the other sources in proportion to their weights, until no target is
above its cap.  A target of e epochs of a source then takes every document
floor(e) times and, for the remaining fraction, one more repetition of the
documents that come first in a seeded order, up to the words still wanted.

Only DataFrame operations: sizes are counted per (source, order bucket) with
map-side sums; the seeded order is cut at a bucket, and only the rows of that
bucket are sorted, so no source (however hot) passes through one task whole.

Defined results: a null text has size 0, a null source is a source of its own
(the last one), repeated rows count as separate documents, an empty table
gives an empty mix, extra columns are ignored by ``mix`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, stored, word_count

#: The seeded order is that of md5(seed:id); its first hex digits are the bucket.
ORDER_DIGITS = 3
ORDER_BUCKETS = 16 ** ORDER_DIGITS


def ranked_weights(sizes: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights cycle over the sources by code point, null last.

    The rank is a range-partitioned sort plus per-partition offsets; the
    offsets table has one row per partition.
    """
    ordered = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("__part", F.spark_partition_id())
                     .withColumn("__in", F.row_number().over(
                         Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))), "mix-sources")
    parts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = parts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    position = F.col("__in") - 1 + F.col("__before")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (ordered.join(offsets, F.col("__part") == F.col("__p"))
            .withColumn("weight", F.element_at(weights, (F.pmod(position, F.lit(len(cycle))) + 1).cast("int")))
            .select("source", "source_size", "weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight).

    Each round is one aggregate over the sources; a round clamps every source
    above its cap under the current level, so the level only rises and the
    loop ends when a round clamps nothing new.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        is_clamped = F.lit(False) if level is None else (F.col("weight") * F.lit(level) >= cap)
        row = sources.agg(
            F.sum(F.when(is_clamped, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~is_clamped, F.col("weight")).otherwise(0.0)).alias("free"),
            F.sum(is_clamped.cast("long")).alias("n")).first()
        if row["n"] is None or row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], max(0.0, total - row["fixed"]) / row["free"]
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0,
        total: float | None = None, seed: int = 42, order_id: Column | None = None) -> DataFrame:
    """One row per document: how often the mix repeats it.

    Returns doc_id, source, size, source_size, weight, target (words wanted
    from its source), copies and taken (= copies * size).  The total defaults
    to all words.  ``order_id`` is what the seeded order hashes, if not the id.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("doc_id") if order_id is None else order_id).cast("string")))
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("__text"))
        .select("doc_id", "source", word_count(F.col("__text")).alias("size"), order.alias("__order"))
        .withColumn("__bucket", F.conv(F.substring("__order", 1, ORDER_DIGITS), 16, 10).cast("int")), "mix-sizes")
    buckets = stored(rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__words")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("__words").cast("long").alias("source_size"))
    weighted = stored(ranked_weights(sizes, weight_cycle), "mix-weights")
    counted = weighted.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    n_sources, words = counted["n"], float(counted["words"] or 0)
    targets = stored(water_fill(weighted, words if total is None else float(total), max_epochs), "mix-targets")

    # whole repetitions, and the words that the fraction of one more should give
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("__whole", F.floor(epochs).cast("int")).withColumn(
        "__extra", F.col("target") - F.col("__whole") * F.col("source_size"))
    in_order = Window.partitionBy("source").orderBy("__bucket")
    cut = (join_by_key(buckets, plan.select("source", "__extra"), ["source"], n_sources)
           .withColumn("__upto", F.sum("__words").over(in_order))
           .where(F.col("__upto") > F.col("__extra"))
           .groupBy("source").agg(F.min(F.struct("__bucket", (F.col("__extra") - F.col("__upto") + F.col("__words"))
                                                 .alias("__left"))).alias("__cut")))
    plan = plan.join(cut.select(F.col("source").alias("__s"), "__cut"), F.col("source").eqNullSafe(F.col("__s")), "left")
    plan = stored(plan.select("source", "source_size", "weight", "target", "__whole",
                              F.coalesce(F.col("__cut.__bucket"), F.lit(ORDER_BUCKETS)).alias("__edge"),
                              F.coalesce(F.col("__cut.__left"), F.lit(0.0)).alias("__left")), "mix-plan")
    joined = join_by_key(rows, plan, ["source"], n_sources)
    below = joined.where(F.col("__bucket") != F.col("__edge")).withColumn(
        "copies", F.col("__whole") + (F.col("__bucket") < F.col("__edge")).cast("int"))
    # the bucket at the edge: in seeded order, up to the nearer side of the last document
    running = F.sum("size").over(Window.partitionBy("source").orderBy("__order", "doc_id", "size")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = joined.where(F.col("__bucket") == F.col("__edge")).withColumn("__run", running).withColumn(
        "copies", F.col("__whole") + (F.col("__run") - F.col("size") / 2 <= F.col("__left")).cast("int")).drop("__run")
    limit = F.lit(math.ceil(max_epochs))  # the target itself bounds the source's words
    return below.unionByName(edge).withColumn("copies", F.least(F.col("copies"), limit)).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, all columns unchanged, each row as often as the mix repeats it.

    Rows are matched by 128 hash bits of id, source and text.  Rows that agree
    in all three are told apart by a number, so each gets its own copies.
    """
    def keys() -> list[Column]:
        return [F.xxhash64(F.lit(k), F.col(id_col), F.col(source_col), F.col(text_col)).alias(f"__m{k}") for k in (1, 2)]

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy("__m1", "__m2").orderBy("__m1")))

    # whole rows are one struct, so that their names cannot clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), *keys())
    ids = docs.select(F.struct(*keys(), F.col(id_col).alias("__own")).alias("__id"), F.col(text_col).alias("__t"), F.col(source_col).alias("__s"))
    chosen = (mix(ids, "__id", "__t", "__s", order_id=F.col("doc_id")["__own"], **options).where("copies > 0")
              .select("doc_id.__m1", "doc_id.__m2", "copies"))
    chosen = numbered(chosen).select(F.col("__m1").alias("__c1"), F.col("__m2").alias("__c2"), F.col("__n").alias("__cn"),
                                     F.col("copies").alias("__copies"))
    on = (F.col("__m1") == F.col("__c1")) & (F.col("__m2") == F.col("__c2")) & (F.col("__n") == F.col("__cn"))
    return (numbered(keyed).join(chosen, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select("__row.*"))
