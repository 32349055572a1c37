"""Exact order statistics without a single-task sort.

* :func:`kth_smallest` -- exact k-th smallest value by histogram narrowing:
  the band that holds rank k is cut into equal cells, the cells are counted
  (map-side combined, at most ``CELLS`` groups), and the cell of rank k, with
  its exact least and largest value, is the next band.  It ends when a band is
  one value; ties, however many, cost nothing extra.  The same few passes at
  any size.
* :func:`global_positions` -- exact 0-based position of every row in a total
  order: range partitions of the sort key (split even inside a hot key), local
  row numbers, and per-partition counts summed up to offsets.
* :func:`auc_frame` -- area under ROC with averaged ties: group by score
  (map-side combine), one range shuffle of the groups, and one row of sums per
  range partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
ROWS_PER_BUCKET = 2_000_000


def kth_smallest(df: DataFrame, col: str | Column, k: int, n: int | None = None, cells: int = CELLS) -> float | None:
    """Exact value of rank ``k`` (1-based) in ascending order of ``col``; nulls and NaN are not ranked.

    ``n``, if given, is the number of ranked rows and only spares a count.
    """
    c = F.col(col) if isinstance(col, str) else col
    # No filter on ``v``: pushed below the projection it would copy the whole
    # score expression into the scan stage.  Several passes follow, so the one
    # value column is kept instead of being computed again.
    v = df.select(c.cast("double").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _narrowed(v, int(k), cells)
    finally:
        v.unpersist()


def _narrowed(v: DataFrame, rank: int, cells: int) -> float | None:
    x = F.col("v")
    valid = x.isNotNull() & ~F.isnan(x)
    finite = valid & (F.abs(x) < F.lit(math.inf))
    row = v.agg(F.sum(F.when(valid, 1).otherwise(0)).alias("n"),
                F.sum(F.when(valid & (x == F.lit(-math.inf)), 1).otherwise(0)).alias("below"),
                F.sum(F.when(finite, 1).otherwise(0)).alias("finite"),
                F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).first()
    if rank < 1 or rank > (row["n"] or 0):
        return None
    if rank <= row["below"]:
        return -math.inf
    rank -= row["below"]
    if rank > row["finite"]:
        return math.inf
    lo, hi = row["lo"], row["hi"]
    while lo < hi:
        # halves, as the difference of two doubles may overflow
        width = hi / 2 - lo / 2
        share = (x / 2 - F.lit(lo / 2)) / F.lit(width) if width > 0 else F.when(x > F.lit(lo), 1.0).otherwise(0.0)
        cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
        found = (v.where((x >= F.lit(lo)) & (x <= F.lit(hi))).groupBy(cell.alias("cell"))
                 .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # <= CELLS rows
        for r in sorted(found, key=lambda r: r["cell"]):
            if rank <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return float(lo)


def kth_largest(df: DataFrame, col: str | Column, k: int, n: int | None = None, **kw) -> float | None:
    c = F.col(col) if isinstance(col, str) else col
    r = kth_smallest(df, -c, k, n, **kw)
    return None if r is None else -r + 0.0


def global_positions(df: DataFrame, order_cols: list[str], n: int | None = None, n_buckets: int | None = None,
                     out: str = "pos") -> DataFrame:
    """Adds the exact 0-based position of each row in the order of ``order_cols``.

    Ties (including many copies of one key) are broken by
    ``monotonically_increasing_id``, so the order is total and a range
    partitioner can split even a key that holds a third of all rows.  Plan:
    ``repartitionByRange`` on the full sort key, sort within partitions, number
    rows locally, checkpoint (the count pass and the position pass must see the
    same partitions), a running sum of one count per partition, joined back.
    For distinct keys the result does not depend on the input partitioning.
    """
    return checkpointed_positions(df, order_cols, n, n_buckets, out)[0]


def checkpointed_positions(df: DataFrame, order_cols: list[str], n: int | None = None, n_buckets: int | None = None,
                           out: str = "pos") -> tuple[DataFrame, int, DataFrame | None]:
    """:func:`global_positions`, the row count, which the per-partition counts
    give for free, and the checkpointed frame.

    Partitions follow from the number of rows.  One bucket's worth of rows is
    numbered by a window in one task; it needs no checkpoint (None).
    """
    from ..plans.session import ensure_checkpoint_dir

    if n_buckets is None:
        n = df.count() if n is None else n
        n_buckets = max(1, math.ceil(n / ROWS_PER_BUCKET))
    keys = [*order_cols, "__tb"]
    local_bits = 33  # monotonically_increasing_id = partition index << 33 | row index
    t = df.withColumn("__tb", F.monotonically_increasing_id())
    if n is not None and n_buckets == 1:
        place = F.row_number().over(Window.orderBy(*keys)) - 1
        return t.withColumn(out, place.cast("long")).drop("__tb"), int(n), None
    t = t.repartitionByRange(n_buckets, *keys) if n_buckets else t.repartitionByRange(*keys)
    t = t.sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    ensure_checkpoint_dir(df.sparkSession)
    t = t.checkpoint(eager=True)
    part = F.shiftright(F.col("__mid"), local_bits).cast("int")
    counts = t.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    # one row per partition
    offsets = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"), "__c")
    total = counts.agg(F.sum("__c").alias("n")).first()["n"] or 0
    local = F.col("__mid").bitwiseAND(F.lit((1 << local_bits) - 1))
    placed = t.withColumn("__p0", part).join(F.broadcast(offsets.drop("__c")), F.col("__p0") == F.col("__p"))
    return placed.withColumn(out, F.col("__before") + local).drop("__tb", "__mid", "__p0", "__p", "__before"), int(total), t


def _ranked_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range partition's sorted (s, pos, neg) rows to one row: first score, sums, and positives x negatives below them."""
    first, pos, neg, c = None, 0, 0, 0.0
    for b in batches:
        if not b.num_rows:
            continue
        p, q = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
        if first is None:
            first = b.column(0)[0].as_py()
        below = neg + np.cumsum(q) - q
        c += float((p * (below + 0.5 * q)).sum())
        pos, neg = pos + int(p.sum()), neg + int(q.sum())
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([pos]), pa.array([neg]), pa.array([c])], ["s", "pos", "neg", "c"])


def auc_frame(df: DataFrame, score: str | Column, label: str = "label", n_buckets: int | None = None,
              digits: int | None = None, report: bool = False) -> DataFrame:
    """One row: ``auc`` (higher score = label 1), ``n_pos``, ``n_neg``.  Ties count one half.

    Rows with a null or NaN score or a null label are not ranked
    (``report=True`` adds their number as ``n_unranked``); a label other than
    0 and 1 is an error.
    """
    s = F.col(score) if isinstance(score, str) else score
    if digits is not None:
        s = F.round(s, digits) + F.lit(0.0)
    rows = df.select(s.cast("double").alias("s"), F.col(label).alias("y"))
    y = F.col("y")
    # the score stands once in this plan, as the key; the sums look at the label alone
    g = rows.groupBy("s").agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
                              F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("neg"), F.count("*").alias("rows"),
                              F.sum(F.when(y.isNotNull() & ~y.isin(0, 1), 1).otherwise(0)).cast("long").alias("other"))
    ranked = F.col("s").isNotNull() & ~F.isnan("s")
    left = [F.sum(F.when(ranked, F.col("rows") - F.col("pos") - F.col("neg")).otherwise(F.col("rows"))).alias("out"), F.sum("other").alias("other")]
    own = [F.when(ranked, F.col(c)).otherwise(0) for c in ("pos", "neg")]
    if n_buckets is None and df.select(label).count() <= ROWS_PER_BUCKET:  # few rows: all in one job
        below = F.sum(own[1]).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - own[1]
        counts = (g.select("*", (own[0] * (below + 0.5 * own[1])).alias("c"))
                  .agg(*left, F.min(F.when(ranked, F.col("s"))).alias("s"), F.sum(own[0]).alias("pos"), F.sum(own[1]).alias("neg"), F.sum("c").alias("c")).first())
        sums = [] if counts["s"] is None else [counts]
    else:
        g = g.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = g.agg(*left, F.sum(ranked.cast("long")).alias("n")).first()
            parts = n_buckets or max(1, math.ceil((counts["n"] or 0) / ROWS_PER_BUCKET))
            sums = (g.where(ranked).select("s", "pos", "neg").repartitionByRange(parts, "s").sortWithinPartitions("s")
                    .mapInArrow(_ranked_sums, "s double, pos long, neg long, c double").collect())  # one row per partition
        finally:
            g.unpersist()
    if counts["other"]:
        raise ValueError(f"{counts['other']} rows have a label other than 0 and 1")
    below = total = 0.0
    n_pos = n_neg = 0
    for r in sorted(sums, key=lambda r: r["s"]):
        total += r["c"] + r["pos"] * below
        below += r["neg"]
        n_pos, n_neg = n_pos + r["pos"], n_neg + r["neg"]
    auc = total / (float(n_pos) * float(n_neg)) if n_pos and n_neg else None
    row, schema = (auc, n_pos or (None if not sums else 0), n_neg or (None if not sums else 0)), "auc double, n_pos long, n_neg long"
    if report:
        row, schema = (*row, counts["out"] or 0), schema + ", n_unranked long"
    return df.sparkSession.createDataFrame([row], schema)
