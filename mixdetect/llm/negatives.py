"""Hard negatives by Fagin's threshold algorithm.

Rows are vectors of integers with a label; the score of two rows is their
integer inner product, higher first and ties by the smaller id.  For every
anchor the first ``positives`` other rows of its label are found, and for each
of these the first ``negatives`` rows of other labels whose score lies in the
window ``low`` to ``high`` per cent of the positive's.

The rows are dealt to blocks.  A block keeps, per dimension, the list of its
rows sorted by that component.  An anchor reads all lists in step, from the top
where its own component is positive and from the bottom where it is negative,
and scores each row it meets for the first time by random access.  The sum of
the anchor's components times the last values read is a threshold that no
unread row can pass: reading stops once it falls strictly below each window's
kth score, or below the window (strictly, as an unread row of an equal score
may have the smaller id).

Blocks answer with at most k rows a window, which Spark ranks over all blocks.
The anchors (a stated query set) go to every block in batches; the rows go to
as many tasks as there are batches of anchors.  Nothing passes through the
driver but two counts.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part.  Components are the floor of ``scale``
times the value, saturated at +-2^28, so that scores stay exact; a vector that
is shorter than another counts as filled up with zeros.  Rows repeated exactly
count once; a row is never its own partner, nor is another row of the same id.
An anchor without positives, or whose windows hold no row, gives no rows (so a
positive score below zero, whose window is empty, gives none).  An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Largest magnitude of a component: products of two, summed over 64 dimensions, fit a long.
SATURATION = 1 << 28
#: Rows of a block, and of the least block that the rows of a small table are dealt to.
BLOCK_ROWS, LEAST_BLOCK, SPREAD = 16_384, 1_024, 48
#: Anchors that a task holds at once.
ANCHOR_BATCH = 65_536
#: Positions that all lists are read before the threshold is first looked at; then twice as many each time.
FIRST_DEPTH = 16


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    low: int = 80  # per cent of the positive's score
    high: int = 100
    scale: int = 256


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v array<long>, rid) of the rows that take part; rid tells rows of one id apart."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c * F.lit(float(scale))), F.lit(-SATURATION)), F.lit(SATURATION)).cast("long"))
    picked = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.when(usable, whole).alias("v"))
    kept = picked.where("id is not null and label is not null and v is not null").distinct()
    return kept.withColumn("rid", F.xxhash64("id", "label", "v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    if len(column) and all(len(v) == width for v in column):
        return np.stack(column.to_list()).astype(np.int64, copy=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class Block:
    """Rows of a block with their sorted lists, one per dimension."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, X: np.ndarray):
        self.ids, self.rids, self.labels, self.X = ids, rids, labels, X
        self.order = np.argsort(X, axis=0, kind="stable")  # ascending, per dimension
        self.sorted = np.take_along_axis(X, self.order, axis=0)

    def read(self, anchor: np.ndarray):
        """Batches of (rows met for the first time, their scores, threshold for all rows not met)."""
        n = len(self.ids)
        seen = np.zeros(n, dtype=bool)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)  # a zero component adds nothing
        at, depth = 0, FIRST_DEPTH
        while at < n:
            end = min(n, at + depth)
            met = np.zeros(n, dtype=bool)
            met[self.order[n - end:n - at, up].ravel()] = True
            met[self.order[at:end, down].ravel()] = True
            if not len(up) and not len(down):
                met[:], end = True, n
            new = np.flatnonzero(met & ~seen)
            seen |= met
            threshold = int(self.sorted[n - end, up] @ anchor[up] + self.sorted[end - 1, down] @ anchor[down]) if end < n else None
            yield new, self.X[new] @ anchor, threshold
            at, depth = end, depth * 2


def _first(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by score, id and row."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((rids[near], ids[near], -scores[near]))[:k]]
    return np.lexsort((rids, ids, -scores))[:k]


def search(block: Block, anchor: np.ndarray, anchor_id: int, label: int, windows: list[tuple[int, int] | None], same: bool, k: int):
    """Per window (low, high; None: all scores) the positions and scores of the block's first k rows of the same or another label."""
    held = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in windows]
    open_ = list(range(len(windows)))
    for new, scores, threshold in block.read(anchor):
        fits = (block.labels[new] == label) & (block.ids[new] != anchor_id) if same else block.labels[new] != label
        new, scores = new[fits], scores[fits]
        for w in list(open_):
            lo, hi = windows[w] or (None, None)
            if windows[w] is None:
                rows, own = new, scores
            else:
                within = (scores >= lo) & (scores <= hi)
                rows, own = new[within], scores[within]
            if len(rows):
                rows, own = np.concatenate([held[w][0], rows]), np.concatenate([held[w][1], own])
                best = _first(own, block.ids[rows], block.rids[rows], k)
                held[w] = rows[best], own[best]
            full = len(held[w][0]) == k and threshold is not None and threshold < held[w][1][-1]
            below = lo is not None and threshold is not None and threshold < lo
            if full or below:
                open_.remove(w)
        if not open_:
            break
    return held


def _searched(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, mining: Mining, same: bool, schema: str) -> DataFrame:
    """Every block's answers for every anchor: (aid, arid, alabel, av) and, for other labels, its positives' pids, prids and pscores."""
    blocks = max(1, math.ceil(n_rows / BLOCK_ROWS), min(SPREAD, math.ceil(n_rows / LEAST_BLOCK)))
    batches = max(1, math.ceil(n_anchors / ANCHOR_BATCH))
    dealt = rows.withColumn("block", F.pmod("rid", F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))) if batches > 1 else dealt.withColumn("batch", F.lit(0))
    asked = (anchors.withColumn("batch", F.pmod("arid", F.lit(batches)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    names = [f.split()[0] for f in schema.split(", ")]
    k = mining.positives if same else mining.negatives

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["av"].map(len).max())
            block = Block(left["id"].to_numpy(), left["rid"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"], width))
            for a, (i, aid, arid, label) in zip(_matrix(right["av"], width), right[["aid", "arid", "alabel"]].itertuples(), strict=True):
                if same:
                    windows, partners = [None], [()]
                else:
                    scores = right["pscores"][i].tolist()
                    # the least and largest scores between low and high per cent of the positive's
                    windows = [(-(-mining.low * s // 100), mining.high * s // 100) for s in scores]
                    partners = list(zip(right["pids"][i].tolist(), right["prids"][i].tolist(), scores, strict=True))
                for (at, scores), partner in zip(search(block, a, aid, label, windows, same, k), partners, strict=True):
                    out += [(aid, arid, *partner, *found) for found in
                            zip(block.ids[at].tolist(), block.rids[at].tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=names)

    # a fixed number of partitions, as little data makes much work here
    sides = [side.repartition(blocks * batches, "batch", "block").groupBy("batch", "block") for side in (dealt, asked)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, schema)


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor.

    ``is_anchor`` is a condition on the column ``id``; ``label`` replaces the label column.
    """
    table = stored(vectors(rows, id_col, vector_col, F.col(label_col) if label is None else label, mining.scale), "negatives-rows")
    anchors = table.where(is_anchor).select(F.col("id").alias("aid"), F.col("rid").alias("arid"), F.col("label").alias("alabel"), F.col("v").alias("av"))
    n_rows, n_anchors = table.count(), anchors.count()

    near = _searched(table, anchors, n_rows, n_anchors, mining, True, "aid long, arid long, id long, rid long, score long")
    place = F.row_number().over(Window.partitionBy("aid", "arid").orderBy(F.desc("score"), "id", "rid"))
    positives = near.withColumn("place", place).where(F.col("place") <= mining.positives)
    windows = positives.groupBy("aid", "arid").agg(F.collect_list(F.struct("id", "rid", "score")).alias("w"))  # at most ``positives`` to an anchor
    windows = windows.select("aid", "arid", F.col("w.id").alias("pids"), F.col("w.rid").alias("prids"), F.col("w.score").alias("pscores"))
    asked = stored(anchors.join(windows, ["aid", "arid"]), "negatives-windows")

    found = _searched(table, asked, n_rows, n_anchors, mining, False,
                      "aid long, arid long, pid long, prid long, pscore long, id long, rid long, score long")
    rank = F.row_number().over(Window.partitionBy("aid", "arid", "pid", "prid").orderBy(F.desc("score"), "id", "rid"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= mining.negatives)
            .select(F.col("aid").alias("anchor_id"), F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score")))
