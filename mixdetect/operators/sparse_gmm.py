"""The mixture over sparse rows: absent entries are zero and cost nothing.

A row holds the indices and values of its entries.  Per component there is one
base term, the log-density of the zero vector, and an entry adds a correction
for its own dimension only, so the work follows the entries and not rows x
dimensions.  The statistics are split the same way: what the entries add to a
dimension, and what the component's mass says about all rows at zero.

Rows come from the long form (row_id, idx, value) by one shuffle
(:func:`sparse_rows`) or from Spark ML vectors by a projection
(:func:`vector_rows`); every pass after that is an Arrow projection, and the
E-step sums per partition the dimensions it meets.  Parameters are bound by
reference (K x dimensions numbers).

A null or NaN value makes its row's density, and so every statistic, NaN, as
in the dense form; null indices are errors, as are indices outside of
0..dim-1 and an index given twice in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LN_2PI
from ..spec import GmmParams
from .gmm import Stats, row_loglik


def sparse_rows(long_df: DataFrame, row_id: str = "row_id", idx: str = "idx", value: str = "value", ids: DataFrame | None = None) -> DataFrame:
    """(row_id, indices, values) from one row per entry; ``ids`` adds rows without entries.  A row has at most ``dim`` entries."""
    entries = long_df.groupBy(F.col(row_id).alias("row_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(idx).cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("e"))
    rows = entries.select("row_id", F.col("e.i").alias("indices"), F.col("e.v").alias("values"))
    if ids is None:
        return rows
    empty = [F.coalesce(c, F.array().cast(t)) for c, t in ((F.col("indices"), "array<int>"), (F.col("values"), "array<double>"))]
    return (ids.select(F.col(row_id).alias("row_id")).distinct().join(rows, "row_id", "left")
            .select("row_id", empty[0].alias("indices"), empty[1].alias("values")))


def vector_rows(df: DataFrame, vector: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, indices, values) from a column of Spark ML vectors, sparse or dense: a projection."""
    v = F.unwrap_udt(F.col(vector))
    values = v.getField("values")
    dense = v.getField("type") == 1
    indices = F.when(dense, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(v.getField("indices"))
    return df.select(F.col(row_id).alias("row_id"), F.when(F.size(values) > 0, indices).otherwise(F.array().cast("array<int>")).alias("indices"),
                     values.alias("values"))


class _Terms:
    """Base terms and what an entry (c, v) of component m adds to them."""

    def __init__(self, p: GmmParams):
        self.p = p
        with np.errstate(divide="ignore"):
            self.base = (np.log(p.weights) - 0.5 * (p.d * LN_2PI + np.log(p.covars).sum(axis=1))
                         - 0.5 * (p.means ** 2 / p.covars).sum(axis=1))

    def logpdf(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """n x K weighted component log-densities from entries in row order."""
        lp = np.empty((n, self.p.K))
        for m in range(self.p.K):
            mu, var = self.p.means[m, idx], self.p.covars[m, idx]
            lp[:, m] = self.base[m] + np.bincount(row, weights=-0.5 * val * (val - 2.0 * mu) / var, minlength=n)
        return lp


def _entries(indices: pa.Array, values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of a batch's entries; what is no sparse row is an error."""
    n = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(indices)), n)
    flat = indices.flatten()
    if flat.null_count:
        raise ValueError("an entry has no index")
    idx, val = flat.to_numpy().astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(idx) != len(val):
        raise ValueError("a row has another number of values than of indices")
    if len(idx) and (idx.min() < 0 or idx.max() >= dim):
        raise ValueError(f"an entry has an index outside 0..{dim - 1}")
    if ((row[1:] == row[:-1]) & (idx[1:] == idx[:-1])).any():
        raise ValueError("a row has two entries of one index")
    return row, idx, val


def with_sparse_responsibilities(rows: DataFrame, p: GmmParams, prefix: str = "r", loglik: str = "loglik") -> DataFrame:
    """row_id, the row's log-likelihood, ``r0``.. (the components' posterior probabilities) and ``component``, the first of the largest."""
    terms = _Terms(p.copy())
    names = ["row_id", loglik, *[f"{prefix}{m}" for m in range(p.K)], "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lp = terms.logpdf(*_entries(b.column(1), b.column(2), terms.p.d), b.num_rows)
            ll = row_loglik(lp) if b.num_rows else np.empty(0)
            R = np.exp(lp - ll[:, None])
            best = pa.array(R.argmax(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ll), *[pa.array(R[:, m]) for m in range(R.shape[1])], best], names)

    kind = dict(rows.dtypes)["row_id"]
    fields = [f"`row_id` {kind}", *[f"`{n}` double" for n in names[1:-1]], "component int"]
    return rows.select("row_id", "indices", "values").mapInArrow(run, ", ".join(fields))


def sparse_estep_frame(rows: DataFrame, p: GmmParams) -> DataFrame:
    """Long (k, i, v): k = -1 for the row count and log-likelihood (i = 0, 1) and the masses (i = 2 + m), else the
    sums 2m and 2m + 1 of component m, of r (x - mean) and r (x - mean)^2 less their values at zero, for dimension i."""
    terms = _Terms(p.copy())
    K, d = p.K, p.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(2 + K)
        sums = np.zeros((2 * K, d))
        met = np.zeros(d, dtype=bool)
        for b in batches:
            if not b.num_rows:
                continue
            row, idx, val = _entries(b.column(0), b.column(1), d)
            lp = terms.logpdf(row, idx, val, b.num_rows)
            ll = row_loglik(lp)
            R = np.exp(lp - ll[:, None])
            head += np.concatenate([[b.num_rows, ll.sum()], R.sum(axis=0)])
            met[idx] = True
            for m in range(K):
                r = R[row, m]
                sums[2 * m] += np.bincount(idx, weights=r * val, minlength=d)
                sums[2 * m + 1] += np.bincount(idx, weights=r * val * (val - 2.0 * terms.p.means[m, idx]), minlength=d)
        at = np.flatnonzero(met)
        k = np.concatenate([np.full(2 + K, -1), np.repeat(np.arange(2 * K), len(at))])
        i = np.concatenate([np.arange(2 + K), np.tile(at, 2 * K)])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(np.concatenate([head, sums[:, at].ravel()]))],
                                         ["k", "i", "v"])

    return (rows.select("indices", "values").mapInArrow(run, "k int, i int, v double")
            .groupBy("k", "i").agg(F.sum("v").alias("v")))


def sparse_estep(rows: DataFrame, p: GmmParams) -> Stats:
    """Sufficient statistics about the means, as those of the dense E-step on the same rows with their zeros."""
    K, d = p.K, p.d
    head, sums = np.zeros(2 + K), np.zeros((2 * K, d))
    got = sparse_estep_frame(rows, p).toArrow()  # 2 + K + 2 K d numbers at most
    k, i, v = (got.column(c).to_numpy() for c in ("k", "i", "v"))
    head[i[k < 0]] = v[k < 0]
    sums[k[k >= 0], i[k >= 0]] = v[k >= 0]
    n = head[2:]
    s1 = sums[0::2] - n[:, None] * p.means  # all rows at zero, and what the entries add
    s2 = sums[1::2] + n[:, None] * p.means ** 2
    return Stats(float(head[1]), n, s1, s2, int(round(head[0])))
