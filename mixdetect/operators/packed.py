"""Passes over rows that are packed into matrix blocks once.

An iterative fit reads the same few numbers of every row again and again with
other parameters.  Generated expressions would have to be planned and compiled
anew for every parameter set; here the rows are packed once (one row of the
packed frame holds a matrix of up to one Arrow batch of rows), the frame is
persisted, and a pass is a fixed Arrow function to which the parameters are
bound: its plan has no generated class that depends on them.  Each partition
returns its sums, which are added up per position.

An algorithm is written against :class:`Passes` (sums over all rows, candidate
rows) and does not see how they are made.  :func:`run_passes` chooses: up to
``TASK_ROWS`` rows a model's whole algorithm runs inside one task; beyond
that each pass is a job of one stage over the persisted frame, whose partitions
return their sums to the driver while those are few, and add them up by a
shuffle otherwise.  The results are the same.  (A barrier stage with
``allGather`` was measured at one second an exchange, four times a job.)

Several models may share the passes.  A row carries the number of its part (its
fold); a model reads all rows but those of the part it leaves out.  Every pass
serves all models that have not yet stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HASH_RANGE, LN_2PI, STREAM_KMEANS, modular_uniform, row_hash
from ..spec import GmmParams, MixedSpec
from .gmm import KMEANS_ROUNDS, Stats, _weighted_lloyd, batch_matrix, feature_frame

#: Part that no row has: a model that leaves it out reads all rows.
ALL = -1


@dataclass(frozen=True)
class Packed:
    """(n, x, part, draws): d x n doubles, n part numbers and rounds x n uniforms of the rows of a batch."""

    frame: DataFrame
    d: int
    rounds: int


def _pack(df: DataFrame, spec: MixedSpec, part: str | None, draws: list[Column]) -> DataFrame:
    extra = [(F.lit(ALL) if part is None else F.col(part)).cast("int").alias("__part"), *[u.alias(f"__u{i}") for i, u in enumerate(draws)]]
    if spec.cont_array:
        rows = df.select(F.col(spec.cont_array).cast("array<double>").alias("features"), *extra)
    else:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in spec.cont_cols], *extra)
    width, d, is_array = len(feature_frame(df, spec).columns), spec.d, bool(spec.cont_array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                X = batch_matrix(b.select(range(width)), d, is_array)
                U = [c.to_numpy(zero_copy_only=False) for c in b.columns[width + 1:]]
                cells = [np.ascontiguousarray(X.T).tobytes(), b.column(width).to_numpy(zero_copy_only=False).astype(np.int32).tobytes(),
                         np.concatenate(U).tobytes() if U else b""]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]],
                                                 ["n", "x", "part", "draws"])

    return rows.mapInArrow(run, "n int, x binary, part binary, draws binary")


@contextmanager
def packed_rows(df: DataFrame, spec: MixedSpec, part: str | None = None, draws: list[Column] = ()):
    """The rows of ``df``, packed and kept while in use (lost blocks are packed again)."""
    frame = _pack(df, spec, part, list(draws)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Packed(frame, spec.d, len(draws))
    finally:
        frame.unpersist()


def _blocks(packed: Packed, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    for b in batches:
        for j in range(b.num_rows):
            n = b.column(0)[j].as_py()
            x, part, *draws = (np.frombuffer(b.column(k)[j].as_buffer(), dtype=kind) for k, kind in ((1, float), (2, np.int32), (3, float))[:min(3, b.num_columns - 1)])
            yield x.reshape(packed.d, n), part, draws[0].reshape(-1, n) if draws else None


class Passes:
    """Passes over all rows: ``sums`` adds up what ``visit(sums, X, part)`` adds per block, ``drawn`` returns candidate rows."""

    d: int
    rounds: int

    def sums(self, visit: Callable, size: int) -> np.ndarray:
        raise NotImplementedError

    def drawn(self, step: int, C: list[np.ndarray], left_out: list[int], share: list[float]) -> list[np.ndarray]:
        """Per model the distinct rows whose uniform is below ``share`` times the squared distance to the nearest candidate."""
        raise NotImplementedError

    def first(self, left_out: list[int]) -> list[np.ndarray]:
        """Per model the row with the least uniform of round 0."""
        raise NotImplementedError


def _draw(X: np.ndarray, part: np.ndarray, draws: np.ndarray, step: int, C: list[np.ndarray], left_out: list[int], share: list[float]) -> list[np.ndarray]:
    out = []
    for c, skip, s in zip(C, left_out, share, strict=True):
        rows, u = (X, draws[step]) if skip == ALL else (X[:, part != skip], draws[step][part != skip])
        out.append(rows[:, u < _nearest(rows, c)[0] * s].T)
    return out


def _least(X: np.ndarray, part: np.ndarray, draws: np.ndarray, left_out: list[int]) -> list[tuple]:
    """Per model (uniform, row) of the row with the least uniform of round 0, ties by its values; None without rows."""
    out = []
    for skip in left_out:
        rows, u = (X, draws[0]) if skip == ALL else (X[:, part != skip], draws[0][part != skip])
        ties = rows[:, u == u.min()] if u.size else None
        out.append(None if ties is None else (float(u.min()), tuple(min(map(tuple, ties.T.tolist())))))
    return out


def _first_of(found: list[list[tuple]]) -> list[np.ndarray]:
    return [np.array([min(f[k] for f in found if f[k] is not None)[1]], dtype=float) for k in range(len(found[0]))]


class JobPasses(Passes):
    """A Spark job for each pass."""

    def __init__(self, packed: Packed, partitions: int):
        self.packed, self.partitions, self.d, self.rounds = packed, partitions, packed.d, packed.rounds

    def sums(self, visit, size):
        shape = Packed(None, self.d, self.rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for X, part, _ in _blocks(shape, batches):
                visit(total, X, part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

        parts = self.packed.frame.select("n", "x", "part").mapInArrow(run, "i int, v double")
        direct = self.partitions * size <= DRIVER_SUMS
        got = (parts if direct else parts.groupBy("i").agg(F.sum("v").alias("v"))).toArrow()
        return np.bincount(got.column("i").to_numpy(), weights=got.column("v").to_numpy(), minlength=size)

    def drawn(self, step, C, left_out, share):
        shape = Packed(None, self.d, self.rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for X, part, draws in _blocks(shape, batches):
                for m, hit in enumerate(_draw(X, part, draws, step, C, left_out, share)):
                    if len(hit):
                        flat = pa.ListArray.from_arrays(np.arange(0, hit.size + 1, hit.shape[1], dtype=np.int32), pa.array(hit.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), m, dtype=np.int32)), flat], ["m", "x"])

        got = self.packed.frame.mapInArrow(run, "m int, x array<double>").toArrow()  # some 2K rows a model expected
        m, x = got.column("m").to_numpy(), got.column("x").to_pylist()
        return [np.unique(np.array([row for i, row in zip(m, x) if i == k], dtype=float).reshape(-1, self.d), axis=0) for k in range(len(C))]


    def first(self, left_out):
        shape = Packed(None, self.d, self.rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [_least(X, part, draws, left_out) for X, part, draws in _blocks(shape, batches)]
            best = [min((f[k] for f in found if f[k] is not None), default=None) for k in range(len(left_out))]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(best)], pa.binary())], ["best"])  # one row a partition

        return _first_of([pickle.loads(r["best"]) for r in self.packed.frame.mapInArrow(run, "best binary").collect()])


class TaskPasses(Passes):
    """Inside the one task that holds all blocks."""

    def __init__(self, blocks: list, d: int, rounds: int):
        self.blocks, self.d, self.rounds = blocks, d, rounds

    def sums(self, visit, size):
        total = np.zeros(size)
        for X, part, _ in self.blocks:
            visit(total, X, part)
        return total

    def drawn(self, step, C, left_out, share):
        found = [_draw(X, part, draws, step, C, left_out, share) for X, part, draws in self.blocks]
        return [np.unique(np.concatenate([f[k] for f in found]), axis=0) for k in range(len(C))]


    def first(self, left_out):
        return _first_of([_least(X, part, draws, left_out) for X, part, draws in self.blocks])


#: Rows, and packed bytes, up to which one task runs an algorithm.
TASK_ROWS, TASK_BYTES = 1_000_000, 64_000_000
#: Numbers that the partitions of a pass may send to the driver.
DRIVER_SUMS = 1_000_000


#: Partitions that the models of one job are dealt to by hash.
MODEL_PARTITIONS = 64


def run_passes(packed: Packed, algorithm: Callable[[Passes, list[int]], list], models: int = 1, form: str = "auto") -> list:
    """``algorithm(passes, which)`` for all models: while the rows are few, a task of one job for each model ("task"),
    else with a job for each pass, which serves all models ("passes")."""
    # fills the cache
    row = packed.frame.select("n", F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n"), F.max("p").alias("last")).first()
    n, partitions = row["n"] or 0, (row["last"] or 0) + 1
    if form == "auto":
        form = "task" if n <= TASK_ROWS and n * (packed.d + packed.rounds + 1) * 8 <= TASK_BYTES else "passes"
    if form == "passes":
        return algorithm(JobPasses(packed, partitions), list(range(models)))
    shape = Packed(None, packed.d, packed.rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for m, block in zip(b.column(4).to_pylist(), _blocks(shape, [b]), strict=True):
                held.setdefault(m, []).append(tuple(None if a is None else a.copy() for a in block))
        for m, blocks in held.items():
            result = algorithm(TaskPasses(blocks, shape.d, shape.rounds), [m])[0]
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([pickle.dumps(result)], pa.binary())], ["model", "result"])

    spread = packed.frame.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    dealt = spread.repartition(1) if models == 1 else spread.repartition(MODEL_PARTITIONS, "model")
    found = {r["model"]: pickle.loads(r["result"]) for r in dealt.mapInArrow(run, "model int, result binary").collect()}  # parameters
    return [found[m] for m in range(models)]


def _rows_of(X: np.ndarray, part: np.ndarray, left_out: int) -> np.ndarray:
    if left_out == ALL:
        return X
    keep = part != left_out
    return X if keep.all() else X[:, keep]


def _offsets(sizes: list[int]) -> list[int]:
    return [0, *np.cumsum(sizes).tolist()]


# -- E-step --------------------------------------------------------------------------------------

def _add_estep(sums: np.ndarray, X: np.ndarray, p: GmmParams) -> None:
    """Row count, log-likelihood, masses, and first and second moments about the means."""
    K, d = p.K, p.d
    if not X.shape[1]:
        return
    lp = np.empty((K, X.shape[1]))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        const = -0.5 * (d * LN_2PI + np.log(p.covars).sum(axis=1)) + np.log(p.weights)
        for m in range(K):
            quad = np.zeros(X.shape[1])
            for c in range(d):
                off = X[c] - p.means[m, c]
                quad += off * off * (1.0 / p.covars[m, c])
            lp[m] = const[m] - 0.5 * quad
        mx = lp.max(axis=0)
        ll = mx + np.log(np.exp(lp - mx).sum(axis=0))
    R = np.exp(lp - ll)
    sums[0] += X.shape[1]
    sums[1] += ll.sum()
    sums[2:2 + K] += R.sum(axis=1)
    for m in range(K):
        for c in range(d):
            off = X[c] - p.means[m, c]
            weighted = R[m] * off
            sums[2 + K + m * d + c] += weighted.sum()
            sums[2 + K + (K + m) * d + c] += weighted @ off


def packed_estep(passes: Passes, params: list[GmmParams], left_out: list[int]) -> list[Stats]:
    """One E-step of every model in one pass."""
    params = [p.copy() for p in params]
    at = _offsets([2 + p.K + 2 * p.K * p.d for p in params])

    def visit(sums, X, part):
        for p, skip, a, b in zip(params, left_out, at, at[1:]):
            _add_estep(sums[a:b], _rows_of(X, part, skip), p)

    total, out = passes.sums(visit, at[-1]), []
    for p, a, b in zip(params, at, at[1:]):
        s, K, d = total[a:b], p.K, p.d
        out.append(Stats(float(s[1]), s[2:2 + K], s[2 + K:2 + K + K * d].reshape(K, d), s[2 + K + K * d:].reshape(K, d), int(round(s[0]))))
    return out


# -- k-means start -------------------------------------------------------------------------------

def kmeans_draws(spec: MixedSpec, seed: int, hash_kind: str, rounds: int = KMEANS_ROUNDS) -> list[Column]:
    """A row's uniform numbers: for the choice of the first candidate, and for each round of candidates."""
    if hash_kind == "modular":
        return [modular_uniform(F.col(spec.row_id), t, seed, STREAM_KMEANS) for t in range(rounds + 1)]
    return [(row_hash(hash_kind, F.col(spec.row_id), t, seed, STREAM_KMEANS).cast("double") + F.lit(0.5)) / F.lit(float(HASH_RANGE))
            for t in range(rounds + 1)]


def _nearest(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest centre, and which (the first on ties)."""
    best, at = np.full(X.shape[1], np.inf), np.zeros(X.shape[1], dtype=np.int64)
    for m in range(len(C)):
        dist = np.zeros(X.shape[1])
        for c in range(len(X)):
            dist += (X[c] - C[m, c]) * (X[c] - C[m, c])
        closer = dist < best
        best[closer], at[closer] = dist[closer], m
    return best, at


def _seeds(C: np.ndarray, weight: np.ndarray, K: int, max_iter: int, tol: float) -> np.ndarray:
    """The heaviest candidate, then always the one of the largest weight x squared distance; moved by steps over the candidates."""
    centres = [C[np.argmax(weight)]]
    for _ in range(1, K):
        gain = weight * np.min([((C - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(C[np.argmax(gain)])  # with fewer distinct points than K, some are seeds twice
    return _weighted_lloyd(C, weight, np.array(centres), max_iter, tol)


def packed_kmeans(passes: Passes, left_out: list[int], K: int, max_iter: int = 100, tol: float = 1e-4,
                  oversampling: float | None = None) -> list[np.ndarray]:
    """k-means start and Lloyd steps of every model over all its rows; see ``gmm.hashed_kmeans_means`` for the rule."""
    C = passes.first(left_out)
    running = list(range(len(C)))
    for step in range(1, passes.rounds):
        own = [C[f] for f in running]
        skip = [left_out[f] for f in running]

        def cost(sums, X, part, own=own, skip=skip):
            for i, (c, s) in enumerate(zip(own, skip)):
                sums[i] += _nearest(_rows_of(X, part, s), c)[0].sum()

        costs = passes.sums(cost, len(running))
        running = [f for f, c in zip(running, costs) if c > 0]
        if not running:
            break
        share = [(oversampling or 2.0 * K) / c for c in costs if c > 0]
        for f, new in zip(running, passes.drawn(step, [C[f] for f in running], [left_out[f] for f in running], share)):
            if len(new):
                C[f] = np.unique(np.concatenate([C[f], new]), axis=0)

    at = _offsets([len(c) for c in C])

    def weigh(sums, X, part):
        for c, s, a, b in zip(C, left_out, at, at[1:]):
            sums[a:b] += np.bincount(_nearest(_rows_of(X, part, s), c)[1], minlength=len(c))

    weights = passes.sums(weigh, at[-1])
    centres = [_seeds(c, weights[a:b], K, max_iter, tol) for c, a, b in zip(C, at, at[1:])]
    return packed_lloyd(passes, centres, left_out, max_iter, tol)


def packed_lloyd(passes: Passes, centres: list[np.ndarray], left_out: list[int], max_iter: int, tol: float) -> list[np.ndarray]:
    """k-means steps over all rows until no centre of a model moves by ``tol``; an empty cluster keeps its centre."""
    C = [c.copy() for c in centres]
    K, d = C[0].shape
    size = K * (d + 1)
    running = list(range(len(C)))
    for _ in range(max_iter):
        own, skip = [C[f] for f in running], [left_out[f] for f in running]

        def visit(sums, X, part, own=own, skip=skip):
            for i, (c, s) in enumerate(zip(own, skip)):
                rows = _rows_of(X, part, s)
                at = _nearest(rows, c)[1]
                mine = sums[i * size:(i + 1) * size]
                mine[:K] += np.bincount(at, minlength=K)
                for j in range(d):
                    mine[K + j::d] += np.bincount(at, weights=rows[j] - c[at, j], minlength=K)

        total = passes.sums(visit, size * len(running))
        still = []
        for i, f in enumerate(running):
            s = total[i * size:(i + 1) * size]
            n, shift = s[:K], s[K:].reshape(K, d)
            new = C[f].copy()
            new[n > 0] += shift[n > 0] / n[n > 0, None]
            moved = float(np.sqrt(((new - C[f]) ** 2).sum(axis=1)).max())
            C[f] = new
            if moved >= tol:
                still.append(f)
        running = still
        if not running:
            break
    return C
