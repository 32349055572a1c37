"""Minibatch SGD for the conditional logistic model.

Plan: one job draws the minibatches of *all* steps (row selection depends only
on a seeded hash of (row_id, step), not on the parameters) and takes the steps:

* in one task, while the drawn rows are few (``ROWS_PER_MB_PARTITION``);
* beyond that, as an aggregate job for each step over the rows, which are
  written to the shared checkpoint folder;
* on request, in a barrier stage whose tasks hold a share of every step's rows
  each, add up their own gradients and exchange them by ``allGather``; all make
  the same update.  A lost task restarts the stage, which draws the same rows.
  An exchange takes a second whatever its size, so this pays where a step's own
  work is longer than that.

Several models (one per fold left out) share the jobs; each has its own layout,
sample, parameters and stop rule.
"""

from __future__ import annotations

import base64
import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STREAM_SELECT, STREAM_SLOT, row_hash, selection_cutoff
from ..operators.gmm import batch_matrix, feature_frame
from ..operators.logistic import (gradient, hot_slot_sql, minibatch_fraction, minibatches, modular_draws, partial_gradient,
                                  regularised_update)
from ..operators.packed import ALL
from ..spec import LogisticParams, MixedSpec, SlotLayout
from .session import delete_folder, ensure_checkpoint_dir

ROWS_PER_MB_PARTITION = 200_000
#: Slots that a model may have: its parameters are driver arrays of k x slots.
MAX_SLOTS = 5_000_000


@dataclass
class SgdResult:
    params: LogisticParams
    history: list[tuple[int, int, float, float]]  # (iter, n, grad_l1, lr)
    converged: bool


@dataclass(frozen=True)
class SgdModel:
    """A model to train: its slots, its number of rows, its start, and the part of the rows that it leaves out."""

    layout: SlotLayout
    n: int
    start: LogisticParams
    left_out: int = ALL


@dataclass(frozen=True)
class Schedule:
    max_iterations: int
    reg: float
    lr0: float
    lr_speed: float
    radius: float
    no_progress_tol: float = 1e-5
    no_progress_steps: int = 10


class Trainer:
    """One model's parameters, history and stop rule."""

    def __init__(self, start: LogisticParams, schedule: Schedule):
        self.params, self.schedule = start.copy(), schedule
        self.history: list[tuple[int, int, float, float]] = []
        self.no_progress = 0

    @property
    def stopped(self) -> bool:
        return self.no_progress >= self.schedule.no_progress_steps

    def step(self, i: int, gW: np.ndarray, gV: np.ndarray, n: int) -> None:
        """Step ``i`` with the summed gradients of ``n`` rows."""
        s = self.schedule
        lr = s.lr0 / (1.0 + s.lr_speed * (i - 1))
        gW, gV = gW / n, gV / n
        progress = float(np.abs(gW).sum())
        self.no_progress = self.no_progress + 1 if progress < s.no_progress_tol else 0
        self.history.append((i, int(n), progress, lr))
        self.params = regularised_update(self.params, gW, gV, lr, s.reg, s.radius)


def _own(df: DataFrame, part: str | None, model: SgdModel) -> DataFrame:
    return df if model.left_out == ALL else df.where(F.col(part) != model.left_out)


def _drawn(df: DataFrame, spec: MixedSpec, models: list[SgdModel], k: int, steps: list[int], fraction: float, seed: int, hash_kind: str) -> DataFrame:
    """Rows of ``df`` that model ``k`` draws for the steps."""
    hot = F.coalesce(F.expr(hot_slot_sql(models[k].layout)), F.lit(False))
    return (minibatches(df, spec, models[k].layout.n_slots, steps, fraction, seed, hash_kind)
            .withColumn("hot", hot).withColumn("model", F.lit(k)))


def _drawn_together(df: DataFrame, spec: MixedSpec, models: list[SgdModel], part: str | None, steps: list[int], minibatch_size: int,
                    seed: int) -> DataFrame:
    """The minibatches of all models by modular hashes, in one pass that takes each hash once."""
    cols = [spec.row_id, *spec.cat_cols] + ([spec.cont_array] if spec.cont_array else list(spec.cont_cols))
    cutoffs = [selection_cutoff(minibatch_fraction(m.n, minibatch_size)) for m in models]
    own = df.select(*cols, *([] if part is None else [F.col(part).alias("__part")]))
    t = modular_draws(own, spec.row_id, steps, cutoffs, seed, None if part is None else "__part",
                      [None if m.left_out == ALL else m.left_out for m in models]).select(*cols, "step", "model")
    slots = F.element_at(F.array(*[F.lit(max(1, m.layout.n_slots)) for m in models]), F.col("model") + 1)
    t = t.withColumn("slot", (row_hash("modular", F.col(spec.row_id), F.col("step"), seed, STREAM_SLOT) % slots).cast("int"))
    hot = F.coalesce(*[F.when(F.col("model") == k, F.expr(hot_slot_sql(m.layout))) for k, m in enumerate(models)], F.lit(False))
    return t.select(*cols, "step", "slot", hot.alias("hot"), "model")


def drawn_rows(df: DataFrame, spec: MixedSpec, models: list[SgdModel], part: str | None, max_iterations: int, minibatch_size: int,
               seed: int, hash_kind: str) -> DataFrame:
    """All minibatches of all models: (model, step, row_id, features.., slot, hot), steps 1..max_iterations-1."""
    steps, out = list(range(1, max_iterations)), None
    if hash_kind == "modular":
        return _drawn_together(df, spec, models, part, steps, minibatch_size, seed)
    for k, m in enumerate(models):
        own = _drawn(_own(df, part, m), spec, models, k, steps, minibatch_fraction(m.n, minibatch_size), seed, hash_kind)
        out = own if out is None else out.unionByName(own)
    return out


def draw_models(df: DataFrame, spec: MixedSpec, models: list[SgdModel], part: str | None, max_iterations: int, minibatch_size: int,
                seed: int, hash_kind: str) -> tuple[DataFrame | None, str | None]:
    """:func:`drawn_rows` in a folder, and the folder, to delete after use.

    They are written to the shared checkpoint folder: to one file where they
    are few, otherwise partitioned by step, so that a step reads its own rows
    only.  A step that draws no row takes the row with the least hash for it.
    """
    steps = list(range(1, max_iterations))
    if not steps:
        return None, None
    spark = df.sparkSession
    fractions = [minibatch_fraction(m.n, minibatch_size) for m in models]
    parts = max(1, math.ceil(sum(f * m.n for f, m in zip(fractions, models)) * len(steps) / ROWS_PER_MB_PARTITION))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/minibatches-{uuid.uuid4().hex}"

    drawn = drawn_rows(df, spec, models, part, max_iterations, minibatch_size, seed, hash_kind)
    if parts == 1:
        drawn.repartition(1).write.parquet(folder)
    else:
        salt = F.pmod(F.xxhash64(spec.row_id), F.lit(math.ceil(parts / len(steps))))
        drawn.repartition(parts, "step", salt).write.partitionBy("step").parquet(folder)
    mb = spark.read.schema(drawn.schema).parquet(folder)
    counts = {(r["model"], r["step"]): r["count"] for r in mb.groupBy("model", "step").count().collect()}  # <= models x steps rows
    extra = None
    for k, m in enumerate(models):
        empty = [s for s in steps if not counts.get((k, s))]
        if not empty or not m.n:
            continue
        own = _own(df, part, m)
        least = [F.min(F.struct(row_hash(hash_kind, F.col(spec.row_id), s, seed, STREAM_SELECT).alias("h"),
                                F.col(spec.row_id).alias("id"))).alias(f"m{s}") for s in empty]
        found = own.agg(*least).first()
        for s in empty:
            one = _drawn(own.where(F.col(spec.row_id) == F.lit(found[f"m{s}"]["id"])).limit(1), spec, models, k, [s], 1.0, seed, hash_kind)
            extra = one if extra is None else extra.unionByName(one)
    if extra is not None:
        extra = extra.repartition(1)
        (extra.write if parts == 1 else extra.write.partitionBy("step")).mode("append").parquet(folder)
        mb = spark.read.schema(drawn.schema).parquet(folder)
    return mb, folder


def draw_minibatches(df: DataFrame, spec: MixedSpec, layout: SlotLayout, n: int, max_iterations: int,
                     minibatch_size: int, seed: int, hash_kind: str) -> tuple[DataFrame | None, str | None]:
    """:func:`draw_models` for one model of all rows."""
    one = SgdModel(layout, n, LogisticParams(np.zeros((1, spec.d + 1)), np.zeros((1, layout.n_slots)), 1.0))
    return draw_models(df, spec, [one], None, max_iterations, minibatch_size, seed, hash_kind)


def _loop_in_one_job(mb: DataFrame, spec: MixedSpec, starts: list[LogisticParams], schedule: Schedule, tasks: int, barrier: bool) -> list[SgdResult] | None:
    """All steps of all models in one job of ``tasks`` tasks that each hold a share of the rows; None if a step has no row."""
    width, d, is_array = len(feature_frame(mb, spec).columns) if spec.d else 0, spec.d, bool(spec.cont_array)
    features = [F.col(spec.cont_array).cast("array<double>").alias("features")] if is_array else [F.col(c).cast("double") for c in spec.cont_cols]
    rows = mb.select(*features, F.col("model").alias("__model"), F.col("step").cast("int").alias("__step"), F.col("slot").alias("__slot"),
                     F.col("hot").alias("__hot"), F.col(spec.row_id).alias("__row"))
    starts = [p.copy() for p in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X, keys = [np.empty((0, d + 1))], [np.empty((4, 0), dtype=np.int64)]
        for b in batches:
            own = batch_matrix(b.select(range(width)), d, is_array) if d else np.empty((b.num_rows, 0))
            X.append(np.column_stack([own, np.ones(b.num_rows)]))
            keys.append(np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[width:width + 4]]))
        X, keys = np.concatenate(X), np.concatenate(keys, axis=1)
        order = np.lexsort((keys[1], keys[0]))
        X, (model, step, slot, hot) = X[order], keys[:, order]
        at = model * schedule.max_iterations + step
        trainers = [Trainer(p, schedule) for p in starts]
        context = BarrierTaskContext.get() if barrier else None
        for i in range(1, schedule.max_iterations):
            running = [m for m, t in enumerate(trainers) if not t.stopped]
            if not running:
                break
            mine = []
            for m in running:
                a, b = np.searchsorted(at, [m * schedule.max_iterations + i, m * schedule.max_iterations + i + 1])
                mine.append(partial_gradient(X[a:b], slot[a:b], hot[a:b].astype(bool), trainers[m].params))
            parts = [mine]
            if context is not None:  # the same gradients in the same order everywhere, hence the same update
                parts = [pickle.loads(base64.b64decode(x)) for x in context.allGather(base64.b64encode(pickle.dumps(mine)).decode())]
            for k, m in enumerate(running):
                gW, gV, n = np.zeros_like(trainers[m].params.W), np.zeros_like(trainers[m].params.V), 0
                for part in parts:
                    own_V, slots, own_W, own_n = part[k]
                    gV += own_V
                    gW[:, slots] += own_W
                    n += own_n
                if not n:
                    return
                trainers[m].step(i, gW, gV, n)
        if TaskContext.get().partitionId() == 0:
            cells = [[t.params.V.tobytes() for t in trainers], [t.params.W.tobytes() for t in trainers],
                     [np.array(t.history, dtype=float).tobytes() for t in trainers]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(trainers)), pa.int32()), *[pa.array(c, pa.binary()) for c in cells],
                                              pa.array([t.stopped for t in trainers])], ["model", "v", "w", "history", "converged"])

    dealt = rows.repartition(tasks) if tasks == 1 else rows.repartition(tasks, F.xxhash64("__row", "__step"))
    got = dealt.mapInArrow(run, "model int, v binary, w binary, history binary, converged boolean", barrier=barrier)
    # Spark restarts a failed barrier stage only if a shuffle follows it
    found = (got.repartition(1) if barrier else got).collect()  # one row a model
    if not found:
        return None
    out = []
    for r, p in zip(sorted(found, key=lambda r: r["model"]), starts, strict=True):
        history = np.frombuffer(r["history"]).reshape(-1, 4)
        params = LogisticParams(np.frombuffer(r["v"]).reshape(p.V.shape).copy(), np.frombuffer(r["w"]).reshape(p.W.shape).copy(), p.lam)
        out.append(SgdResult(params, [(int(a), int(b), float(c), float(e)) for a, b, c, e in history], r["converged"]))
    return out


def _loop_of_jobs(mb: DataFrame, spec: MixedSpec, models: list[SgdModel], schedule: Schedule) -> list[SgdResult]:
    """One aggregate job for each step of each model."""
    out = []
    for k, m in enumerate(models):
        trainer = Trainer(m.start, schedule)
        for i in range(1, schedule.max_iterations):
            if trainer.stopped:
                break
            gW, gV, n = gradient(mb.where((F.col("model") == k) & (F.col("step") == i)), trainer.params, spec, m.layout)
            trainer.step(i, gW, gV, n)
        out.append(SgdResult(trainer.params, trainer.history, trainer.stopped))
    return out


def train_sgd_models(df: DataFrame, spec: MixedSpec, models: list[SgdModel], part: str | None = None, *, minibatch_size: int, seed: int,
                     hash_kind: str, loop: str = "auto", tasks: int | None = None, **schedule) -> list[SgdResult]:
    """Train every model on its rows of ``df``; ``loop`` is "auto", "task", "barrier" (of ``tasks`` tasks) or "jobs", with the same results."""
    plan = Schedule(**schedule)
    if loop not in ("auto", "task", "barrier", "jobs"):
        raise ValueError(f"unknown loop {loop!r}")
    # all-continuous input: no categorical slot to model
    if all(m.layout.n_slots == 0 for m in models) or plan.max_iterations <= 1:
        return [SgdResult(m.start.copy(), [], False) for m in models]
    if loop == "auto":
        expected = sum(minibatch_fraction(m.n, minibatch_size) * m.n for m in models) * (plan.max_iterations - 1)
        loop = "task" if expected <= ROWS_PER_MB_PARTITION else "jobs"
    draw = (df, spec, models, part, plan.max_iterations, minibatch_size, seed, hash_kind)
    in_one_job = (spec, [m.start for m in models], plan, tasks or 1 if loop == "barrier" else 1, loop == "barrier")
    if loop != "jobs":
        # rows are drawn by their hashes, so a task that is run again draws the same ones
        got = _loop_in_one_job(drawn_rows(*draw), *in_one_job)
        if got is not None:
            return got
    mb, folder = draw_models(*draw)  # with a row for each step that drew none
    try:
        if loop != "jobs":
            return _loop_in_one_job(mb, *in_one_job)
        mb = mb.persist(StorageLevel.MEMORY_AND_DISK) if sum(m.n for m in models) <= ROWS_PER_MB_PARTITION else mb
        return _loop_of_jobs(mb, spec, models, plan)
    finally:
        mb.unpersist()
        delete_folder(df.sparkSession, folder)


def train_sgd(df: DataFrame, spec: MixedSpec, layout: SlotLayout, n: int, start: LogisticParams, **options) -> SgdResult:
    """Train one model on all rows; options as in :func:`train_sgd_models`."""
    return train_sgd_models(df, spec, [SgdModel(layout, n, start)], **options)[0]


def history_frame(spark, history: list[tuple[int, int, float, float]]) -> DataFrame:
    """(iter, n, grad_l1, lr), one row per step taken."""
    return spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in history],
                                 "iter int, n long, grad_l1 double, lr double")
