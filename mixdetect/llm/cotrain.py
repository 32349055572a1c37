"""Quality classifier by co-training of two views.

One classifier sees the content of a text (hashed words and word shapes), the
other its metadata (source, language, length).  Both start from a bounded
sample of labelled rows.  In each round every unlabelled document is scored by
both; the documents about which one view is most confident become training
rows of the other: one of each distinct feature set, none that the other view
has already or that equals a labelled row of the sample, and from all cells of
equal metadata in turn, so that neither copies nor a large cell fill the
exchange and every round hands over new rows.  At the end each view is calibrated on labelled rows that
no fit has seen, the calibrated views are combined, and all documents scored.

Features are written once; a round is one pass over them, a shuffle of numbers
(hashes and logits) to distinct feature sets, and a top-k of each cell.  On the driver are only the labelled sample (``max_labelled``
rows a class), the exchanged rows (``exchange`` a class, view and round) and
two weight vectors of fixed size.

Defined results: a null or empty text has no content features and is judged by
its metadata; null metadata is a value of its own; a label that is null, or
that contradicts another label of the same id, is not used; repeated rows are
scored each; an empty table gives an empty result; with labels of fewer than
two classes every document gets that class's share as its score; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored

DIMS = 1 << 14  # of each view


@dataclass(frozen=True)
class CoTraining:
    max_labelled: int = 4_000  # labelled rows a class, fitting and calibration together
    exchange: int = 500  # pseudo-labels a class, view and round
    rounds: int = 3
    confident: float = 0.9  # least probability of a pseudo-label
    calibration: int = 5  # every so many labelled rows calibrates and is never fitted
    little: float = 16.0  # content features at which a text's evidence counts half
    l2: float = 1e-3
    steps: int = 80
    seed: int = 42


#: Byte classes of a word's shape: letters, capitals and digits are each one; other ASCII stays; the rest are letters.
_SHAPE = bytes(ord("a") if chr(c).islower() or c > 127 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
               for c in range(256))


def content_features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = {zlib.crc32(w) % DIMS for w in set(raw.lower().split())}
    words = raw.translate(_SHAPE).split()
    found |= {zlib.crc32(w, 1) % DIMS for w in set(words)}
    if words:
        found.add(zlib.crc32(b"distinct%d" % (10 * len(set(raw.split())) // len(words)), 2) % DIMS)
    return np.array(sorted(found), dtype="<u2")


def metadata_features(docs: DataFrame, columns: list[str]) -> Column:
    """Array of feature numbers: each column's value, numbers by their order of magnitude, and pairs with the first column."""
    kinds = dict(docs.dtypes)
    values = []
    for c in columns:
        v = F.col(c).cast("string")
        if kinds[c] not in ("string", "boolean"):
            v = F.floor(2 * F.log2(F.greatest(F.abs(F.col(c)), F.lit(1)).cast("double"))).cast("string")
        values.append(F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit("\x00"))))
    pairs = [F.concat(values[0], F.lit("&"), v) for v in values[1:]]
    return F.array(*[F.pmod(F.crc32(v.cast("binary")), F.lit(DIMS)) for v in values + pairs])


# -- the two linear models, on bounded rows -------------------------------------------------------


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        flat, starts, scale = _flat(rows)
        return np.add.reduceat(np.append(self.weights[flat], 0.0), starts) * (np.array([len(r) > 0 for r in rows]) * scale) + self.bias


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    return (np.concatenate(rows).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])), 1.0 / np.sqrt(np.maximum(sizes, 1)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, p: CoTraining) -> Linear:
    """Logistic regression on unit rows of set features, classes weighted alike, by accelerated gradient steps."""
    flat, starts, scale = _flat(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = weight * np.where(y > 0, 0.5 / max(weight[y > 0].sum(), 1e-9), 0.5 / max(weight[y == 0].sum(), 1e-9))
    w, b, vw, vb = np.zeros(DIMS), 0.0, np.zeros(DIMS), 0.0
    model, rate = Linear(w, b), 4.0
    for _ in range(p.steps):
        model.weights, model.bias = w + 0.9 * vw, b + 0.9 * vb
        error = (1.0 / (1.0 + np.exp(-model.logits(rows))) - y) * weight
        grad = np.bincount(flat, weights=(error * scale)[owner], minlength=DIMS) + p.l2 * model.weights
        vw, vb = 0.9 * vw - rate * grad, 0.9 * vb - rate * error.sum()
        w, b = w + vw, b + vb
    return Linear(w, b)


def calibrate(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of P(y = 1 | logit), by damped Newton steps."""
    a, c = 1.0, 0.0
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        q = 1.0 / (1.0 + np.exp(-(a * logits + c)))
        s = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - y) * logits).sum() + 1e-3 * (a - 1), (q - y).sum()])
        h = np.array([[(s * logits * logits).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-6]])
        da, dc = np.linalg.solve(h, g)
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -2, 2)
    return max(float(a), 0.0), float(c)


# -- rounds over all documents ---------------------------------------------------------------------


def _views(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return ([np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("content")],
            [np.array(x, dtype=np.int64) for x in batch.column("meta").to_pylist()])


def _scored(features: DataFrame, models: tuple[Linear, Linear], columns: str) -> DataFrame:
    """``columns`` of the features, and the two views' logits z0 and z1."""
    shared = features.sparkSession.sparkContext.broadcast(models)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [m.logits(v) for m, v in zip(shared.value, _views(b), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(z[0]), pa.array(z[1])], [*names, "z0", "z1"])

    return features.mapInArrow(run, f"{columns}, z0 double, z1 double")


def _labelled_sample(raw: DataFrame, marked: DataFrame, p: CoTraining) -> list:
    """At most ``max_labelled`` rows a class, in hash order; chosen by row number, then joined to their features."""
    order = F.xxhash64(F.lit(p.seed), "r")
    chosen = None
    for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect():  # two classes
        some = min(1.0, 2.0 * p.max_labelled / r["n"])  # a hash cut first, so that tasks hand on few rows
        part = marked.where((F.col("y") == r["y"]) & (F.pmod(order, F.lit(1 << 30)) < int(some * (1 << 30)))).orderBy(order).limit(p.max_labelled)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    return sorted(raw.join(F.broadcast(chosen), F.col("row") == F.col("r")).select("row", "y", "content", "meta", "same").collect(),
                  key=lambda r: r["row"])


def _most_confident(scored: DataFrame, view: int, y: int, taken: DataFrame, p: CoTraining) -> list[Row]:
    """(row, same) of the best of each cell, then the second of each, and so on; ``taken`` has the feature sets left out."""
    z = F.col(f"z{view}") if y else -F.col(f"z{view}")
    least = float(np.log(p.confident / (1 - p.confident)))
    order = [z.desc(), F.xxhash64("row")]
    # a place limit on a row number cuts each task's rows before the shuffle, so a large cell is no large task
    best = (scored.where(z >= least).join(F.broadcast(taken), "same", "left_anti")
            .withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).where(F.col("place") <= p.exchange))
    return best.orderBy("place", *order).limit(p.exchange).select("row", "same").collect()


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          metadata: tuple[str, ...] = ("source", "lang", "n_chars"), params: CoTraining = CoTraining(), threshold: float = 0.5) -> DataFrame:
    """doc_id, labelled, text_score, meta_score, score (calibrated probabilities of label 1) and kept (score >= threshold)."""
    p = params

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [content_features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(found, pa.binary()), b.column("meta")],
                                             ["row", "doc_id", "content", "meta"])

    known = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
             .agg(F.min(label_col).alias("y"), F.max(label_col).alias("__most")).where("y = __most and id is not null").select("id", "y"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"), metadata_features(docs, list(metadata)).alias("meta"))
    found = rows.mapInArrow(extract, "row long, doc_id long, content binary, meta array<long>")
    raw = stored(found.withColumns({"cell": F.xxhash64("meta"), "same": F.xxhash64("content", "meta")}), "cotrain-features")
    narrow = raw.select("row", "doc_id").join(known, F.col("doc_id") == F.col("id")).select(F.col("row").alias("r"), "y")
    marked = stored(narrow, "cotrain-labelled")
    features = raw.join(marked.hint("shuffle_hash") if marked.count() > 200_000 else F.broadcast(marked),
                        F.col("row") == F.col("r"), "left").drop("r")
    sample = _labelled_sample(raw, marked, p)
    y = np.array([r["y"] for r in sample], dtype=np.float64)
    if len(sample) < 2 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return features.select("doc_id", F.col("y").isNotNull().alias("labelled"), *[F.lit(share).alias(c) for c in
                               ("text_score", "meta_score", "score")], F.lit(share >= threshold).alias("kept"))
    held = np.array([zlib.crc32(b"%d:%d" % (p.seed, r["row"])) % p.calibration == 0 for r in sample])
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), dtype=bool)  # too few labels to set some aside
    views = [[np.frombuffer(bytes(r["content"]), dtype="<u2") for r in sample], [np.array(r["meta"], dtype=np.int64) for r in sample]]
    fitted = np.flatnonzero(~held)
    training = [([v[k] for k in fitted], list(y[fitted]), [1.0] * len(fitted)) for v in views]
    used = [{r["same"] for r in sample} for _ in views]

    def fit_views() -> tuple[Linear, Linear]:
        return tuple(fit(t[0], np.array(t[1]), np.array(t[2]), p) for t in training)

    models = fit_views()
    for _ in range(p.rounds):
        scored = stored(_scored(features.where("y is null"), models, "row long, cell long, same long").groupBy("same").agg(
            F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("cell", "z0", "z1")]), "cotrain-round")
        moved: list[dict[int, float]] = [{}, {}]
        for teacher in (0, 1):
            taken = raw.sparkSession.createDataFrame([(k,) for k in used[1 - teacher]], "same long")
            for label in (0, 1):
                for r in _most_confident(scored, teacher, label, taken, p):
                    moved[1 - teacher][r["row"]] = float(label)
                    used[1 - teacher].add(r["same"])
        asked = sorted(set(moved[0]) | set(moved[1]))
        if not asked:
            break
        few = raw.sparkSession.createDataFrame([(r,) for r in asked], "r long")
        for r in raw.join(F.broadcast(few), F.col("row") == F.col("r")).select("row", "content", "meta").collect():
            own = (np.frombuffer(bytes(r["content"]), dtype="<u2"), np.array(r["meta"], dtype=np.int64))
            for pupil in (0, 1):
                if r["row"] in moved[pupil]:
                    for into, value in zip(training[pupil], (own[pupil], moved[pupil][r["row"]], 0.5), strict=True):
                        into.append(value)
        models = fit_views()

    checked = np.flatnonzero(held) if held.any() else np.arange(len(y))
    scales = [calibrate(m.logits([v[k] for k in checked]), y[checked]) for m, v in zip(models, views, strict=True)]
    prior = float(np.log((y[checked].sum() + 1) / (len(checked) - y[checked].sum() + 1)))
    # of the views' log-odds, the prior's are counted once
    z = [F.col(f"z{i}") * a + c for i, (a, c) in enumerate(scales)]
    chance = lambda x: 1.0 / (1.0 + F.exp(-x))
    n = F.octet_length("content") / 2
    flagged = features.select("*", F.col("y").isNotNull().alias("labelled"), (n / (n + p.little)).alias("weight"))
    # a text of few words says little: its log-odds are drawn towards the prior's
    z[0] = prior + (z[0] - prior) * F.col("weight")
    return (_scored(flagged, models, "doc_id long, labelled boolean, weight double")
            .select("doc_id", "labelled", chance(z[0]).alias("text_score"), chance(z[1]).alias("meta_score"),
                    chance(z[0] + z[1] - prior).alias("score"))
            .withColumn("kept", F.col("score") >= threshold))
