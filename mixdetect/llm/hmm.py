"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood of every text.

A text is its words (ASCII lower-cased) and one end token.  Frequent words are
symbols of their own; every other word is emitted as one of ``CLASSES`` classes
(by its ending) and then drawn inside the class by smoothed counts, so each
distinct word of the corpus is modelled and an unseen word has a probability.
Emission tables are bounded by the symbols, never by the corpus.

1. Words of the training documents are counted (map-side counters, one sum).
2. Documents are encoded once to symbols and stored.  Counts of the
   ``HEAD_WORDS`` most frequent words are broadcast (a fixed bound in words and
   bytes per word); other words meet their counts in a shuffled join.
3. Each Baum-Welch round runs the scaled forward and backward recursions over
   all training documents; expected counts are summed per partition and then
   per symbol by Spark; the driver holds only states x symbols.  For training,
   a document is cut into consecutive segments of ``SEGMENT`` tokens, later
   ones starting from a learned state distribution of their own.
4. Scoring runs the forward recursion over whole documents.

Defined results: a null or empty text is the end token alone; a null id counts
as the empty string for the split; repeated rows are scored (and learned from)
each; an empty table gives an empty result; a corpus without training
documents gives the untrained model; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HEAD_WORDS, HEAD_WORD_BYTES = 262_144, 64
CLASSES, ENDING = 256, 3
SEGMENT = 256
#: Distinct words a counting task holds before it passes them on.
COUNTER_WORDS = 400_000
#: Segments that a training task holds at once.
BLOCK_SEGMENTS = 2_048


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    symbols: int = 16_384  # words with an emission of their own
    rounds: int = 5
    stay: float = 0.9  # start value of staying in a state
    spread: float = 0.6  # log-normal spread of the start emissions
    prior: float = 200.0  # pseudo-tokens of the overall distribution in each state's emissions
    seed: int = 42


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLASSES


# -- counts ------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > COUNTER_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, n: int) -> tuple[list[bytes], np.ndarray]:
    """At most n of the most frequent short words, by falling count; words at a count that does not fit whole are left out."""
    short = counts.where(F.octet_length("word") <= HEAD_WORD_BYTES)
    upto, least = 0, None
    for r in short.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).limit(n).collect():
        if upto + r["n"] > n:
            break
        upto, least = upto + r["n"], r["c"]
    if least is None:
        return [], np.empty(0, dtype=np.int64)
    rows = sorted(((-r["c"], bytes(r["word"])) for r in short.where(F.col("c") >= least).collect()))
    return [w for _, w in rows], np.array([-c for c, _ in rows], dtype=np.int64)


def class_sizes(counts: DataFrame, own: list[bytes]) -> np.ndarray:
    """Per class log10 of (tokens + distinct words + 1) among the words without a symbol of their own."""
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in shared.value:
                    total[word_class(w)] += c + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["k", "n"])

    sums = np.ones(CLASSES)
    for r in counts.select("word", "c").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sums[r["k"]] += r["n"]
    return np.log10(sums)


# -- encoding ----------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def encode(rows: DataFrame, head: list[bytes], head_c: np.ndarray, n_own: int, class_log: np.ndarray, n_train_docs: int) -> DataFrame:
    """rid, doc_id, held_out, sym (uint16 bytes), n_tokens, known, c_log (sum of log10(c+1) over known counts),
    in_class (log10 of words inside their classes, without rare words' counts), rare (words not in the head)."""
    shared = rows.sparkSession.sparkContext.broadcast((head, head_c))
    state: dict = {}

    def table() -> tuple:
        if not state:
            words, c = shared.value
            state["at"] = _Numbers({w: k for k, w in enumerate(words)})
            state["log"] = np.log10(c + 1.0)
            symbol = np.arange(len(words), dtype=np.int64)
            symbol[n_own:] = [n_own + word_class(w) for w in words[n_own:]]
            state["symbol"] = symbol
        return state["at"], state["log"], state["symbol"]

    end, end_log = n_own + CLASSES, float(np.log10(n_train_docs + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, logs, symbol = table()
        for b in batches:
            syms, n_tokens, known, c_log, in_class, rare = [], [], [], [], [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                ids = np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))
                out = np.empty(len(words) + 1, dtype="<u2")
                out[-1] = end
                in_head = ids >= 0
                out[:-1][in_head] = symbol[ids[in_head]]
                missing = [words[k] for k in np.flatnonzero(~in_head)]
                out[:-1][~in_head] = [n_own + word_class(w) for w in missing]
                log = logs[ids[in_head]]
                cls = out[:-1][out[:-1] >= n_own].astype(np.int64) - n_own
                syms.append(out.tobytes())
                n_tokens.append(len(words) + 1)
                known.append(int(in_head.sum()) + (n_train_docs > 0))
                c_log.append(float(log.sum()) + end_log)
                in_class.append(float(log[ids[in_head] >= n_own].sum() - class_log[cls].sum()))
                rare.append(missing)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), b.column("held_out"), pa.array(syms, pa.binary()), pa.array(n_tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(c_log, pa.float64()), pa.array(in_class, pa.float64()),
                 pa.array(rare, pa.list_(pa.binary()))],
                ["rid", "doc_id", "held_out", "sym", "n_tokens", "known", "c_log", "in_class", "rare"])

    return rows.mapInArrow(run, "rid long, doc_id long, held_out boolean, sym binary, n_tokens long, known long, "
                                "c_log double, in_class double, rare array<binary>")


# -- model -------------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # states
    inner: np.ndarray  # state distribution at the start of a later training segment
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @staticmethod
    def initial(symbol_counts: np.ndarray, p: HmmParams) -> Model:
        rng = np.random.default_rng(p.seed)
        overall = (symbol_counts + 1.0) / (symbol_counts + 1.0).sum()
        emit = overall[:, None] * np.exp(p.spread * rng.standard_normal((len(overall), p.states)))
        even = np.full(p.states, 1.0 / p.states)
        move = np.full((p.states, p.states), (1 - p.stay) / max(1, p.states - 1))
        np.fill_diagonal(move, p.stay if p.states > 1 else 1.0)
        return Model(even, even, move, emit / emit.sum(axis=0))

    def updated(self, sums: dict[int, np.ndarray], overall: np.ndarray, p: HmmParams) -> Model:
        k = p.states
        emit = np.zeros_like(self.emit)
        for s, g in sums.items():
            if s >= 0:
                emit[s] = g
        emit += p.prior * overall[:, None]
        move = np.array([sums[-1 - j] for j in range(k)]) + 1.0 / k
        start, inner = sums[-1 - k] + 1.0 / k, sums[-2 - k] + 1.0 / k
        return Model(start / start.sum(), inner / inner.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each whole symbol sequence, by the scaled forward recursion."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[k]) for k in order])
    total = np.zeros(len(seqs))
    if not len(seqs):
        return total
    flat = np.concatenate([seqs[k] for k in order]).astype(np.int64)
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
    a = None
    for t in range(int(lengths[0])):
        n = int(active[t])
        e = model.emit[flat[offset[:n] + t]]
        a = model.start * e if a is None else (a[:n] @ model.move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log(c)
    out = np.empty(len(seqs))
    out[order] = total
    return out


def expected(model: Model, segments: list[np.ndarray], first: np.ndarray, sums: dict[str, np.ndarray]) -> None:
    """Add the expected counts of segments to ``sums`` (emit, move, start, inner, loglik)."""
    order = np.argsort([-len(s) for s in segments], kind="stable")
    lengths = np.array([len(segments[k]) for k in order])
    first = first[order]
    n, steps, k = len(order), int(lengths[0]), model.move.shape[0]
    sym = np.zeros((steps, n), dtype=np.int64)
    for i, j in enumerate(order):
        sym[:lengths[i], i] = segments[j]
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha, scale = np.zeros((steps, n, k)), np.ones((steps, n))
    for t in range(steps):
        m = int(active[t])
        e = model.emit[sym[t, :m]]
        a = np.where(first[:, None], model.start, model.inner) * e if t == 0 else (alpha[t - 1, :m] @ model.move) * e
        c = a.sum(axis=1)
        alpha[t, :m], scale[t, :m] = a / c[:, None], c
    sums["loglik"][0] += np.log(scale).sum()
    beta = np.ones((n, k))
    gamma, moved = alpha, np.zeros((k, k))  # gamma overwrites alpha from the end
    back = model.move.T.copy()
    for t in range(steps - 1, -1, -1):
        m = int(active[t])
        nxt = int(active[t + 1]) if t + 1 < steps else 0
        if nxt:
            ahead = beta[:nxt] * model.emit[sym[t + 1, :nxt]] / scale[t + 1, :nxt, None]
            moved += alpha[t, :nxt].T @ ahead
            beta[:nxt] = ahead @ back
        gamma[t, :m] *= beta[:m]
    sums["move"] += moved * model.move
    live = np.arange(n)[None, :] < active[:, None]
    g, s = gamma[live], sym[live]
    for j in range(k):
        sums["emit"][:, j] += np.bincount(s, weights=g[:, j], minlength=len(model.emit))
    sums["start"] += gamma[0][first].sum(axis=0)
    sums["inner"] += gamma[0][~first].sum(axis=0)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u2") for x in column]


def baum_welch_round(encoded: DataFrame, model: Model) -> tuple[dict[int, np.ndarray], float]:
    """Expected counts over all rows of ``encoded``: by symbol, and -1-j (moves from state j), -1-K, -2-K (starts)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    k = model.move.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = {"emit": np.zeros_like(m.emit), "move": np.zeros((k, k)), "start": np.zeros(k), "inner": np.zeros(k),
                "loglik": np.zeros(1)}
        segments: list[np.ndarray] = []
        first: list[bool] = []

        def flush() -> None:
            for at in range(0, len(segments), BLOCK_SEGMENTS):
                expected(m, segments[at:at + BLOCK_SEGMENTS], np.array(first[at:at + BLOCK_SEGMENTS]), sums)
            segments.clear()
            first.clear()

        for b in batches:
            for s in _sequences(b.column(0)):
                for at in range(0, len(s), SEGMENT):
                    segments.append(s[at:at + SEGMENT])
                    first.append(at == 0)
            if len(segments) >= BLOCK_SEGMENTS:
                flush()
        flush()
        used = np.flatnonzero(sums["emit"].any(axis=1))
        rows = np.concatenate([sums["emit"][used], sums["move"], [sums["start"], sums["inner"]],
                               [np.concatenate((sums["loglik"], np.zeros(k - 1)))]])
        keys = np.concatenate([used, -1 - np.arange(k + 3)])
        yield pa.RecordBatch.from_arrays([pa.array(keys)] + [pa.array(rows[:, j]) for j in range(k)],
                                         ["sym", *(f"g{j}" for j in range(k))])

    schema = "sym long, " + ", ".join(f"g{j} double" for j in range(k))
    total = (encoded.select("sym").mapInArrow(run, schema).groupBy("sym").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)]))
    sums = {r["sym"]: np.array(r[1:]) for r in total.collect()}
    shared.destroy()
    for key in range(k + 3):
        sums.setdefault(-1 - key, np.zeros(k))
    return sums, float(sums.pop(-3 - k)[0])


def symbol_counts(encoded: DataFrame, n_symbols: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_symbols, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(np.concatenate(_sequences(b.column(0))), minlength=n_symbols)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["sym", "n"])

    counts = np.zeros(n_symbols)
    for r in encoded.select("sym").mapInArrow(run, "sym long, n long").groupBy("sym").agg(F.sum("n").alias("n")).collect():
        counts[r["sym"]] = r["n"]
    return counts


def train(encoded: DataFrame, n_symbols: int, p: HmmParams) -> tuple[Model, list[float]]:
    """The model after ``rounds`` rounds over all rows, and the segments' log-likelihood before each round.

    The start model is drawn around the overall symbol counts.
    """
    counts = symbol_counts(encoded, n_symbols)
    overall = (counts + 1.0) / (counts + 1.0).sum()
    model, history = Model.initial(counts, p), []
    for _ in range(p.rounds if counts.sum() else 0):
        sums, loglik = baum_welch_round(encoded, model)
        history.append(loglik)
        model = model.updated(sums, overall, p)
    return model, history


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: HmmParams = HmmParams(),
          folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (this model), both log10."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       (F.pmod(F.crc32(key), F.lit(folds)) == held_out_fold).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = stored(word_counts(training), "hmm-counts")
    n_docs = training.count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0)
    head, head_c = head_of(counts, HEAD_WORDS)
    n_own = min(params.symbols, len(head))
    encoded = stored(encode(rows, head, head_c, n_own, class_sizes(counts, head[:n_own]), n_docs), "hmm-encoded")
    model, _ = train(encoded.where(~F.col("held_out")), n_own + CLASSES + 1, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = forward(shared.value, _sequences(b.column("sym"))) / np.log(10.0)
            kept = ["rid", "doc_id", "held_out", "n_tokens", "known", "c_log", "in_class"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ll)], [*kept, "log_sym"])

    scored = encoded.drop("rare").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, "
                                                  "c_log double, in_class double, log_sym double")
    # rare words meet their counts; unseen ones find none and add log10(1) = 0
    rare = (encoded.select("rid", F.explode("rare").alias("w")).join(counts, F.col("w") == F.col("word"))
            .groupBy(F.col("rid").alias("r")).agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs")))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rare, F.col("rid") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("c_log") + logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("log_sym") + F.col("in_class") + logs).alias("score"))
