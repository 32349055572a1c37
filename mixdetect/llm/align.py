"""Alignment of two tokenizers by interval coalescing.

The tokens of both tokenizers are byte ranges of one text.  All of them are
sorted by start, the running maximum of their ends is kept, and a group breaks
where a start reaches that maximum: there tokens of both sides end.  Within a
group every token of one side is linked with every token of the other.

A (byte-level byte pairs) never puts a space after another character into a
token, nor does B (whitespace markers).  Texts are therefore cut before spaces
that follow a character other than white space; both sides end there, so a
chunk aligns by itself.  A task aligns a chunk when it first meets it, many
chunks at once, and keeps the result in a bounded table; a document adds its
chunks up.

How many documents hold a pair of ids linked is counted over the whole corpus:
each document's distinct pairs are stored, exploded and summed per pair, and
each A id's highest count follows from a second sum.  The ``FREQUENT`` most
held pairs (a bounded broadcast) meet the documents where they lie; all others
by a shuffled join and a sum per document.

Defined results: a null or empty text, and one whose tokens do not spell out a
space and the text, has no tokens: all its numbers are 0 and its digest is ''.
Repeated rows count each as a document of their own; an empty table gives an
empty result; extra columns are ignored; the string of a special
token in a text is plain text.  Whole texts are aligned, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pieces import MARKER, MODEL, chunk_ids, read_bounded, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: Chunks a task's table holds, and characters of the longest chunk in it.
TABLE_CHUNKS = 400_000
LONG_CHUNK = 256
#: Characters of new chunks aligned at once.
ALIGNED_AT_ONCE = 2_000_000
#: Pairs whose counts are broadcast: three arrays of this length.
FREQUENT = 262_144

_CUT = re.compile(rf"(?<=[^\s{MARKER}]) ")
_RUN = re.compile(rf"[\s{MARKER}] |^ ")


def chunks(text: str) -> list[str]:
    """The text cut before spaces at which tokens of both sides end.  A chunk stands for a space and itself, as the text does."""
    if not text:
        return []
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class TokenizerPair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [self._a_entry(vocabulary.get(i, ""), alphabet) for i in range(max(vocabulary) + 1)]
        self.b_bytes = [self._b_entry(i) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        written = [str(i) for side in (self.a_bytes, self.b_bytes) for i in range(len(side))]
        self.signs = np.array([[mark + w for w in written] for mark in "\n;|,"], dtype=object)  # ids of A, then of B, after each mark

    @staticmethod
    def _a_entry(token: str, alphabet: dict[str, int]) -> bytes:
        return bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def _b_entry(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARKER, " ").encode()

    @property
    def n_b(self) -> int:
        return len(self.b_bytes)

    def encode(self, found: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for chunks that a space goes before."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in found], add_special_tokens=False)]
        b = self.b.encode(found, num_threads=1)
        for i, c in enumerate(found):
            if not c:
                b[i] = chunk_ids(self.b, c)
        return a, b


_loaded: dict[tuple[int, int], TokenizerPair] = {}


def tokenizer_pair(a_json: bytes, b_model: bytes) -> TokenizerPair:
    """The pair of these two files; a Python worker builds it once."""
    key = (hash(a_json), hash(b_model))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TokenizerPair(a_json, b_model)
    return _loaded[key]


@dataclass
class Aligned:
    """Chunks with their tokens, groups and links, a row each; -1 tokens where a side does not spell out the chunk."""

    numbers: np.ndarray  # n_a, n_b, n_groups, n_links
    groups: list[str]  # a1,a2|b1;a3|b2,b3
    first: np.ndarray  # of a chunk's pairs; one more than chunks
    pairs: np.ndarray  # distinct in a chunk: A id * size of B's vocabulary + B id
    times: np.ndarray  # links of the pair

    @classmethod
    def none(cls) -> "Aligned":
        empty = np.zeros(0, dtype=np.int64)
        return cls(np.zeros((0, 4), dtype=np.int64), [], np.zeros(1, dtype=np.int64), empty, empty)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``rows``, pair, times) of these chunks' pairs."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.pairs[at], self.times[at]

    def take(self, rows: np.ndarray) -> "Aligned":
        of, pairs, times = self.pick(rows)
        first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(rows)))])
        return Aligned(self.numbers[rows], [self.groups[i] for i in rows], first, pairs, times)

    def extend(self, other: "Aligned") -> None:
        self.numbers = np.concatenate([self.numbers, other.numbers])
        self.groups += other.groups
        self.first = np.concatenate([self.first, other.first[1:] + self.first[-1]])
        self.pairs, self.times = np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, number) of each group's distinct ids, by group."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by start, group of each interval in that order): a group breaks where a start reaches the maximum of the ends before."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = starts[order][1:] >= reach[:-1]
    return order, np.concatenate([np.zeros(min(1, len(order)), dtype=np.int64), np.cumsum(breaks)])


def align(pair: TokenizerPair, found: list[str]) -> Aligned:
    """Chunks aligned together, on one line of bytes."""
    both = pair.encode(found)
    raw = [b" " + c.encode("utf-8", "surrogatepass") for c in found]
    spelled = np.ones(len(found), dtype=bool)
    for tokens, entries in zip(both, (pair.a_bytes, pair.b_bytes), strict=True):
        parts = [b"".join(map(entries.__getitem__, t)) for t in tokens]
        if parts != raw:
            spelled &= [x == r for x, r in zip(parts, raw, strict=True)]
    good = np.flatnonzero(spelled)
    out = Aligned(np.full((len(found), 4), -1, dtype=np.int64), [""] * len(found), np.zeros(len(found) + 1, dtype=np.int64),
                  np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    if not len(good):
        return out
    chosen = both if len(good) == len(found) else [[side[i] for i in good] for side in both]
    size = [np.array([len(t) for t in side], dtype=np.int64) for side in chosen]
    ids = [np.fromiter(chain.from_iterable(side), dtype=np.int64, count=n.sum()) for side, n in zip(chosen, size, strict=True)]
    chunk = [np.repeat(np.arange(len(good)), n) for n in size]
    length = np.concatenate([pair.a_length[ids[0]], pair.b_length[ids[1]]])
    n_a = len(ids[0])
    ends = np.concatenate([np.cumsum(length[:n_a]), np.cumsum(length[n_a:])])
    starts = ends - length
    order, group = coalesce(starts, ends)
    of = np.empty(len(order), dtype=np.int64)
    of[order] = group
    of_a, of_b = of[:n_a], of[n_a:]

    n_groups = int(group[-1]) + 1
    chunk_of_group = np.zeros(n_groups, dtype=np.int64)
    chunk_of_group[of_a] = chunk[0]
    in_a, in_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
    groups = np.bincount(chunk_of_group, minlength=len(good))
    links = np.add.reduceat(in_a * in_b, np.cumsum(groups) - groups)

    # distinct ids of both sides, every one of a group's A ids with every one of its B ids
    ga, ua, ca = _distinct(of_a, ids[0], len(pair.a_bytes))
    gb, ub, cb = _distinct(of_b, ids[1], pair.n_b)
    width = np.bincount(gb, minlength=n_groups)
    first = np.cumsum(width) - width
    n = width[ga]
    left = np.repeat(np.arange(len(ga)), n)
    right = np.repeat(first[ga] - (np.cumsum(n) - n), n) + np.arange(len(left))
    out_pairs = summed_pairs(chunk_of_group[ga[left]], ua[left] * pair.n_b + ub[right], ca[left] * cb[right])
    out.pairs, out.times = out_pairs[1:]
    out.first = np.concatenate([[0], np.cumsum(np.bincount(good[out_pairs[0]], minlength=len(found)))])
    out.numbers[good] = np.column_stack([*size, groups, links])

    # the written form: a line for a chunk, ; between groups, a comma within a side, a bar between sides
    in_b_side = np.arange(len(of)) >= n_a
    written = np.lexsort((starts, in_b_side, of))
    g, second, c = of[written], in_b_side[written], chunk_of_group[of[written]]
    mark = np.where(c[1:] != c[:-1], 0, np.where(g[1:] != g[:-1], 1, np.where(second[1:] != second[:-1], 2, 3)))
    token = np.concatenate([ids[0], ids[1] + len(pair.a_bytes)])[written]
    lines = "".join(pair.signs[np.concatenate([[0], mark]), token].tolist())[1:].split("\n")
    for i, line in zip(good.tolist(), lines, strict=True):
        out.groups[i] = line
    return out


def summed_pairs(of: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, pair, times), with the times of equal ones summed, in order."""
    if not len(of):
        return of, pairs, times
    by = np.lexsort((pairs, of))
    of, pairs, times = of[by], pairs[by], times[by]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])]))
    return of[new], pairs[new], np.add.reduceat(times, new)


class AlignedTable:
    """The chunks met so far, aligned once each; a full table keeps the more frequent half."""

    def __init__(self, pair: TokenizerPair, limit: int = TABLE_CHUNKS):
        self.pair, self.limit = pair, limit
        self.at: dict[str, int] = {}
        self.aligned, self.used = Aligned.none(), np.zeros(0, dtype=np.int64)

    def _shrink(self) -> None:
        names = list(self.at)
        again = np.array([i for i in np.flatnonzero(self.used > 1).tolist() if len(names[i]) <= LONG_CHUNK], dtype=np.int64)
        kept = again[np.argsort(-self.used[again], kind="stable")[:self.limit // 2]]
        self.aligned, self.used = self.aligned.take(kept), self.used[kept] // 2
        self.at = {names[i]: n for n, i in enumerate(kept.tolist())}

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, groups) of each text, and the (text, pair, times) of all; zeros where a text has no tokens."""
        found = [chunks(t or "") for t in texts]
        new = list(set(chain.from_iterable(found)).difference(self.at))
        if len(self.at) + len(new) > self.limit or sum(map(len, new)) > ALIGNED_AT_ONCE:
            self._shrink()
            new = list(set(chain.from_iterable(found)).difference(self.at))
        start, size = 0, 0
        for end, c in enumerate(new, 1):
            size += len(c)
            if size >= ALIGNED_AT_ONCE or end == len(new):
                self.aligned.extend(align(self.pair, new[start:end]))
                self.at.update(zip(new[start:end], range(len(self.at), len(self.at) + end - start), strict=True))
                start, size = end, 0
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])

        n = np.array([len(text) for text in found], dtype=np.int64)
        at = list(map(self.at.__getitem__, chain.from_iterable(found)))
        rows, of = np.array(at, dtype=np.int64), np.repeat(np.arange(len(found)), n)
        self.used += np.bincount(rows, minlength=len(self.used))
        numbers = np.zeros((len(found), 4), dtype=np.int64)
        some = np.flatnonzero(n)
        if len(some):
            numbers[some] = np.add.reduceat(self.aligned.numbers[rows], (np.cumsum(n) - n)[some], axis=0)
        whole = n > 0
        whole[of[self.aligned.numbers[rows, 0] < 0]] = False
        numbers[~whole] = 0
        stop = np.cumsum(n).tolist()
        written = list(map(self.aligned.groups.__getitem__, at))
        groups = [";".join(written[end - k:end]) if w else "" for end, k, w in zip(stop, n.tolist(), whole.tolist(), strict=True)]
        rows, of = rows[whole[of]], of[whole[of]]
        chunk, pairs, times = self.aligned.pick(rows)
        return numbers, groups, *summed_pairs(of[chunk], pairs, times)


#: Texts taken from an Arrow batch at once, and their characters.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 512, 4_000_000


def _runs(column: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for value in column:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if len(held) >= TEXTS_AT_ONCE or size >= CHARACTERS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None,
               digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) per document: the groups as ``a1,a2|b1;a3|b2,b3``
    (with ``digest`` their SHA-256), and its distinct linked pairs with the number of their links.

    A pair is written as A id * size of B's vocabulary + B id.
    """
    files = read_bounded(a or tokenizer_path(TOKENIZER)), read_bounded(b or tokenizer_path(MODEL))
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        table = AlignedTable(tokenizer_pair(*shared.value))
        gc.disable()  # no cycles arise here, and the collector would walk over the whole table again and again
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1)):
                numbers, groups, of, pairs, times = table.documents(texts)
                if digest:
                    groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *map(pa.array, np.ascontiguousarray(numbers.T)), pa.array(groups, pa.string()),
                     *[pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (pairs, times)]],
                    [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                at += len(texts)
        gc.enable()

    picked = docs.select(docs[id_col], docs[text_col].cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.dtypes[0][1]}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                                  "pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, is_best): documents that hold a pair linked, and whether no other pair of its A id is held by more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = stored(counts, "align-pairs")
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a_id")).agg(F.max("n_docs").alias("most"))  # one row to an id of A's vocabulary
    return (counts.withColumn("a_id", F.expr(f"pair div {n_b}")).join(F.broadcast(best), "a_id")
            .select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best")))


def link_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None,
                 frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``n_best``: links whose pair's number of documents is the highest of its A id; ``count_sum``: that number summed over the links.
    """
    spark = docs.sparkSession
    aligned = alignments(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text", a, b, digest=True)
    aligned = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "align-docs")
    n_b = tokenizer_pair(read_bounded(a or tokenizer_path(TOKENIZER)), read_bounded(b or tokenizer_path(MODEL))).n_b
    counts = stored(pair_counts(aligned, n_b), "align-counts")
    top = counts.orderBy(F.desc("n_docs"), "pair").limit(frequent).toArrow()  # a bounded table
    by = np.argsort(top.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast([top.column(c).to_numpy()[by] for c in ("pair", "n_docs", "is_best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, is_best = shared.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2))
            rows = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy().astype(np.int64))
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            best, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(best, rows[hit], times[hit] * is_best[place[hit]])
            np.add.at(total, rows[hit], times[hit] * n_docs[place[hit]])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(rows[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(total), *rest], ["row", "best", "total", "pairs", "times"])

    summed_up = aligned.select("row", "pairs", "times").mapInArrow(run, "row long, best long, total long, pairs array<long>, times array<long>")
    summed_up = stored(summed_up, "align-sums")
    rest = (summed_up.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
            .join(counts, F.col("pairs") == F.col("pair")).groupBy("row")
            .agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("rest_best"),
                 F.sum(F.col("times") * F.col("n_docs")).alias("rest_total")))
    numbers = summed_up.select("row", "best", "total").join(rest, "row", "left").select(
        "row", (F.col("best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("rest_total", F.lit(0))).alias("count_sum"))
    return aligned.join(numbers, "row").select(F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                               F.col("groups").alias("groups_sha256"))
