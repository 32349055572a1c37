"""SimHash near-duplicates with vantage-point trees.

Distinct 64-bit fingerprints at Hamming distance ``max_bits`` (3) or less are
linked; a component of links is one group of near-duplicates.

The search is exact.  Of two fingerprints at distance 3 or less, one half
(32 bits) differs in at most one bit.  For each half, a tree of eight levels
deals the fingerprints out: level i has the vantage point's four bits i, and a
child holds the fingerprints at one Hamming distance (0..4) from it.  By the
triangle inequality, distances to a vantage point differ by no more than the
fingerprints do, so two halves at distance 1 or less are in the same leaf or in
leaves that differ by 1 at one level: a fingerprint lives in its leaf (shard)
and visits the up to eight shards over that boundary.  Inside a shard a second
vantage-point tree over the bytes of the whole fingerprint, pruned with what
is left of the distance, finds the pairs.

Copies collapse to one fingerprint first.  A shard answers with a spanning
forest of its links (at most one edge per fingerprint), so a dense group never
becomes its square in rows.  A shard with more than ``SHARD_ROWS`` residents is
split: each part holds the tree and asks for its share of the fingerprints.

Defined results: a null or empty text, or one of only white space, has
fingerprint zero, and such texts are linked like any others; the component id
is the least non-null id of the component (null if there is none); repeated
rows each get a result row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, stored
from .graph import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Vantage point of the trees (any value is right; these are the digits of the golden ratio).
VANTAGE = 0x9E3779B97F4A7C15
LEVELS, SPAN = 8, 5  # levels of a half's tree; distances 0..4 at a level
SHARD_ROWS = 20_000
LEAF = 48
#: Shingles whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash (unsigned) of the k-word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist(),
                                                                  strict=True)], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, __k1, __k2, fp): fingerprints as signed longs; the keys are 128 hash bits of the id and the text."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), *_row_key(id_col, text_col), simhash(F.col(text_col)).alias("fp"))


def _row_key(id_col: str, text_col: str) -> list:
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"__k{k}") for k in (1, 2)]


# -- shards: the upper tree --------------------------------------------------------------------


def shard_rows(fps: DataFrame) -> DataFrame:
    """(shard, fp, home): a fingerprint's home shard and the shards over its boundaries, for both halves."""
    digits = [F.bit_count(F.shiftrightunsigned("fp", 4 * i).bitwiseAND(F.lit(15)).bitwiseXOR(F.lit((VANTAGE >> 4 * i) & 15)))
              .alias(f"d{i}") for i in range(2 * LEVELS)]
    rows = []
    for half in range(2):
        leaf = F.lit(half * SPAN ** LEVELS)
        for i in range(LEVELS):
            leaf = leaf + F.col(f"d{half * LEVELS + i}") * SPAN ** i
        rows.append(F.struct(leaf.alias("shard"), F.lit(True).alias("home")))
        rows += [F.struct(F.when(F.col(f"d{half * LEVELS + i}") < SPAN - 1, leaf + SPAN ** i).alias("shard"),
                          F.lit(False).alias("home")) for i in range(LEVELS)]
    return (fps.select("fp", *digits).select("fp", F.explode(F.array(*rows)).alias("r"))
            .select(F.col("r.shard").alias("shard"), "fp", F.col("r.home").alias("home")).where("shard is not null"))


# -- inside a shard: the lower tree --------------------------------------------------------------


class VantageTree:
    """Exact range search: level i splits by the Hamming distance of byte i to the vantage point's."""

    def __init__(self, items: np.ndarray, at: np.ndarray | None = None, level: int = 0):
        self.at = np.arange(len(items)) if at is None else at
        self.items, self.level, self.children = items, level, {}
        if len(self.at) > LEAF and level < 8:
            self.vantage = np.uint64((int(items[self.at[0]]) >> 8 * level) & 255)
            d = self._distance(items[self.at])
            self.children = {int(c): VantageTree(items, self.at[d == c], level + 1) for c in np.unique(d)}

    def _distance(self, x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(((x >> np.uint64(8 * self.level)) & np.uint64(255)) ^ self.vantage).astype(np.int64)

    def pairs(self, asked: np.ndarray, who: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (index of the question, index of the item) within the radius."""
        if not self.children:
            step = max(1, 2_000_000 // max(1, len(self.at)))
            for k in range(0, len(who), step):
                w = who[k:k + step]
                i, j = np.nonzero(np.bitwise_count(asked[w][:, None] ^ self.items[self.at][None, :]) <= radius)
                if len(i):
                    yield w[i], self.at[j]
            return
        d = self._distance(asked[who])
        for c, child in self.children.items():
            rest = left - np.abs(d - c)
            near = rest >= 0
            if near.any():
                yield from child.pairs(asked, who[near], rest[near], radius)


class Forest:
    """Components of what was linked so far; ``link`` returns only the edges that joined two."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        x, y = self.label[a], self.label[b]
        new = x != y
        if not new.any():
            return []
        pairs = np.unique(np.stack([np.maximum(x[new], y[new]), np.minimum(x[new], y[new])], axis=1), axis=0)
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                v = up[v]
            return v

        out = []
        for p, q in pairs.tolist():
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((max(p, q), min(p, q)))
        old = np.array(list(up))
        moved = np.arange(len(self.label))
        moved[old] = [top(v) for v in up]
        self.label = moved[self.label]
        return out


def shard_links(fp: np.ndarray, home: np.ndarray, ask: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest (rows of two fingerprints) of the links between a shard's residents and all who ask."""
    values, index = np.unique(fp, return_inverse=True)
    residents, asking = np.unique(index[home]), np.unique(index[ask])
    if not len(residents) or not len(asking) or len(values) < 2:
        return np.empty((0, 2), dtype=np.uint64)
    tree, forest, out = VantageTree(values[residents]), Forest(len(values)), []
    for q, r in tree.pairs(values[asking], np.arange(len(asking)), np.full(len(asking), radius), radius):
        out += forest.link(asking[q], residents[r])
    return values[np.array(out, dtype=np.int64)] if out else np.empty((0, 2), dtype=np.uint64)


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def answer(t: pa.Table, upto: int) -> Iterator[pa.RecordBatch]:
            shard = t["shard"].to_numpy()[:upto] * 4096 + t["part"].to_numpy()[:upto]
            fp = t["fp"].to_numpy()[:upto].view(np.uint64)
            home, ask = (t[c].to_numpy()[:upto].astype(bool) for c in ("home", "ask"))
            edges = np.flatnonzero(np.diff(shard)) + 1
            out = [shard_links(fp[i:j], home[i:j], ask[i:j], radius)
                   for i, j in zip(np.r_[0, edges], np.r_[edges, upto], strict=True) if j - i > 1]
            links = np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k]).view(np.int64)) for k in range(2)],
                                             ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            first, last = held[0].slice(0, 1), batch.slice(batch.num_rows - 1, 1)
            same = all(first[c][0] == last[c][0] for c in ("shard", "part"))
            if same:
                continue  # the shard goes on
            t = pa.concat_tables(held)
            shard, part = t["shard"].to_numpy(), t["part"].to_numpy()
            upto = int(np.flatnonzero((shard != shard[-1]) | (part != part[-1]))[-1]) + 1
            yield from answer(t, upto)
            held = [t.slice(upto)]
        if held:
            t = pa.concat_tables(held)
            yield from answer(t, t.num_rows)

    return run


def links(distinct_fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """(a, b): a subset of the pairs within the radius that connects the same components."""
    if radius > 3:
        raise ValueError("the shards are exact up to 3 differing bits")
    rows = shard_rows(distinct_fps)
    hot = stored(rows.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
                 .select("shard", F.least(F.ceil(F.col("n") / SHARD_ROWS), F.lit(4096)).cast("int").alias("parts")), "simhash-hot")
    dealt = join_by_key(rows, hot, ["shard"], hot.count()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (dealt.withColumn("own", own)
             .withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
             .select(F.col("shard").cast("long").alias("shard"), F.col("part").cast("long").alias("part"), "fp", "home",
                     (F.col("part") == F.col("own")).alias("ask")))
    return dealt.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_search(radius), "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and per distinct fingerprint its root, its group's least id and its copies."""
    fps = stored(fingerprints(docs, id_col, text_col, k), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_exact")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius), "a", "b")
    least = (distinct.join(roots, F.col("fp") == F.col("node")).groupBy(F.col("root").alias("__root"))
             .agg(F.min("least").alias("component_id")))
    linked = roots.join(least, F.col("root") == F.col("__root")).select("node", "root", "component_id")
    table = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("__fp"), "n_exact", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # written, so that the join with the rows has exchanges of its own and a fingerprint of many copies is split in it
    return fps, stored(table, "simhash-table")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    radius: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_exact (documents with this fingerprint)."""
    fps, table = _groups(docs, id_col, text_col, k, radius)
    return fps.join(table, F.col("fp") == F.col("__fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_exact")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
             radius: int = MAX_BITS) -> DataFrame:
    """The documents with one row left of each group: that with the least id (null ids last)."""
    fps, table = _groups(docs, id_col, text_col, k, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")).alias("m")
    stays = fps.join(table, F.col("fp") == F.col("__fp")).groupBy("root").agg(first).select(
        F.col("m.__k1").alias("__s1"), F.col("m.__k2").alias("__s2"))
    # whole rows are one struct, so that their names cannot clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), *_row_key(id_col, text_col))
    # repeated rows share their key: one of them stays
    one = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy(F.xxhash64("__row")))
    return (keyed.join(stays, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2")), "left_semi")
            .withColumn("__one", one).where("__one = 1").select("__row.*"))
