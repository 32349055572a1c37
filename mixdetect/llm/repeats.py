"""Exact substring deduplication by sharded suffix sorting.

Every byte covered by a ``LENGTH``-byte (200) string that also starts anywhere
else is removed.  Matches are judged on the input and never cross documents.

1. *Anchors.*  Each window of LENGTH bytes picks the least (then leftmost)
   hash of its K-byte strings.  Equal windows pick the same anchor at the same
   place, so all occurrences of a window meet in the shard of its anchor's
   hash; about one position in 80 is an anchor.  Anchors that occur once end
   here, and where all surroundings (the union of the windows around an
   anchor) are equal, everything in them is repeated.
2. *Shards.*  For the other anchors, the distinct surroundings are sent to the
   anchor's shard.  There the suffixes that start behind the anchor, and the
   reversed prefixes before it, are put in order by deep-shallow sorting
   (``suffix``).  Two windows that start l bytes before the anchor are equal
   exactly if their prefixes agree on l bytes and their suffixes on the rest;
   both are runs in the sorted orders, bounded by the common prefixes.
3. *Cuts.*  The repeated spans of a text are merged and cut out.

An anchor with more than ``HOT`` occurrences is never gathered: its distinct
surroundings are split into single windows, which are counted by 128-bit hash
with map-side sums.

Equal texts share one key (96 bits of two hashes) and one list of spans.
Defined results: a null or empty text, or one of under LENGTH bytes, is left as
it is; copies of a text of LENGTH bytes or more are all emptied, as each byte
also occurs in the other copy; an empty table gives an empty result; extra
columns are kept by ``remove_repeats``.  Long texts are scanned in segments.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .suffix import sort_suffixes

LENGTH = 200
K = 40
WINDOW = LENGTH - K + 1  # K-byte strings in a window
HOT = 200_000  # some 150 MB of a task
#: Bytes that are hashed at once.
SEGMENT = 1_000_000
#: Surroundings that a shard sorts at once (whole anchors).
BLOCK = 100_000

_R = 0x9E3779B97F4A7C15  # odd base of the rolling hash
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(_R, -1, 2 ** 64)
        for name, base in (("up", _R), ("down", inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings of a byte array."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * down[:len(data) - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every run of w values."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, _TOP)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, position, hash) of the anchors of texts, in blocks."""
    pieces: list[tuple[int, int, int]] = []  # text, first window, windows
    size = 0
    for k, t in enumerate(texts):
        for first in range(0, len(t) - LENGTH + 1, SEGMENT):
            n = min(SEGMENT, len(t) - LENGTH + 1 - first)
            if size and size + n > SEGMENT:
                yield _anchors(texts, pieces)
                pieces, size = [], 0
            # a later segment starts one window early, to know the anchor that the segment before it has reported
            pieces.append((k, first - 1, n + 1) if first else (k, first, n))
            size += n + LENGTH
    if pieces:
        yield _anchors(texts, pieces)


def _anchors(texts: list[bytes], pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [texts[k][first:first + n + LENGTH - 1] for k, first, n in pieces]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    h = rolling_hashes(data)
    packed = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(packed, WINDOW)
    inside = np.zeros(len(data) + 1, dtype=np.int8)  # where windows start: they must not reach into the next piece
    inside[starts[:-1]] += 1
    np.add.at(inside, starts[:-1] + np.array([n for _, _, n in pieces]), -1)
    at = (least[np.cumsum(inside[:len(least)], dtype=np.int8) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    piece = np.searchsorted(starts, at, side="right") - 1
    text = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
    position = at - starts[piece] + np.array([p[1] for p in pieces], dtype=np.int64)[piece]
    keep = np.concatenate(([True], (text[1:] != text[:-1]) | (position[1:] != position[:-1]))) if len(at) else np.zeros(0, dtype=bool)
    for k, (_, first, _) in enumerate(pieces):
        if first:
            keep &= (piece != k) | (at != int(least[starts[k]] & np.uint64(0xFFFFFFFF)))
    return text[keep], position[keep], h[at[keep]]


def surroundings(text: bytes, at: int) -> tuple[int, bytes]:
    """Bytes before the anchor, and the union of the windows that hold the anchor whole."""
    first = max(0, at - WINDOW + 1)
    return at - first, text[first:at + LENGTH]


def _surroundings_hash(text: bytes, at: int) -> int:
    before, s = surroundings(text, at)
    return xxhash.xxh3_64_intdigest(s, before)


# -- spark side --------------------------------------------------------------------------------


def keyed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, z): key and zstandard-compressed bytes of each text that is long enough."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        comp = zstandard.ZstdCompressor(level=1)
        return pd.Series([comp.compress(t.encode("utf-8", "surrogatepass")) for t in texts])

    return (docs.where(F.octet_length(text_col) >= LENGTH)
            .select(*text_key(text_col), packed(F.col(text_col)).alias("z")))


def text_key(text_col: str) -> list:
    return [F.xxhash64(F.col(text_col)).alias("k1"),
            F.shiftleft(F.xxhash64(F.lit(1), F.col(text_col)), 32).alias("k2")]  # low half stays free for a position


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, f, k1, kp, n): anchor hash, hash of the surroundings, text key with position, copies."""
    for b in batches:
        texts: dict[tuple[int, int], list] = {}
        for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
            if (k1, k2) in texts:
                texts[k1, k2][1] += 1
            else:
                texts[k1, k2] = [t.as_py().encode("utf-8", "surrogatepass"), 1]
        raw = [t for t, _ in texts.values()]
        k1 = np.array([k[0] for k in texts], dtype=np.int64)
        k2 = np.array([k[1] for k in texts], dtype=np.int64)
        copies = np.array([n for _, n in texts.values()], dtype=np.int64)
        for text, position, h in anchors(raw):
            f = np.array([_surroundings_hash(raw[t], p) for t, p in zip(text.tolist(), position.tolist(), strict=True)],
                         dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h.view(np.int64), f, k1[text], k2[text] + position, copies[text])], ["a", "f", "k1", "kp", "n"])


def _surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open anchors to rows (a, f, k1, kp, n, before, s); s is null for what was sent already."""
    schema = pa.schema([("a", pa.int64()), ("f", pa.int64()), ("k1", pa.int64()), ("kp", pa.int64()), ("n", pa.int64()),
                        ("before", pa.int32()), ("s", pa.binary())])
    plain = zstandard.ZstdDecompressor()
    sent: set[tuple[int, int]] = set()
    for b in batches:
        rows: list[tuple] = []
        if len(sent) > 1_000_000:
            sent.clear()
        for k1, z, places in zip(b.column("k1").to_pylist(), b.column("z"), b.column("places").to_pylist(), strict=True):
            text = plain.decompress(z.as_py())
            copies: dict[tuple, int] = {}  # copies of the text that were scanned in other batches
            for p in places:
                key = (p["a"], p["f"], p["kp"])
                copies[key] = copies.get(key, 0) + p["n"]
            for (a, f, kp), n in copies.items():
                before, s = surroundings(text, kp & 0xFFFFFFFF)
                rows.append((a, f, k1, kp, n, before, None if (a, f) in sent else s))
                sent.add((a, f))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def repeated_windows(group: np.ndarray, before: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, l): windows that start l bytes before the anchor of a row and equal one of another row of its group.

    ``texts`` are distinct surroundings within a group; the anchor starts after
    ``before`` bytes.
    """
    n, left, right = len(texts), WINDOW - 1, LENGTH - K
    prefix = np.zeros((n, left), dtype=np.uint8)
    suffix = np.zeros((n, right), dtype=np.uint8)
    after = np.zeros(n, dtype=np.int64)
    for i, (s, p) in enumerate(zip(texts, before.tolist(), strict=True)):
        head, tail = s[:p][::-1], s[p + K:]
        prefix[i, :p] = np.frombuffer(head, dtype=np.uint8)
        suffix[i, :len(tail)] = np.frombuffer(tail, dtype=np.uint8)
        after[i] = len(tail)
    # the anchors themselves are compared too: a group number for each distinct anchor
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault((g, s[p:p + K]), len(names)) for g, s, p in zip(group.tolist(), texts, before.tolist(), strict=True)],
                     dtype=np.int64)
    runs, reach = [], []
    for strings, size in ((prefix, before.astype(np.int64)), (suffix, after)):
        order, lcp = sort_suffixes(strings, group)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))  # padding is not text
        new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
        lcp[new] = -1
        best = np.maximum(lcp, np.concatenate((lcp[1:], [-1])))
        longest = np.empty(n, dtype=np.int64)
        longest[order] = best
        runs.append((order, lcp))
        reach.append(longest)
    lowest, highest = np.maximum(LENGTH - K - reach[1], 0), np.minimum(reach[0], left)
    rows, starts = [], []
    for l in range(left + 1):
        open_rows = np.flatnonzero((lowest <= l) & (l <= highest))
        if len(open_rows) < 2:
            continue
        key = np.zeros(len(open_rows), dtype=np.int64)
        for (order, lcp), need in zip(runs, (l, LENGTH - K - l), strict=True):
            run = np.empty(n, dtype=np.int64)
            run[order] = np.cumsum(lcp < need)
            key = key * (n + 1) + run[open_rows]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = open_rows[counts[inverse] > 1]
        rows.append(hit)
        starts.append(np.full(len(hit), l))
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _spans(rows: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (row, l) to runs: row, first and last l of consecutive ones."""
    by = np.lexsort((l, rows))
    rows, l = rows[by], l[by]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (l[1:] != l[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(rows)])) - 1
    return rows[first], l[first], l[last]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows, sorted by anchor, to spans (k1, kp, lo, hi): windows starting lo..hi bytes before kp."""
    groups: list[tuple] = []  # (group, before, s, k1, kp, repeated whole)
    state = {"group": 0}

    def answer() -> pa.RecordBatch:
        out = [(k1, kp, 0, WINDOW - 1) for _, _, _, places in groups if len(places) > 1 for k1, kp in places]
        rows, l = repeated_windows(np.array([g[0] for g in groups], dtype=np.int64), np.array([g[1] for g in groups], dtype=np.int64),
                                   [g[2] for g in groups])
        if len(rows):
            for r, lo, hi in zip(*(x.tolist() for x in _spans(rows, l)), strict=True):
                if len(groups[r][3]) == 1:
                    out.append((*groups[r][3][0], lo, hi))
        groups.clear()
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k1", "kp", "lo", "hi"])

    def close(members: dict[int, list]) -> None:
        for before, s, places in members.values():
            groups.append((state["group"], before, s, places))
        state["group"] += 1

    anchor, members = None, {}
    for b in batches:
        for a, f, k1, kp, n, before, s in zip(*(b.column(c).to_pylist() for c in ("a", "f", "k1", "kp", "n", "before", "s")), strict=True):
            if a != anchor:
                if members:
                    close(members)
                    if len(groups) >= BLOCK:
                        yield answer()
                anchor, members = a, {}
            m = members.setdefault(f, [before, s, []])
            if m[1] is None:
                m[1] = s
            if n > 1:
                m[2] += [(k1, kp)] * 2
            else:
                m[2].append((k1, kp))
    if members:
        close(members)
    if groups:
        yield answer()


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of hot anchors to rows (h1, h2, k1, kp, l, n), one per window."""
    for b in batches:
        out: list[tuple] = []
        for k1, kp, n, before, s in zip(*(b.column(c).to_pylist() for c in ("k1", "kp", "n", "before", "s")), strict=True):
            for l in range(max(0, LENGTH - (len(s) - before)), before + 1):
                d = xxhash.xxh3_128_digest(s[before - l:before - l + LENGTH])
                out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), k1, kp, l, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["h1", "h2", "k1", "kp", "l", "n"])


def _release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished steps (its cleaner follows the driver's garbage collection)."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(k1, k2, starts): per text key the sorted arrays ``first`` and ``last`` of byte spans [first, last) that are repeated."""
    scanned = (docs.where(F.octet_length(text_col) >= LENGTH).select(*text_key(text_col), F.col(text_col).alias("text"))
               .mapInArrow(_scan, "a long, f long, k1 long, kp long, n long"))
    found = stored(scanned, "repeats-anchors")
    again = found.groupBy("a").agg(F.sum("n").alias("total"), F.min("f").alias("least"), F.max("f").alias("most")).where("total > 1")
    # written, so that the join below has exchanges of its own and Spark can split a hot anchor in it
    status = stored(again.select(F.col("a").alias("b"), F.when(F.col("least") == F.col("most"), 0).when(F.col("total") > hot, 2)
                                 .otherwise(1).alias("status")), "repeats-status")
    met = stored(found.join(status, F.col("a") == F.col("b")).select("a", "f", "k1", "kp", "n", "status"), "repeats-met")
    _release(docs)
    whole = met.where("status = 0").select("k1", "kp", F.lit(0).cast("long").alias("lo"), F.lit(WINDOW - 1).cast("long").alias("hi"))
    texts = keyed_texts(docs, text_col)

    def with_texts(places: DataFrame) -> DataFrame:
        """Places and their surroundings; the text joins the list of its places once."""
        per_text = places.groupBy(F.col("k1").alias("j1"), F.shiftleft(F.shiftrightunsigned("kp", 32), 32).alias("j2")).agg(
            F.collect_list(F.struct("a", "f", "kp", "n")).alias("places"))
        joined = (texts.groupBy("k1", "k2").agg(F.first("z").alias("z"))
                  .join(per_text, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select("k1", "z", "places"))
        return joined.mapInArrow(_surround, "a long, f long, k1 long, kp long, n long, before int, s binary")

    spans = stored(with_texts(met.where("status = 1")).repartition("a").sortWithinPartitions("a")
                   .mapInArrow(_resolve, "k1 long, kp long, lo long, hi long"), "repeats-spans").unionByName(whole)
    _release(docs)

    hot_places = met.where("status = 2")
    if not hot_places.isEmpty():
        counted = stored(hot_places.groupBy("a", "f").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "kp")).alias("one")), "repeats-hot")
        twice = counted.where("n > 1").select(F.col("a").alias("b"), F.col("f").alias("g"))
        spans = spans.unionByName(hot_places.join(twice, (F.col("a") == F.col("b")) & (F.col("f") == F.col("g")))
                                  .select("k1", "kp", F.lit(0).cast("long").alias("lo"), F.lit(WINDOW - 1).cast("long").alias("hi")))
        windows = stored(with_texts(counted.select("a", "f", F.col("one.k1").alias("k1"), F.col("one.kp").alias("kp"), "n"))
                         .where("s is not null").mapInArrow(_explode_windows, "h1 long, h2 long, k1 long, kp long, l long, n long"),
                         "repeats-windows")
        # a window near two hot anchors comes twice from one place: it is the places that must differ
        place = F.struct("k1", F.col("kp") - F.col("l"))
        same = (windows.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("n").alias("n"))
                .where("p <> q or n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2")))
        spans = spans.unionByName(windows.join(same, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
                                  .select("k1", "kp", F.col("l").alias("lo"), F.col("l").alias("hi")))
    position = F.col("kp").bitwiseAND(F.lit(0xFFFFFFFF))
    return (spans.select(F.col("k1").alias("s1"), F.shiftleft(F.shiftrightunsigned("kp", 32), 32).alias("s2"),
                         F.greatest(position - F.col("hi"), F.lit(0)).alias("first"), (position - F.col("lo") + LENGTH).alias("last"))
            .groupBy("s1", "s2").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching spans within a text of ``size`` bytes."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], min(s["last"], size)) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of what is left."""
    spans = repeated_spans(docs, text_col, hot)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def removal(z: pd.Series, found: pd.Series) -> pd.DataFrame:
        plain, rows = zstandard.ZstdDecompressor(), []
        for packed, s in zip(z, found, strict=True):
            raw = plain.decompress(packed)
            runs = merged(s, len(raw))
            rows.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])

    touched = (keyed_texts(docs, text_col).groupBy("k1", "k2").agg(F.first("z").alias("z"))
               .join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
               .select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), removal("z", "spans").alias("r")))
    touched = stored(touched.select("s1", "s2", "r.*"), "repeats-cut")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text_col), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("whole"))
    return (rows.join(touched, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (F.col("n_bytes") >= LENGTH), "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")))


def remove_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = None, hot: int = HOT) -> DataFrame:
    """The documents with repeated spans cut out of their texts (a character that is cut in two goes whole).

    ``length_col`` names a column of character counts to bring up to date.
    """
    spans = repeated_spans(docs, text_col, hot)

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, found, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            out.append(cut(raw, merged(s, len(raw))).decode("utf-8", "ignore"))
        return pd.Series(out)

    # whole rows are one struct, so that their names cannot clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), *[e.alias(f"__{c}") for c, e in zip(("k1", "k2"), text_key(text_col), strict=True)])
    text = F.col("__row").getField(text_col)
    found = spans.select(F.col("s1").alias("__s1"), F.col("s2").alias("__s2"), F.col("spans").alias("__spans"))
    joined = keyed.join(found, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2"))
                        & (F.octet_length(text) >= LENGTH), "left")
    # only texts with spans go through Python
    touched = F.col("__spans").isNotNull()
    new = F.when(touched, shorten(F.coalesce(F.when(touched, text), F.lit("")),
                                  F.coalesce("__spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))))
    out = joined.withColumn("__new", new)
    changed = {text_col: F.col("__new")}
    if length_col:
        changed[length_col] = F.char_length("__new").cast(dict(docs.dtypes)[length_col])
    old = {c: F.col("__row").getField(c) for c in docs.columns}
    return out.select(*[(F.when(touched, changed[c]).otherwise(old[c]) if c in changed else old[c]).alias(c) for c in docs.columns])
