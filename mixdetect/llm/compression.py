"""Quality rules with compression bands.

A text is rejected when zstandard compresses it too well (repetition) or too
badly (noise), judged on the whole document and on fixed chunks, with limits
that depend on the length: a short text of clean prose compresses little, a
long one more, so one limit cannot serve both.  Simple base rules on words
run first.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged alike; an empty table gives an empty result; extra
columns are kept by ``apply_rules``.  Work and memory are linear in a text's
length, whatever it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD_CHAR = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, whole_ratio double, chunk_max_ratio double, chunk_min_ratio double, "
            "n_chunks long, n_bad_chunks long, kept boolean")


@dataclass(frozen=True)
class Bands:
    """Limits on raw bytes / compressed bytes.

    ``whole`` has rows (bytes up to, least ratio, largest ratio); the last one
    holds for every longer text.  Chunks have ``chunk_bytes`` bytes; a rest of
    under half a chunk belongs to the chunk before it.  A text is rejected when
    its whole ratio is outside its band, or when more than ``bad_share`` of its
    chunks, or ``bad_run`` chunks in a row however long it is, are outside the
    chunk band.

    The lower limits up to 1024 bytes lie between clean text and noise as
    measured (least ratio of sf0.1 texts that pass the base rules, largest of
    base64 words): 1.08 and 1.02 at 129-160 bytes, 1.10 and 1.06 at 161-200,
    1.17 and 1.09 at 201-256, 1.34 and 1.12 at 257-320, 1.34 and 1.16 at
    321-400, 1.41 and 1.20 at 401-512, 1.43 and 1.27 at 513-1024.  Up to 128
    bytes clean text goes down to 0.88 as noise does, so nothing is decided.
    Words of hex digits (1.4-1.8 at 160-1024 bytes) compress like clean text.
    Above, texts labelled good have 1.73-2.15 at 1-2 KB, 1.92-2.22 at 2-4,
    2.12-2.34 at 4-8, 2.22-2.41 at 8-16, 2.34-2.48 above, and unlabelled ones
    up to 2.41, 2.61, 2.65, 2.76, 2.90; their chunks have 1.43-2.26.  Noise or
    template in pieces shorter than a chunk shows in the whole ratio only:
    20-30 % of template in 700-byte pieces (2.4-2.7 at 16 KB) is not told apart.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 2.0), (128, 0.0, 2.1), (160, 1.02, 2.1), (200, 1.07, 2.1), (256, 1.13, 2.1), (320, 1.2, 2.4),
        (400, 1.25, 2.4), (512, 1.3, 2.4), (1024, 1.35, 2.6), (2048, 1.5, 2.8), (4096, 1.7, 3.0), (8192, 1.85, 3.2),
        (16384, 1.95, 3.6), (65536, 2.05, 4.0), (float("inf"), 2.05, 4.2))
    chunk_bytes: int = 1024
    chunk_band: tuple[float, float] = (1.35, 3.0)
    bad_share: float = 0.1
    bad_run: int = 4
    level: int = 3


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside ``window``-word runs that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    size = len(ids)
    if size ** window < 2 ** 63:
        runs = code[:n].copy()
        for k in range(1, window):
            runs = runs * size + code[k:n + k]
    else:  # renumber the runs of each length, so that a pair of numbers always fits
        runs = code
        for k in range(1, window):
            m = len(words) - k
            runs = np.unique(runs[:m] * size + code[k:m + k], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    edges[starts] += 1
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD_CHAR.search(line):
            seen.add(line)
    return n


def ratios(raw: bytes, bands: Bands, comp: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Whole ratio and the ratio of each chunk (an empty text: 1.0, none)."""
    if not raw:
        return 1.0, []
    whole = len(raw) / len(comp.compress(raw))
    n = max(1, int(len(raw) / bands.chunk_bytes + 0.5))
    if n == 1:
        return whole, [whole] if len(raw) >= bands.chunk_bytes // 2 else []
    ends = [bands.chunk_bytes * (k + 1) for k in range(n - 1)] + [len(raw)]
    view, start, out = memoryview(raw), 0, []
    for end in ends:
        out.append((end - start) / len(comp.compress(view[start:end])))
        start = end
    return whole, out


def judge(text: str | None, bands: Bands, comp: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    repeated = repeat_words(words)
    base_failed = n_words < 10 or 100 * repeated > 20 * n_words
    whole, chunks = ratios(raw, bands, comp)
    low, high = next((a, b) for top, a, b in bands.whole if len(raw) <= top)
    out = [not bands.chunk_band[0] <= r <= bands.chunk_band[1] for r in chunks]
    bad, longest = sum(out), max((sum(1 for _ in same) for is_bad, same in groupby(out) if is_bad), default=0)
    fits = low <= whole <= high and bad <= bands.bad_share * len(chunks) and longest < bands.bad_run
    return (n_words, len(text) - len(_SPACE.findall(text)) if words else 0, len(_SYMBOLS.findall(text)),
            dup_lines(text), repeated, base_failed, whole, max(chunks, default=None), min(chunks, default=None),
            len(chunks), bad, fits and not base_failed)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row of measures and the verdict ``kept`` per document; no shuffle."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        comp = zstandard.ZstdCompressor(level=bands.level)
        out = pd.DataFrame([judge(t, bands, comp) for t in texts], columns=names)
        return out.astype({"chunk_max_ratio": "float64", "chunk_min_ratio": "float64"})

    return docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")


def apply_rules(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, all columns unchanged."""

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        comp = zstandard.ZstdCompressor(level=bands.level)
        return pd.Series([judge(t, bands, comp)[-1] for t in texts], dtype="bool")

    return docs.where(keeps(F.col(text_col)))
