"""Exact token-length histogram.

Documents are aggregated by their encoded length.  Over that histogram suffix
sums hold, for every length, how many documents and tokens lie above it; from
them totals, quantiles and truncated totals follow for every context limit
without another look at the documents.

The tokenizer is a public byte-pair vocabulary, given as a path and never
trained here.  The driver reads the file; its bytes go to the executors as one
broadcast (a vocabulary of under ``MAX_VOCABULARY_BYTES``, checked).

Defined results: a null or empty text has length 0 and counts; repeated rows
count each; an empty table gives an empty histogram; extra columns are
ignored.  A text is encoded in pieces cut before white space, where the
pre-tokenizer always cuts, so a very long text needs little memory; a run of
white space of any length is merged as one pre-token, apart from its last
character, which goes with what follows.
"""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64_000_000
#: Characters encoded at once.
PIECE = 1_000_000
#: Lengths per block of the two-level suffix sums.
BLOCK = 1024

#: Fixed value: the characters that the pattern takes as white space.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of white space from which a run is not given to the pattern, which looks back over all of it.
RUN = 10_000

_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    """Byte-pair encoder for the lines ``base64-token rank``."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cut a text at places where no token can span: between a character and the white space after it."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encoded_length(text: str | None, enc) -> int:
    if not text:
        return 0
    n = start = 0
    for run in _LONG_RUN.finditer(text):
        # the pattern's own cut: all but the last character, or all at the end of the text
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += _ordinary(text[start:run.start()], enc) + len(enc._encode_single_piece(text[run.start():end].encode()))
        start = end
    return n + _ordinary(text[start:], enc)


def _ordinary(text: str, enc) -> int:
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def with_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(shared.value)
        return pd.Series([encoded_length(t, enc) for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text_col)))


def length_table(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per encoded length, with suffix sums.

    length, n_docs, docs_at_least, tokens_at_least (both of this length or
    more), total_docs, total_tokens, and truncated_total: the tokens left when
    every document is cut to this length.
    """
    counted = with_lengths(docs.select(text_col), text_col, tokenizer, "length")
    hist = stored(counted.groupBy("length").agg(F.count("*").alias("n_docs"))
                  .withColumn("__block", F.expr(f"length div {BLOCK}")), "lengths")
    # one row per block of lengths, then sums within the block
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum(F.col("length") * F.col("n_docs")).alias("__t"))
    later = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("__block", (F.sum("__d").over(later) - F.col("__d")).alias("__dl"),
                           (F.sum("__t").over(later) - F.col("__t")).alias("__tl"),
                           F.sum("__d").over(Window.partitionBy()).alias("total_docs"),
                           F.sum("__t").over(Window.partitionBy()).alias("total_tokens"))
    within = (Window.partitionBy("__block").orderBy(F.col("length").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tokens = F.col("length") * F.col("n_docs")
    return (hist.join(blocks, "__block")
            .withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("__dl"))
            .withColumn("tokens_at_least", F.sum(tokens).over(within) + F.col("__tl"))
            .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least")
                        + F.col("length") * F.col("docs_at_least"))
            .select("length", "n_docs", "docs_at_least", "tokens_at_least", "truncated_total", "total_docs", "total_tokens"))


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) for any limits, from the row of the least length at or above each."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = table.agg(F.max("total_tokens").alias("__all"))
    at = (F.broadcast(asked).join(table, F.col("length") >= F.col("context_limit")).groupBy("context_limit")
          .agg(F.min_by(F.struct("docs_at_least", "tokens_at_least", "length", "n_docs"), "length").alias("r")))
    exact = F.col("r.length") == F.col("context_limit")
    return (asked.join(at, "context_limit", "left").join(F.broadcast(total)).select(
        "context_limit",
        F.coalesce(F.col("__all") - F.col("r.tokens_at_least") + F.col("context_limit") * F.col("r.docs_at_least"),
                   "__all", F.lit(0)).alias("truncated_total"),
        F.coalesce(F.col("r.docs_at_least") - F.when(exact, F.col("r.n_docs")).otherwise(0), F.lit(0)).alias("docs_cut")))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length such that at least that share of the documents is no longer."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    upto = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return (F.broadcast(asked).join(table, upto >= F.col("share") * F.col("total_docs")).groupBy("share")
            .agg(F.min("length").alias("length")))
