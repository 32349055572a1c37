"""A corpus pipeline over ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of ``documents``; the last returns the mix,
with a document repeated as often as the mix takes it.

The near-duplicate search, the suffix sorting and the compression verdicts
cannot be put in SQL, so there is no SQL for the whole; the tests compare the
pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixdetect.llm import compression, decontam, mixing, repeats, simhash
from mixdetect.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return compression.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that also stand elsewhere; n_chars follows."""
    return repeats.remove_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template with the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated to their sources' targets."""
    return mixing.mixed_rows(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("benchmark_decontamination", decontaminated), ("source_mixing", mixed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
