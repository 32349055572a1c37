"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, compression, cotrain, decontam, hmm, langid, lengths, mixing, negatives, pieces, repeats, simhash, warc
from .common import documents


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op2_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score(documents(spark, sf_dir))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all evidence, and documents, whose source stands for the host; models from the documents' languages."""
    docs = documents(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = langid.rows_of_pages(pages).unionByName(langid.rows_of_texts(docs).withColumn("markup", F.lit(False)))
    rows = rows.withColumn("id", F.col("id").cast("long"))
    tagged = rows.withColumn("id", F.struct(F.when(~F.col("markup"), F.col("id")).alias("doc_id"),
                                            F.when(F.col("markup"), F.col("id")).alias("page_id")))
    return langid.fuse(tagged, langid.fit_text(docs)).select("id.doc_id", "id.page_id", "*").drop("id")


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("archive", "offset")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every hundredth id; every seventh id has its label moved on by one of ten first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, moved)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_hmm_scores, op2_token_lengths, op3_simhash_dedup, op4_compression_bands, op5_suffix_repeats,
    op6_template_decontamination, op7_language_evidence, op8_water_filling, op9_co_training, op10_warc_round_trip,
    op11_sentence_pieces, op12_hard_negatives, op13_token_alignment)}
