"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import likelihood_ratio, packing, pii_lstm, set_join, temperature_mix
from ..session import cut_lineage
from .common import bitmap, may_hold, set_aside, text_of

#: The stage's own rule for near copies: shingles of five words, similarity 0.8.
COPY_WORDS, COPY_SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the base rules and read like the trusted ones; their columns pass untouched, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    own, back = set_aside(docs, F.col("doc_id"), F.col("text"))
    return likelihood_ratio.score_quality(own, likelihood_ratio.trusted_ids(labels)).where("kept").select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest by doc_id (rows without one come last), then by the text's digest, then by the other columns.

    Rows are told apart by doc_id and text, so different texts under one id are different rows; rows without words are in no group.
    Rows whose key cannot be in a group stay where they are; only the others are shuffled with their texts.
    """
    own, back = set_aside(docs, F.col("doc_id"), F.md5(text_of().cast("binary")).alias("_h"))
    asked = docs.select("doc_id", "text", F.md5(text_of().cast("binary")).alias("_h"))
    rows, _, _ = set_join.jaccard_join(asked, COPY_WORDS, COPY_SIMILAR, carry=("_h",))
    rows = cut_lineage(rows.where("group_id IS NOT NULL").select("group_id", "doc_id", "_h"))
    groups = rows.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    wins = (F.col("first._h") == F.col("_h")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    several = cut_lineage(rows.join(groups, "group_id").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), wins.alias("_wins")).distinct())
    asks = may_hold(bitmap(several.select(F.col("_d").alias("doc_id"), F.col("_k").alias("_h")), "doc_id", "_h"), "doc_id", "_h")
    met = own.where(asks).join(several, (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    first = met.where("_wins").groupBy("doc_id", "_h").agg(F.min(F.struct(*[c for c in own.columns if c not in ("doc_id", "_h")])).alias("row"))
    return own.where(~asks).select(*back).unionByName(met.where("_wins IS NULL").select(*back)).unionByName(first.select("row.*").select(*back))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii_lstm.redact(docs, pii_lstm.train(pii_lstm.training_texts(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and sources below their target weight repeated up to the repetition limit; columns pass untouched."""
    own, back = set_aside(docs, F.col("doc_id"), F.col("source"), temperature_mix.word_tokens().alias("_words"))
    return temperature_mix.mix(own, tokens=F.col("_words")).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)
