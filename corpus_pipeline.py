"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, packing; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import language_id, near_dedup, packing, suffix_dedup
from panelspark.llm.common import among, load, materialise, release, released


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, no letters, or a calibrated score under the model's bound.

    The bound is set on held-back documents (``LanguageModel.fit``). Each row counts by itself, repeated or without
    ``doc_id``. A table with rows but none to learn a language from is an error.
    """
    model = language_id.train(docs)
    release()  # what the driver's Python trained on
    if model.langs == [language_id.UNKNOWN] and not docs.isEmpty():
        raise ValueError("no document to learn a language from: none outside the held-out fold has both text and lang")
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= model.reject)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: five-word shingles, similarity of at least 0.8.

    Each row is a document of its own, whatever its ``doc_id``: rows without one are grouped and kept like others, and
    of repeated rows of one ``doc_id`` those that are alike leave one. The row with the least ``doc_id`` stays, one
    without ``doc_id`` only where no other is there, then the least by a hash of all columns; rows equal in all are
    interchangeable.
    """
    with released(spark):  # what grouping the rows wrote goes before the next stage begins
        rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), keep=True)
        groups = near_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
        groups = groups.select(F.col("doc_id").alias("__row"), "component_id")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "__row")
        ordered = rows.select("__row", order.alias("__order")).join(groups, "__row")
        kept = ordered.groupBy("component_id").agg(F.min("__order").getField("__row").alias("__kept"))
        gone = materialise(groups.join(kept, "component_id").where("__row <> __kept").select("__row"), keep=True)
    return among(rows, gone, "__row", inside=False).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut from each text what repeats an earlier document in runs of 50 bytes."""
    return suffix_dedup.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("packing", pack_sequences),
]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with released(spark):  # frees what a stage wrote besides its result
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
    return docs
