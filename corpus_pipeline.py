"""A training-data pipeline over ``documents``: language, exact and near copies, mixing, packing.

Each stage works on all that the one before it kept; its result is written to the shared checkpoint folder and read again.  Stages but the last
return the columns of ``documents``.  Ids are taken to tell documents apart; a document without an id is never dropped as a copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.llm import exact, langid, mixing, packing, simhash
from fleetsift.llm.common import documents, empty_if_null, shared_table

#: Positions of the mix that lie together in one file.
STRETCH = 4096


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, without a text or without a likely language go.

    What is likely follows from the calibrated scores of held-out documents and the number of learned languages (``langid.least_score``).
    """
    model = langid.learn(docs)
    if model is None:
        return docs.limit(0)
    found = langid.predict(docs, model, names=("_lang_pred", "_score"))
    return found.filter((F.col("_lang_pred") != langid.NO_LANGUAGE) & (F.col("_score") >= langid.least_score(docs, model))).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the one of smallest id."""
    points = F.char_length(empty_if_null(F.col("text")))
    groups = exact.exact_groups(docs.select("doc_id", "text", points.alias("points")), carry=["points"])
    gone = groups.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("points").alias("_points"), "text_sha256").distinct()
    same = (F.col("doc_id") == F.col("_id")) & (points == F.col("_points")) & (F.sha2(exact.normalised("text").cast("binary"), 256) == F.col("text_sha256"))
    return docs.join(gone.hint("merge"), same, "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one of smallest id."""
    found = simhash.near_duplicates(docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document at least once, those of sources short of their target again; written in stretches of the mix's order."""
    mixed = mixing.mix(docs, names=("_epoch", "_slot", "_position"))
    stretch = F.floor(F.col("_position") / STRETCH)
    return mixed.withColumn("_stretch", stretch).repartition("_stretch").sortWithinPartitions("_stretch", "_position").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in as few sequences of 2048 tokens as can be; a document that the mix repeats is packed as often."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language models, XXH64 and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
