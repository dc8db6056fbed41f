"""Readers of the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` into as many parts as ``spark.fleetsift.spread`` says; ``df`` itself where that is unset.

    A small file with one row group is read by one task; a local session deals it out to all cores.  The number is given, since adaptive execution
    would merge small partitions again.  A cluster reads its own many splits and leaves the setting alone: no shuffle is added there, at no size.
    """
    parts = int(df.sparkSession.conf.get("spark.fleetsift.spread", "0"))
    return df.repartition(parts, *keys) if keys and parts else df


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition narrow rows on ``keys`` into ``spark.fleetsift.spread`` parts, where that is unset into as many as a shuffle has, or the session cores.

    For rows that each grow to a whole file's work: a row group of them is one task however many cores there are, and moving the few columns costs little beside the work.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.fleetsift.spread", "0")) or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
