"""What several operators of the subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsift.session import checkpoint_dir

#: White space that separates words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merge_with_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` joined on ``key`` to ``totals``, an aggregate with one row per key; merged at every size, so that it never passes through the driver.

    The key's hash is a second key: with it Spark deals the aggregate anew, and only what was just dealt lets adaptive execution split the
    rows of a frequent key.
    """
    again = F.xxhash64(key)
    return rows.withColumn("_again", again).join(totals.withColumn("_again", again).hint("merge"), [key, "_again"]).drop("_again")


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
