"""Ordered scans over keys of any size.

A window over one key runs in one task.  These helpers cut a key into buckets, scan inside each
bucket, and carry one row per bucket across, so a key with a third of all rows still spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def dense_sequence(rows: DataFrame, key: str, bucket: Column, order: list[str], name: str = "seq") -> DataFrame:
    """Gapless number from zero per key; ``bucket`` must grow with ``order``."""
    cut = rows.withColumn("_b", bucket)
    sizes = cut.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)) - 1
    return cut.withColumn("_i", inside).join(offsets, [key, "_b"]).withColumn(name, F.col("_i") + F.col("_off")).drop("_b", "_i", "_off", "_n")


def bucketed_lag(rows: DataFrame, key: str, seq: str, cols: list[str], size: int = 100_000) -> DataFrame:
    """Add ``prev_<col>`` of the previous existing row of the key, across gaps of any length."""
    cut = rows.withColumn("_b", F.floor(F.col(seq) / size))
    here = W.partitionBy(key, "_b").orderBy(seq)
    inside = cut.withColumn("_p", F.lag(F.struct(*cols)).over(here))
    last = cut.groupBy(key, "_b").agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_last"))
    carried = last.select(key, "_b", F.lag("_last").over(W.partitionBy(key).orderBy("_b")).alias("_carry"))
    out = inside.join(carried, [key, "_b"], "left").withColumn("_p", F.coalesce("_p", "_carry"))
    return out.select(*rows.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in cols])


def most_frequent(counted: DataFrame, key: str, count: str, n: int = 1000) -> DataFrame:
    """The ``n`` keys of the greatest counts: any other key has less than one row in ``n``."""
    return counted.where(F.col(key).isNotNull()).orderBy(F.col(count).desc(), key).limit(n).select(key)


def salted_join(many: DataFrame, one: DataFrame, key: str, frequent: DataFrame, salts: int = 32, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key, where a few keys may hold most rows of ``many``.

    Rows of the ``frequent`` keys (a bounded number of keys, see ``most_frequent``, which is why they may be broadcast) are dealt to ``salts`` parts
    and meet as many copies of their one row; all other keys are joined as they are.  Rows without a key are dealt out too and find nothing.
    """
    hot = F.broadcast(frequent.select(key, F.lit(True).alias("_hot")))
    part = F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")
    dealt = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), part).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
