"""Connected components by alternating large and small stars, with one shared table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import merge_with_totals, shared_table


def _stars(near: DataFrame) -> DataFrame:
    """``near`` (u, v): every v of u is linked to the smallest of u and its neighbours, and so is u."""
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return merge_with_totals(near, least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (u, v), each link once in either direction -> (node, root) for every node of a link.

    ``root`` is the smallest node that can be reached.  A large star moves the larger neighbours of each node to
    the smallest one, a small star moves the smaller ones; rounds end when neither changes a link.
    """
    state = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        state = shared_table(small, name)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
