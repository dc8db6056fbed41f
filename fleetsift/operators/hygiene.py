"""Corpus hygiene: contamination, manifest reconciliation, sealed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def contaminated(examples: DataFrame, split_lines: DataFrame) -> DataFrame:
    """Examples whose text occurs in a protected split and in no development file.

    Lines are reduced to one row per text with both facts, so each side is joined once and a line
    repeated everywhere does not skew the join.
    """
    facts = split_lines.groupBy("text").agg(
        F.bool_or(F.col("split") == "dev").alias("in_dev"), F.bool_or(F.col("split") != "dev").alias("in_protected")
    )
    return examples.join(facts.where(F.col("in_protected") & ~F.col("in_dev")).select("text"), "text", "left_semi")


def reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Unlisted, missing and changed files, and entries without provenance."""
    both = manifest.select("path", F.col("sha").alias("listed"), "authored_by", F.lit(True).alias("in_manifest")).join(
        files.select("path", F.col("sha").alias("actual"), F.lit(True).alias("on_disk")), "path", "full_outer"
    )
    problem = (
        F.when(F.col("in_manifest").isNull(), "unlisted").when(F.col("on_disk").isNull(), "missing")
        .when(F.col("listed") != F.col("actual"), "changed").when(F.col("authored_by").isNull(), "no_provenance")
    )
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def held_out_violations(manifest: DataFrame, vendor: str) -> DataFrame:
    """The held-out vendor lives only in the holdout split, and nothing else does."""
    ours, sealed = F.col("vendor") == vendor, F.col("split") == "holdout"
    return manifest.where(ours != sealed).select(
        "path", F.when(ours, "held_out_vendor_outside_holdout").otherwise("other_vendor_in_holdout").alias("problem")
    )


def split_guard(labelled: DataFrame, files: DataFrame) -> DataFrame:
    """Labelled files that may be scored, and those that must not be labelled at all."""
    return labelled.join(files, "doc_id").select(
        "doc_id", "split", F.when(F.col("split") == "eval", "scored").otherwise("labelled_outside_eval").alias("outcome")
    )
