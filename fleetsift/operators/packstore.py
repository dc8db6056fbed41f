"""Pack versions as tables: selection, order, lineage, inventory, regression, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsift.sources import packs
from fleetsift.sources.literals import Literal

_PLATFORMS = Literal("platform_pack", "vendor string, os_family string, pack_id string", [(v, o, f"{v}/{o}") for v, o in packs.PACKS])


def find_pack(files: DataFrame) -> DataFrame:
    """Exact platform lookup; an unknown platform finds nothing."""
    return files.join(_PLATFORMS.frame(files.sparkSession), ["vendor", "os_family"], "left")


def semver(version: Column) -> Column:
    """Sortable numeric form; a malformed version sorts lowest."""
    parts = F.transform(F.split(version, "[.]"), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(F.lit(-1))).otherwise(parts)


def active_versions(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per pack: its active version, or what is wrong with the selection.

    A pin wins over the status; two active versions and a pin without a version are errors.  ``pins``: pack_id, version and whether it is ``pinned``; of several pins the smallest counts.
    """
    pinned = pins.groupBy("pack_id").agg(F.min(F.when(F.col("pinned"), F.col("version"))).alias("pinned")).where(F.col("pinned").isNotNull())
    joined = versions.join(pinned, "pack_id", "full_outer")
    chosen = F.when(F.col("pinned").isNotNull(), F.col("pinned") == F.col("version")).otherwise(F.col("status") == "active")
    agg = joined.groupBy("pack_id").agg(
        F.min(F.when(chosen, F.col("version"))).alias("lo"),
        F.max(F.when(chosen, F.col("version"))).alias("hi"),
        F.max("pinned").alias("pinned"),
    )
    outcome = (
        F.when(F.col("lo").isNull() & F.col("pinned").isNotNull(), "pinned_version_missing")
        .when(F.col("lo") != F.col("hi"), "two_active_versions")
        .when(F.col("lo").isNotNull(), "active")
    )
    return agg.withColumn("outcome", outcome).where(F.col("outcome").isNotNull()).select(
        "pack_id",
        F.when(F.col("outcome") == "active", F.col("lo")).when(F.col("outcome") == "pinned_version_missing", F.col("pinned")).alias("version"),
        "outcome",
    )


def newest_first(versions: DataFrame) -> DataFrame:
    """Rank of each version inside its pack; a pack's versions are few and bounded."""
    w = W.partitionBy("pack_id").orderBy(semver(F.col("version")).desc(), "status")
    return versions.withColumn("newest_first", F.row_number().over(w))


def lineage(versions: DataFrame) -> DataFrame:
    """Previous version of each version of a pack, and the highest patch of its minor line."""
    key = semver(F.col("version"))
    w = W.partitionBy("pack_id").orderBy(key)
    line = W.partitionBy("pack_id", key[0], key[1])
    return versions.withColumn("previous_version", F.lag("version").over(w)).withColumn("highest_patch", F.max(key[2]).over(line))


def pattern_diff(patterns: DataFrame, chain: DataFrame) -> DataFrame:
    """Patterns added or withdrawn between each version and its parent.

    ``chain`` has (pack_id, version, parent_version); a full outer join on the pattern id.
    """
    child = chain.join(patterns, ["pack_id", "version"]).select("pack_id", "version", "pattern_id", "source", F.lit(True).alias("in_child"))
    parent = (
        chain.join(patterns.withColumnRenamed("version", "parent_version"), ["pack_id", "parent_version"])
        .select("pack_id", "version", "pattern_id", F.col("source").alias("parent_source"), F.lit(True).alias("in_parent"))
    )
    both = child.join(parent, ["pack_id", "version", "pattern_id"], "full_outer")
    change = F.when(F.col("in_parent").isNull(), "added").when(F.col("in_child").isNull(), "withdrawn")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(
        "pack_id", "version", "pattern_id", "change", F.coalesce("source", "parent_source").alias("source")
    )


def inventory(patterns: DataFrame, versions: DataFrame, active: DataFrame) -> DataFrame:
    """Every version with its pattern counts and whether it is the active one."""
    counts = patterns.groupBy("pack_id", "version").agg(
        F.count("*").alias("patterns"), F.count_if(F.col("source") == "admin_trained").alias("admin_trained")
    )
    live = active.where(F.col("outcome") == "active").select("pack_id", "version", F.lit(True).alias("live"))
    return (
        versions.select("pack_id", "version").distinct()
        .join(counts, ["pack_id", "version"], "left")
        .join(live, ["pack_id", "version"], "left")
        .select("pack_id", "version", F.coalesce("patterns", F.lit(0)).alias("patterns"),
                F.coalesce("admin_trained", F.lit(0)).alias("admin_trained"), F.coalesce("live", F.lit(False)).alias("is_active"))
    )


def example_regression(examples: DataFrame) -> DataFrame:
    """Failing examples: a positive that does not match or a negative that does.

    ``examples`` rows are ``(pattern_id, pattern, text, expected)``.
    """
    hit = F.regexp(F.col("text"), F.col("pattern"))
    return examples.where(hit != F.col("expected")).select(
        "pattern_id", "text", F.when(F.col("expected"), "positive_does_not_match").otherwise("negative_matches").alias("failure")
    )


def invariants(patterns: DataFrame, versions: DataFrame, roles: DataFrame, examples: DataFrame) -> DataFrame:
    """Violations of the pack rules, one row per (rule, pack, subject)."""
    dup = patterns.groupBy("pack_id", "version", "pattern_id").count().where(F.col("count") > 1).select(
        F.lit("duplicate_pattern_id").alias("rule"), "pack_id", F.concat_ws(":", "version", "pattern_id").alias("subject")
    )
    dup_role = roles.groupBy("pack_id", "name_pattern").count().where(F.col("count") > 1).select(
        F.lit("duplicate_role_pattern").alias("rule"), "pack_id", F.col("name_pattern").alias("subject")
    )
    unsigned = versions.where((F.col("status") == "active") & F.col("checksum").isNull()).select(
        F.lit("active_without_checksum").alias("rule"), "pack_id", F.col("version").alias("subject")
    )
    own_parent = versions.where(F.col("parent_version") == F.col("version")).select(
        F.lit("own_parent").alias("rule"), "pack_id", F.col("version").alias("subject")
    )
    both = examples.groupBy("pack_id", "pattern_id", "text").agg(
        F.bool_or("expected").alias("pos"), F.bool_or(~F.col("expected")).alias("neg")
    ).where(F.col("pos") & F.col("neg")).select(
        F.lit("example_in_both_lists").alias("rule"), "pack_id", F.concat_ws(":", "pattern_id", "text").alias("subject")
    )
    return dup.unionByName(dup_role).unionByName(unsigned).unionByName(own_parent).unionByName(both)
