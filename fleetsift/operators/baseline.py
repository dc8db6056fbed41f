"""Fleet baselines: what a cohort agrees on, and who deviates.

Counts per (cohort, field, state) are map-side combined.  A field that a member never reports
is unknown, and that number is cohort size minus reported rows, so the dense grid is never
built to get a baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.operators.fields import DETERMINABLE

MIN_COHORT_SIZE = 5
MIN_MAJORITY_RATIO = 0.75


def cohort() -> Column:
    return F.coalesce(
        F.when(F.col("peer_group") != "", F.col("peer_group")),
        F.concat_ws("/", F.coalesce("vendor", F.lit("unknown-vendor")), F.coalesce("os_family", F.lit("unknown-os"))),
    )


def device_label() -> Column:
    return F.coalesce(F.when(F.col("hostname") != "", F.col("hostname")), F.left("device_id", F.lit(12)))


def dense_grid(members: DataFrame, states: DataFrame) -> DataFrame:
    """Every member by every field its cohort reports; a missing one is unknown.

    The fields of a cohort are a bounded vocabulary, kept as one array per cohort.
    """
    vocabulary = states.groupBy("cohort").agg(F.collect_set("field").alias("fields"))
    grid = members.join(vocabulary, "cohort").select("cohort", "device_id", F.explode("fields").alias("field"))
    return grid.join(states.select("device_id", "field", "state"), ["device_id", "field"], "left").withColumn(
        "state", F.coalesce("state", F.lit("unknown"))
    )


def field_baselines(members: DataFrame, states: DataFrame) -> DataFrame:
    """Size, counts, majority and outcome of every (cohort, field)."""
    sizes = members.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    known = F.col("state").isin(*DETERMINABLE)
    per_field = states.groupBy("cohort", "field").agg(
        F.count_if(known).alias("determinable"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in DETERMINABLE],
    )
    rows = per_field.join(sizes, "cohort").withColumn("indeterminate", F.col("cohort_size") - F.col("determinable"))
    tops = F.array(*[F.struct(F.col(f"n_{s}").alias("n"), F.lit(s).alias("s")) for s in DETERMINABLE])
    # Ties cannot matter at the majority ratio; the later state name is taken.
    top = F.array_max(tops)
    outcome = (
        F.when(F.col("cohort_size") < MIN_COHORT_SIZE, "cohort_too_small")
        .when(F.col("determinable") == 0, "no_determinable_states")
        .when(top["n"] / F.col("determinable") < MIN_MAJORITY_RATIO, "no_majority")
        .otherwise("compared")
    )
    rows = rows.withColumn("top", top).withColumn("outcome", outcome)
    compared = F.col("outcome") == "compared"
    return rows.select(
        "cohort", "field", "outcome", "cohort_size", "determinable", "indeterminate", *[f"n_{s}" for s in DETERMINABLE],
        F.when(compared, F.col("top.s")).alias("majority_state"), F.when(compared, F.col("top.n")).otherwise(0).alias("majority_count"),
    )


def outliers(members: DataFrame, states: DataFrame) -> DataFrame:
    """Readable members that differ from their cohort's majority; an abstention never deviates."""
    base = field_baselines(members, states).where(F.col("outcome") == "compared").select(
        "cohort", "field", "majority_state", "majority_count", "determinable"
    )
    readable = states.where(F.col("state").isin(*DETERMINABLE))
    rows = readable.join(base, ["cohort", "field"]).where(F.col("state") != F.col("majority_state"))
    return rows.join(members.select("device_id", device_label().alias("label")), "device_id")


def fleet_summary(members: DataFrame, states: DataFrame) -> DataFrame:
    """Per cohort: devices, baselines established and deviations."""
    base = field_baselines(members, states)
    est = base.groupBy("cohort").agg(F.count("*").alias("baselines"), F.count_if(F.col("outcome") == "compared").alias("comparable"))
    dev = outliers(members, states).groupBy("cohort").agg(F.count("*").alias("deviations"))
    sizes = members.groupBy("cohort").agg(F.count("*").alias("devices"), F.min("device_id").alias("first_device"))
    return sizes.join(est, "cohort", "left").join(dev, "cohort", "left").fillna(0, ["baselines", "comparable", "deviations"])
