"""Exposure of findings by management-plane reachability, and its ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fleetsift.sources.rules import SEVERITY_WEIGHT

# Fields that govern a reachable service.
RELEVANT = (
    "ssh_version", "telnet_enabled", "http_server_enabled", "https_server_enabled", "weak_ciphers", "snmp_v3_only",
    "idle_timeout_seconds", "min_password_length", "aaa_enabled",
)


def device_plane(devices: DataFrame, ifaces: DataFrame, lists: DataFrame) -> DataFrame:
    """Per device: interface counts, reachable share of management interfaces, number of lists that were read (``readable``)."""
    mgmt = F.col("is_management")
    up = (F.col("n_addresses") > 0) & F.coalesce(F.col("enabled"), F.lit(True))
    agg = ifaces.groupBy("device_id").agg(
        F.count("*").alias("interfaces"),
        F.count_if(mgmt).alias("management"),
        F.count_if(mgmt.isNull()).alias("unclassified"),
        F.count_if(mgmt & up).alias("reachable"),
    )
    nlists = lists.groupBy("device_id").agg(F.count_if("readable").alias("lists"))
    out = devices.select("device_id").join(agg, "device_id", "left").join(nlists, "device_id", "left")
    filled = out.fillna(0, ["interfaces", "management", "unclassified", "reachable", "lists"])
    return filled.withColumn(
        "reachability", F.when(F.col("management") > 0, F.col("reachable") / F.col("management")).otherwise(0.0)
    )


def assess(findings: DataFrame, plane: DataFrame) -> DataFrame:
    """Determinacy and score of each finding; no number unless exposure was determined."""
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv])
    state = (
        F.when(~F.col("field").isin(*RELEVANT), "not_exposure_relevant")
        .when(F.coalesce("interfaces", F.lit(0)) == 0, "no_interface_data")
        .when((F.col("management") == 0) & (F.col("unclassified") > 0), "indeterminate_interfaces")
        .when(F.col("lists") == 0, "no_acl_data")
        .otherwise("determined")
    )
    score = F.round(F.least(F.lit(1.0), F.col("reachability") * F.element_at(weight, F.col("severity"))), 4)
    rows = findings.join(plane, "device_id", "left").withColumn("determinacy", state)
    return rows.withColumn("exposure_score", F.when(F.col("determinacy") == "determined", score))


def rank(assessed: DataFrame) -> DataFrame:
    """Priority rank among determined findings of an audit run; others keep NULL.

    A run has at most one finding per rule, so the window is bounded by the rule pack.  The
    undetermined ones are ordered last inside the same window and then blanked, which avoids a
    second pass and a join.
    """
    known = F.col("exposure_score").isNotNull()
    w = W.partitionBy("device_id").orderBy(known.desc(), F.col("exposure_score").desc(), "rule_id")
    return assessed.withColumn("priority_rank", F.when(known, F.row_number().over(w)))


def blockers(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("determinacy") != "determined").groupBy("determinacy").agg(F.count("*").alias("findings"))


def ordering(assessed: DataFrame) -> DataFrame:
    """Per run: was a ranking possible, and how many findings could not be assessed."""
    known = F.col("determinacy") == "determined"
    return assessed.groupBy("device_id").agg(
        F.bool_or(known).alias("ranked"), F.count_if(known).alias("determined"), F.count_if(~known).alias("undetermined")
    )
