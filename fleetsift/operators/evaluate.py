"""Compliance evaluation: devices by applicable rules to findings with four verdicts.

Rules are tables: one row per rule, its conditions as rows of (rule, ordinal, operator, typed operand), its references and declined mappings.  ``compiled`` brings a rule's conditions
together on the rule's side, which is the small one.  A device looks its rules up by equality on platform scope (its vendor or any, its family or any), so there is no cross join and no bound on the
number of rules; scopes that many devices share are salted.  The other join is the one with the device's observations on (device_id, field).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsift.functions.conditions import CONDITION, condition, expected_text, outcomes
from fleetsift.functions.tristate import strict_all
from fleetsift.session import pin
from fleetsift.sources.rules import BASE_RULES, VERDICTS, Rule

ENGINE_VERSION = "0.1.0"
TRAINABLE = ("no_match", "low_confidence", "uncalibrated_confidence", "unparsed_block")
ANY = "*"
#: Parts of the devices of one scope, each of which meets all rules of that scope.
SCOPE_SALTS = 16
REFS = "array<struct<framework:string,control_id:string>>"
_RULE = ("rule_ord", "rule_id", "severity", "field", "vendors", "os_families", "on_absent_default", "on_absent_unsupported", "on_capability_unknown")


@dataclass(frozen=True)
class Rulebook:
    """Rules as tables of any size.

    ``rules``: rule_ord, rule_id, severity, field, vendors, os_families (arrays, ``*`` admits anything), on_absent_default, on_absent_unsupported, on_capability_unknown.
    ``conditions``: rule_id, ordinal and the columns of a condition struct; ``refs``: rule_id, framework, control_id; ``gaps``: rule_id, framework, reason.
    """

    rules: DataFrame
    conditions: DataFrame
    refs: DataFrame
    gaps: DataFrame


Rules = Rulebook | Sequence[Rule]


def _literal(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"),
            strings(r.vendors).alias("vendors"), strings(r.os_families).alias("os_families"), F.lit(r.on_absent_default).alias("on_absent_default"),
            F.lit(r.on_absent_unsupported).alias("on_absent_unsupported"), F.lit(r.on_capability_unknown).alias("on_capability_unknown"),
            F.array(*[condition(*c) for c in r.conditions]).cast(f"array<{CONDITION}>").alias("conditions"),
            F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(c).alias("control_id")) for f, c in r.refs]).cast(REFS).alias("refs"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def _merged(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows of a rule table for a join that is merged: Spark takes such tables for small by their compressed size, and a broadcast would gather them in the driver."""
    return rows.hint("merge") if isinstance(rules, Rulebook) else rows


def compiled(spark: SparkSession, rules: Rules) -> DataFrame:
    """One row per rule with its ``conditions`` in order, ``expected`` text, ``refs`` and ``rule_frameworks``.

    A rule without conditions is left out, as nothing could be judged by it; of a repeated ordinal every condition holds.
    """
    if isinstance(rules, Rulebook):
        fields = [c.split(":")[0] for c in CONDITION[len("struct<") : -1].split(",")]
        own = F.struct("ordinal", F.struct(*fields).cast(CONDITION).alias("c"))
        conds = rules.conditions.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(own), lambda a, b: a["ordinal"] - b["ordinal"]), lambda x: x["c"]).alias("conditions"))
        refs = rules.refs.groupBy("rule_id").agg(F.collect_list(F.struct("framework", "control_id")).cast(REFS).alias("refs"))
        rows = rules.rules.select(*_RULE).join(_merged(conds, rules), "rule_id").join(_merged(refs, rules), "rule_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast(REFS)))
    else:
        rows = _literal(spark, rules)
    named = F.array_sort(F.array_distinct(F.transform("refs", lambda r: r["framework"])))
    return rows.withColumns({"expected": F.array_join(F.transform("conditions", expected_text), " and "), "rule_frameworks": named})


def applicable_rules(devices: DataFrame, rules: Rules = BASE_RULES, selection: Sequence[str] = (), carry: Sequence[str] = (), declined: DataFrame | None = None) -> DataFrame:
    """One row per (device, applicable rule); an empty selection means no framework filter, ``carry`` names more columns of the device.

    ``declined`` (rule_id, framework, reason) leaves the rules that it names, with its rows as ``gaps``: they meet on the rules' side, before the devices.

    A wildcard admits anything; a named list never admits an unknown value.  A rule lies under each of its scopes once, a device looks under the four that can hold it.
    """
    book = compiled(devices.sparkSession, rules)
    if selection:
        book = book.where(F.arrays_overlap("rule_frameworks", F.array(*[F.lit(s) for s in selection])))
    if declined is not None:
        gaps = declined.groupBy("rule_id").agg(F.collect_list(F.struct("framework", "reason")).alias("gaps"))
        book = book.join(_merged(gaps, rules), "rule_id")
    scope = lambda c: F.when(F.array_contains(c, ANY), F.array(F.lit(ANY))).otherwise(F.array_distinct(F.array_compact(c)))
    book = book.withColumn("_vendor", F.explode(scope("vendors"))).withColumn("_os", F.explode(scope("os_families")))
    book = book.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SCOPE_SALTS - 1))))
    either = lambda c: F.explode(F.array_distinct(F.array_compact(F.array(F.col(c), F.lit(ANY)))))
    # Platform may be a long expression (detection); it is looked at several times below.
    rows = pin(devices, "_p", F.struct("vendor", "os_family")).select("device_id", "_p.vendor", "_p.os_family", *carry)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("device_id"), F.lit(SCOPE_SALTS)).cast("int")).withColumn("_vendor", either("vendor")).withColumn("_os", either("os_family"))
    return rows.join(_merged(book.drop("vendors", "os_families"), rules), ["_vendor", "_os", "_salt"]).drop("_vendor", "_os", "_salt")


def absence_action(state: Column) -> Column:
    return (
        F.when(state == "absent_default", F.col("on_absent_default"))
        .when(state == "absent_unsupported", F.col("on_absent_unsupported"))
        .otherwise(F.col("on_capability_unknown"))
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """Status and unknown reason of joined (device, rule, observation) rows.

    Expects the observation columns ``state, unknown_reason, value_type, v_*, evidence_count,
    default_ref``; ``state`` is NULL when the device has no such field.
    """
    rows = pin(rows, "outcome", strict_all(outcomes(F.col("conditions")))).withColumn("action", absence_action(F.col("state")))
    judged = (F.col("state") == "present") | (F.col("action") == "evaluate")
    proven = (F.coalesce("evidence_count", F.lit(0)) > 0) | F.coalesce(F.col("default_ref") != "", F.lit(False))
    status = (
        F.when(F.col("state").isNull(), "unknown")
        .when(
            judged,
            F.when(F.col("outcome").isNull(), "unknown").when(~proven, "unknown").when(F.col("outcome"), "pass").otherwise("fail"),
        )
        .when(F.col("action").isin("pass", "fail", "not_applicable"), F.col("action"))
        .otherwise("unknown")
    )
    reason = (
        F.when(F.col("state").isNull(), "no_match")
        .when(judged, F.when(F.col("outcome").isNull(), "rule_type_mismatch").when(~proven, "no_evidence"))
        .when(~F.col("action").isin("pass", "fail", "not_applicable"), F.coalesce("unknown_reason", F.lit("capability_unknown")))
    )
    return rows.withColumn("status", status).withColumn("finding_reason", reason).drop("action")


def evaluate_fleet(
    devices: DataFrame, observations: DataFrame, rules: Rules = BASE_RULES, *, audit_id: str = "run", selection: Sequence[str] = ()
) -> DataFrame:
    """Findings of every device and applicable rule, as one plan."""
    pairs = applicable_rules(devices, rules, selection)
    obs = observations.drop("vendor", "os_family")
    rows = verdicts(pairs.join(obs, ["device_id", "field"], "left"))
    return rows.select(
        F.concat_ws(":", F.lit(audit_id), "device_id", "rule_id").alias("finding_id"),
        F.lit(audit_id).alias("audit_id"),
        "device_id", "rule_id", "rule_ord", "field", "status", "severity",
        F.struct(
            F.coalesce("state", F.lit("unknown")).alias("state"), "value_type", "v_bool", "v_num", "v_str", "v_list",
        ).alias("observed"),
        "expected",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        # The citation of a default stays on verdicts; an abstention carries evidence only.
        F.when(F.col("status") != "unknown", F.col("default_ref")).alias("absence_reason"),
        F.col("finding_reason").alias("unknown_reason"),
        F.struct(F.lit(ENGINE_VERSION).alias("engine_version")).alias("provenance"),
    )


def citations(devices: DataFrame, observations: DataFrame, rules: Rules = BASE_RULES, *, audit_id: str = "run") -> DataFrame:
    """Findings that pass or fail by lines of a file: finding_id, device_id, rule_id, status and ``evidence``, the matched lines in the order of the file.

    ``devices`` carry the ``file_id`` they were read from, ``observations`` their ``evidence`` (line, raw_line).  Verdicts and citations come of one join.
    """
    pairs = applicable_rules(devices, rules, carry=["file_id"])
    rows = verdicts(pairs.join(observations.drop("vendor", "os_family"), ["device_id", "field"], "left"))
    cited = F.array_sort(F.transform("evidence", lambda e: F.struct(e["line"].alias("line"), F.col("file_id").alias("file_id"))))
    return rows.where(F.col("status").isin("pass", "fail") & (F.size("evidence") > 0)).select(
        F.concat_ws(":", F.lit(audit_id), "device_id", "rule_id").alias("finding_id"), "device_id", "rule_id", "status", cited.alias("evidence")
    )


def verdict_summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of the four verdicts, zeros included, from one conditional aggregate."""
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == v).alias(f"n_{v}") for v in VERDICTS], F.count("*").alias("rules_evaluated")
    )


def needs_training(findings: DataFrame) -> DataFrame:
    return findings.where((F.col("status") == "unknown") & F.col("unknown_reason").isin(*TRAINABLE))
