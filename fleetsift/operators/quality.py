"""The model's invariants as jobs: one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions.text import line_hash


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Explode the names of the broken rules of each row."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()]))
    return rows.select(*key, F.explode_outer(broken).alias("rule")).where(F.col("rule").isNotNull())


def field_rules() -> dict[str, Column]:
    state, method = F.col("state"), F.col("method")
    has_value, evidence = F.col("value").isNotNull(), F.col("evidence_count") > 0
    return {
        "present_without_evidence": (state == "present") & ~evidence,
        "present_without_value": (state == "present") & ~has_value,
        "default_without_citation": (state == "absent_default") & (F.coalesce("default_ref", F.lit("")) == ""),
        "unknown_without_reason": (state == "unknown") & F.col("unknown_reason").isNull(),
        "unknown_with_value": (state == "unknown") & has_value,
        "unsupported_with_value": (state == "absent_unsupported") & has_value,
        "exact_confidence": (state == "present") & method.isin("deterministic", "admin_confirmed") & (F.col("confidence") != 1.0),
        "uncalibrated_claim": (method == "uncalibrated_similarity") & (state != "unknown"),
    }


def finding_rules() -> dict[str, Column]:
    status = F.col("status")
    return {
        "verdict_without_proof": status.isin("pass", "fail") & (F.col("evidence_count") == 0) & F.col("absence_reason").isNull(),
        "unknown_without_reason": (status == "unknown") & F.col("unknown_reason").isNull(),
        "reason_on_verdict": (status != "unknown") & F.col("unknown_reason").isNotNull(),
        "unknown_with_remediation": (status == "unknown") & F.col("snippet_id").isNotNull(),
    }


def citation_rules() -> dict[str, Column]:
    return {
        "hash_mismatch": line_hash(F.col("raw_line")) != F.col("line_sha256"),
        "inverted_range": F.col("line_end") < F.col("line_start"),
    }


def observation_rules() -> dict[str, Column]:
    kind, why = F.col("kind"), F.col("unresolved_reason").isNotNull()
    return {
        "undetermined_without_reason": (kind == "undetermined") & ~why,
        "reason_on_determined": (kind != "undetermined") & why,
        "unattributed": kind.isin("shadowed", "redundant") & (F.col("causes") == 0),
    }


def label_rules() -> dict[str, Column]:
    cites = F.col("evidence_line").isNotNull() | F.col("evidence_text").isNotNull()
    return {
        "value_on_undeterminable": ~F.col("determinable") & F.col("expected_value").isNotNull(),
        "citation_on_undeterminable": ~F.col("determinable") & cites,
        "half_citation": F.col("evidence_line").isNull() != F.col("evidence_text").isNull(),
        "not_eval_split": F.col("split") != "eval",
    }
