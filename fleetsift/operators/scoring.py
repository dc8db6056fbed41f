"""Scoring of the labelled files: which labels may be scored, and what the pipeline said about each.

A label that does not fit its file is never scored and never lost: it is a row with its problem.  Labels, manifest and files meet on the path, of
which each side has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.operators import metrics
from fleetsift.operators.fields import value_text, value_type

#: States in which the pipeline asserts something.
ASSERTED = ("present", "absent_default", "absent_unsupported")


def same_value(expected: Column, system: Column) -> Column:
    """Whether two values (kind, text, items) are the same: of one kind and of one text, lists element by element; the text "2" is not the number 2."""
    lists = (expected["kind"] == "list") & (system["kind"] == "list")
    return F.coalesce(F.when(lists, expected["items"] == system["items"]).otherwise((expected["kind"] == system["kind"]) & (expected["text"] == system["text"])), F.lit(False))


def system_value() -> Column:
    """The value of a parsed field as kind, text and items."""
    return F.when(value_type().isNotNull(), F.struct(value_type().alias("kind"), value_text().alias("text"), F.col("v_list").alias("items")))


def opened(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, …) that may be read: those of the sealed split go before any content is looked at."""
    return files.join(manifest.where(F.col("split") != "holdout").select("path"), "path", "left_semi")


def verify(labels: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``labels`` with ``problem``, NULL if they may be scored.

    ``labels`` as read, ``manifest``: path, split, sha256; ``files``: path, sha256, lines.  In this order: the first broken contract, ``not_listed``,
    ``split_mismatch``, ``file_missing``, ``file_changed``, ``line_out_of_range``, ``citation_drifted``.  Labels of one path in two files are
    ``labelled_twice``, both of them.
    """
    listed = manifest.where(F.size("problems") == 0) if "problems" in manifest.columns else manifest
    twice = labels.groupBy("corpus_path").agg(F.count("*").alias("times")).where("times > 1")
    content = opened(files, listed).select(F.col("path").alias("corpus_path"), F.col("sha256").alias("actual"), "lines")
    entry = listed.select(F.col("path").alias("corpus_path"), F.col("split").alias("listed_split"))
    rows = labels.join(entry, "corpus_path", "left").join(content, "corpus_path", "left").join(twice, "corpus_path", "left")
    cited = F.filter("fields", lambda f: f["evidence_line"].isNotNull())
    beyond = F.exists(cited, lambda f: f["evidence_line"] > F.size("lines"))
    drifted = F.exists(cited, lambda f: ~F.try_element_at(F.col("lines"), f["evidence_line"]).eqNullSafe(f["evidence_text"]))
    problem = (
        F.when(F.size("problems") > 0, F.element_at("problems", 1)).when(F.col("times") > 1, "labelled_twice").when(F.col("listed_split").isNull(), "not_listed")
        .when(F.col("listed_split") != F.col("split"), "split_mismatch").when(F.col("actual").isNull(), "file_missing").when(F.col("actual") != F.col("file_sha256"), "file_changed")
        .when(beyond, "line_out_of_range").when(drifted, "citation_drifted")
    )
    return rows.withColumn("problem", problem).drop("listed_split", "actual", "lines", "times")


def field_observations(verified: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each labelled field of the files that may be scored, with outcome and evidence; a field that was not parsed was not asserted.

    ``fields``: path, field, state, evidence and the typed values, as resolved.
    """
    labelled = verified.where(F.col("problem").isNull()).select(
        "corpus_path", "vendor", "os_family", (F.col("provenance.pattern_author_conflict") == "true").alias("author_conflict"), F.inline("fields")
    )
    asserted = F.col("state").isin(*ASSERTED)
    parsed = fields.where(asserted).select(
        F.col("path").alias("corpus_path"), "field", system_value().alias("system_value"), F.try_element_at("evidence", F.lit(1))["line"].alias("cited_line"), F.lit(True).alias("found")
    )
    rows = labelled.join(parsed, ["corpus_path", "field"], "left").select(
        "corpus_path", "vendor", "os_family", "field", "author_conflict", (F.col("determinability") == "determinable").alias("determinable"), F.coalesce("found", F.lit(False)).alias("asserted"),
        same_value(F.col("expected_value"), F.col("system_value")).alias("same"), F.col("expected_value.text").alias("expected"), F.col("system_value.text").alias("system"),
        F.col("evidence_line").alias("labelled_line"), "cited_line",
    )
    outcome = (
        F.when(F.col("asserted") & F.col("determinable") & F.col("same"), "correct").when(F.col("asserted"), "wrong_confident")
        .when(F.col("determinable"), "miss").otherwise("correct_abstention")
    )
    return rows.withColumn("outcome", outcome).withColumn("evidence", metrics.evidence_outcome()).drop("same")


def verdict_observations(verified: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected and actual verdict of each labelled rule; ``findings``: path, rule_id, status; a rule without a finding did not apply."""
    labelled = verified.where(F.col("problem").isNull()).select(F.col("corpus_path").alias("device_id"), "vendor", F.inline("verdicts"))
    rows = labelled.select("device_id", "vendor", "rule_id", F.col("expected_verdict").alias("expected"))
    return metrics.verdict_observations(rows, findings.withColumnRenamed("path", "device_id")).withColumnRenamed("device_id", "corpus_path")


def detection_observations(verified: DataFrame, detected: DataFrame) -> DataFrame:
    """Expected and detected vendor of each file that may be scored; ``detected``: path, detected_vendor, outcome."""
    return verified.where(F.col("problem").isNull()).select("corpus_path", F.col("vendor").alias("expected_vendor")).join(
        detected.select(F.col("path").alias("corpus_path"), "detected_vendor", F.col("outcome").alias("reason")), "corpus_path"
    )
