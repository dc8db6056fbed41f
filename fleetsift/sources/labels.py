"""Manifests and ground-truth labels of a corpus, read from files of records and held to their contract.

A file that breaks the contract is kept with the names of all its faults, so that a refused file is a row and never a lost one.  Nothing here reads
a parser's result: a label is what a person read in the configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.session import pin
from fleetsift.sources.records import VALUE, records, text_of
from fleetsift.sources.rules import VERDICTS

HEAD = ("corpus_path", "split", "vendor", "os_family", "file_sha256")
PROVENANCE = (
    "labelled_by", "labelled_at", "authored_from", "review_status", "reviewed_by", "reviewed_at", "pattern_author_conflict", "conflict_note", "parser_state_at_labelling",
)
FIELD = ("field", "determinability", "expected_value", "evidence_line", "evidence_text", "rationale")
VERDICT = ("rule_id", "expected_verdict", "rationale")
MANIFEST = ("path", "split", "vendor", "os_family", "source_type", "source_ref", "authored_by", "sha256", "added")
SPLITS = ("dev", "eval", "holdout")
DETERMINABILITY = ("determinable", "not_determinable")
SHA256 = "^[0-9a-f]{64}$"
MAX_RATIONALE = 600


def _faults(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items()]))


def _maps(section: str) -> Column:
    """The maps of a section of ``r``, none where the section is missing."""
    return F.coalesce(F.try_element_at(F.col("r.sections"), F.lit(section)), F.array().cast(f"array<map<string,{VALUE}>>"))


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _field(m: Column) -> Column:
    value = F.try_element_at(m, F.lit("expected_value"))
    return F.struct(
        text_of(m, "field").alias("field"), text_of(m, "determinability").alias("determinability"), F.when(value["kind"] != "null", value).alias("expected_value"),
        text_of(m, "evidence_line").try_cast("int").alias("evidence_line"), text_of(m, "evidence_text").alias("evidence_text"), text_of(m, "rationale").alias("rationale"),
    )


def _verdict(m: Column) -> Column:
    return F.struct(*[text_of(m, k).alias(k) for k in VERDICT])


def _repeated(names: Column) -> Column:
    return F.size(F.array_distinct(names)) < F.size(names)


def _foreign(maps: Column, known: tuple[str, ...]) -> Column:
    """Whether a map has a key that the contract does not know."""
    return F.exists(maps, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in known]))) > 0)


def read_labels(files: DataFrame) -> DataFrame:
    """Labels of files (``file, text`` and whatever else): the head, ``provenance``, ``fields``, ``verdicts`` and ``problems``, empty if the file keeps the contract.

    ``expected_value`` carries kind, text and list elements, NULL where none is stated.  A null or empty text has no head, so it is refused by name.
    """
    read = pin(files, "r", records(F.col("text")))
    prov = F.try_element_at(_maps("provenance"), F.lit(1))
    rows = read.select(
        *[c for c in files.columns if c != "text"], *[text_of(F.col("r.head"), k).alias(k) for k in HEAD], F.struct(*[text_of(prov, k).alias(k) for k in PROVENANCE]).alias("provenance"),
        F.transform(_maps("fields"), _field).alias("fields"), F.transform(_maps("verdicts"), _verdict).alias("verdicts"),
        F.col("r.problem").alias("unreadable"), F.size(_maps("provenance")).alias("parts"),
        (_foreign(_maps("fields"), FIELD) | _foreign(_maps("verdicts"), VERDICT) | _foreign(_maps("provenance"), PROVENANCE)
         | (F.size(F.array_except(F.array_union(F.map_keys("r.head"), F.map_keys("r.sections")), F.array(*[F.lit(k) for k in (*HEAD, "provenance", "fields", "verdicts")]))) > 0)).alias("foreign"),
        F.transform(_maps("fields"), lambda m: text_of(m, "evidence_line")).alias("cited"),
    )
    p, any_field, any_verdict = F.col("provenance"), lambda test: F.exists("fields", test), lambda test: F.exists("verdicts", test)
    closed = lambda f: f["determinability"] == "not_determinable"
    cites = lambda f: f["evidence_line"].isNotNull() | f["evidence_text"].isNotNull()
    status = F.coalesce(p["review_status"], F.lit("unreviewed"))
    faults = _faults({
        "unknown_key": F.col("foreign"),
        **{f"no_{k}": _blank(F.col(k)) for k in HEAD},
        "bad_checksum": ~_blank(F.col("file_sha256")) & ~F.col("file_sha256").rlike(SHA256),
        "bad_provenance": (F.col("parts") != 1) | _blank(p["labelled_by"]) | _blank(p["labelled_at"]) | p["labelled_at"].try_cast("timestamp").isNull() | _blank(p["authored_from"]),
        "bad_review_status": ~status.isin("reviewed", "unreviewed"),
        "reviewer_missing": (status == "reviewed") & _blank(p["reviewed_by"]),
        "review_not_marked": (status == "unreviewed") & ~_blank(p["reviewed_by"]),
        "conflict_unexplained": (p["pattern_author_conflict"] == "true") & _blank(p["conflict_note"]),
        "no_fields": F.size("fields") == 0,
        "field_without_name": any_field(lambda f: _blank(f["field"])),
        "repeated_field": _repeated(F.transform("fields", lambda f: f["field"])),
        "bad_determinability": any_field(lambda f: ~F.coalesce(f["determinability"].isin(*DETERMINABILITY), F.lit(False))),
        "value_on_undeterminable": any_field(lambda f: closed(f) & f["expected_value"].isNotNull()),
        "citation_on_undeterminable": any_field(lambda f: closed(f) & cites(f)),
        "half_citation": any_field(lambda f: f["evidence_line"].isNull() != f["evidence_text"].isNull()),
        "bad_line": any_field(lambda f: f["evidence_line"] < 1) | F.exists("cited", lambda c: c.isNotNull() & c.try_cast("int").isNull()),
        "bad_rationale": any_field(lambda f: _blank(f["rationale"]) | (F.char_length(f["rationale"]) > MAX_RATIONALE)) | any_verdict(lambda v: _blank(v["rationale"]) | (F.char_length(v["rationale"]) > MAX_RATIONALE)),
        "verdict_without_rule": any_verdict(lambda v: _blank(v["rule_id"])),
        "repeated_rule": _repeated(F.transform("verdicts", lambda v: v["rule_id"])),
        "bad_verdict": any_verdict(lambda v: ~F.coalesce(v["expected_verdict"].isin(*VERDICTS), F.lit(False))),
        "not_eval_split": ~_blank(F.col("split")) & (F.col("split") != "eval"),
    })
    problems = F.when(F.col("unreadable").isNotNull(), F.array("unreadable")).otherwise(faults)
    return pin(rows, "problems", problems).drop("unreadable", "foreign", "cited", "parts")


def read_manifest(files: DataFrame) -> DataFrame:
    """Entries of manifests (``file, text``), one row each: path, split, vendor, os_family, provenance, sha256, flags, ``held_out_vendor`` and ``problems``.

    A manifest that cannot be read is one row with its problem and no path.  A path that is listed twice is refused both times.
    """
    read = pin(files, "r", records(F.col("text")))
    rows = read.select("file", text_of(F.col("r.head"), "held_out_vendor").alias("held_out_vendor"), F.col("r.problem").alias("unreadable"), F.explode_outer(_maps("files")).alias("m"))
    rows = rows.where(F.col("m").isNotNull() | F.col("unreadable").isNotNull()).select(
        "file", "held_out_vendor", "unreadable", *[text_of(F.col("m"), k).alias(k) for k in MANIFEST],
        *[(text_of(F.col("m"), k) == "true").alias(k) for k in ("sanitised", "is_real_world_data", "labelled")],
    )
    twice = rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.count("*").alias("times")).where("times > 1")
    rows = rows.join(twice, "path", "left")
    faults = _faults({
        "no_path": _blank(F.col("path")),
        "bad_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "bad_checksum": ~F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False)),
        "no_provenance": _blank(F.col("authored_by")) | _blank(F.col("source_type")),
        "labelled_outside_eval": F.col("labelled") & (F.col("split") != "eval"),
        "listed_twice": F.col("times") > 1,
    })
    problems = F.when(F.col("unreadable").isNotNull(), F.array("unreadable")).otherwise(faults)
    return pin(rows, "problems", problems).drop("unreadable", "times")
