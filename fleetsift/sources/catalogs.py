"""Catalogs of framework controls from index files.

An index file names one document and its control ids, in plain ``key: value`` lines and ``- item`` lists:

    framework: nist
    document: "Some standard"
    edition: 5.2.0
    covers:
      vendor: cisco
      os_family: ios
      os_version: ^17
    controls:
    - AC-01
    withdrawn:
    - AC-13

A file is one row until its lines are told apart; any number of files and ids becomes a table.  Notes, sources and folded text are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Lists of an index file and the status of what they name.
STATUS = {"controls": "live", "withdrawn": "withdrawn"}
REQUIRED = ("framework", "document", "edition")


def _value(pattern: str) -> Column:
    """Group 1 of a line without its quotes, NULL where the line is another one."""
    found = F.regexp_extract("line", pattern, 1)
    return F.when(F.col("line").rlike(pattern), F.regexp_replace(F.trim(found), "^(['\"])(.*)\\1$", "$2"))


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per index file under ``path``: file, framework, document, edition, vendor, os_family, release, ``items`` (status, control_id) and ``reason``.

    ``reason`` says why a file is no catalog: ``no_framework``, ``no_document``, ``no_edition``, ``no_controls`` or ``repeated_control``; NULL if it is one.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r\n|\r|\n").alias("lines"))
    rows = files.select("file", F.posexplode("lines").alias("position", "line"))
    key = F.nullif(F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*):", 1), F.lit(""))
    so_far = W.partitionBy("file").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)  # a file is bounded
    rows = rows.withColumn("section", F.last(key, ignorenulls=True).over(so_far))
    section = F.col("section")
    status = F.when(section == "controls", STATUS["controls"]).when(section == "withdrawn", STATUS["withdrawn"])
    item = F.struct(status.alias("status"), _value(r"^\s*-\s+(\S.*)$").alias("control_id"))
    scope = lambda k: F.max(F.when(section == "covers", _value(rf"^\s+{k}:\s*(\S.*)$")))
    found = rows.groupBy("file").agg(
        *[F.max(_value(rf"^{k}:\s*(\S.*)$")).alias(k) for k in REQUIRED],
        scope("vendor").alias("vendor"), scope("os_family").alias("os_family"), scope("os_version").alias("release"),
        F.collect_list(F.when(item["status"].isNotNull() & item["control_id"].isNotNull(), item)).alias("items"),
    )
    ids = F.transform("items", lambda x: x["control_id"])
    reason = F.coalesce(
        *[F.when(F.col(k).isNull(), f"no_{k}") for k in REQUIRED],
        F.when(F.size("items") == 0, "no_controls").when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_control"),
    )
    return found.withColumn("reason", reason)


def editions(catalogs: DataFrame) -> DataFrame:
    """The document of each framework, its newest edition where files name several."""
    kept = catalogs.where(F.col("reason").isNull())
    newest = F.max(F.struct("edition", "document", "vendor", "os_family", "release"))
    return kept.groupBy("framework").agg(newest.alias("e")).select("framework", "e.*")


def controls(catalogs: DataFrame) -> DataFrame:
    """(framework, control_id, status), one row each; an id that one file lists as live and another as withdrawn is withdrawn."""
    rows = catalogs.where(F.col("reason").isNull()).select("framework", F.inline("items"))
    return rows.groupBy("framework", "control_id").agg(F.max("status").alias("status"))
