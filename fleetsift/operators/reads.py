"""Reads over stored files, runs and examples; a page of them only where one is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def listing(rows: DataFrame, order: Sequence[str | Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """``rows`` in the order given; all of them unless ``limit`` or ``offset`` ask for a page."""
    out = rows.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def files_of_owner(files: DataFrame, owned: DataFrame, vendor: str) -> DataFrame:
    """Files of a vendor that ``owned`` (doc_id) names."""
    return files.where(F.col("source") == vendor).join(owned, "doc_id", "left_semi")


def latest_runs(runs: DataFrame) -> DataFrame:
    """``device, audit_id`` of the newest run of each device: by date, then id."""
    return runs.groupBy("device").agg(F.max(F.struct("ran_at", "audit_id")).alias("m")).select("device", F.col("m.audit_id").alias("audit_id"))


def visible_runs(users: DataFrame, runs: DataFrame, salts: int = 64) -> DataFrame:
    """``user_id, audit_id``: a user sees runs of their own, an admin sees every run.

    ``users``: user_id, admin; ``runs``: owner_id, audit_id.  Runs are dealt to salts, every admin is copied to each, and both meet by an equi-join on the salt: as many
    rows as the answer has, in as many parts, however many admins there are.
    """
    own = runs.join(users.where("not admin").select(F.col("user_id").alias("owner_id")), "owner_id").select(F.col("owner_id").alias("user_id"), "audit_id")
    admins = users.where("admin").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = runs.select("audit_id", F.pmod(F.xxhash64("audit_id"), F.lit(salts)).cast("int").alias("_salt"))
    return own.unionByName(dealt.join(admins, "_salt").select("user_id", "audit_id"))


def batch_summary(uploads: DataFrame) -> DataFrame:
    """Counts per batch of ``status`` (ingested, duplicate, rejected) and of accepted files without a platform.

    ``uploads``: batch_id, status, identified.
    """
    ok = F.col("status") != "rejected"
    return uploads.groupBy("batch_id").agg(
        F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "duplicate").alias("duplicate"), F.count_if(~ok).alias("rejected"),
        F.count_if(ok & ~F.col("identified")).alias("unidentified"),
    )
