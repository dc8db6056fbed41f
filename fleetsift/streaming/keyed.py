"""Continuous ingestion with keyed state: batch limits and first copies without reading what is stored.

Three streams hand on through exactly-once file sinks, so that a micro-batch that is run again adds nothing:

1. ``stage``: files of the landing folder are expanded, decoded, gated and detected in their own rows.  No state, no shuffle.
2. ``admit``: references of the files are counted by batch, which is the folder they lie in.  A batch closes when nothing has come for a while; up to
   then its references are held, ``limit`` at most.  A batch above the limit is refused, file by file, from that moment on.
3. ``first_copies``: content addresses seen before are state; the first admitted copy is ingested, later ones are duplicates.

Texts stay where stage 1 wrote them: states and shuffles carry references only.  State grows with the open batches and the distinct contents, the
work of a micro-batch with its own files.  A file of no bytes is passed over by Spark's file stream and never listed.  References of one key pass one task as a stream; none is kept beyond what is said above.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetsift.functions import text as tx
from fleetsift.operators import detect
from fleetsift.sources.files import ingest_files
from fleetsift.streaming.landing import landing_stream

STAGED = (
    "file_path string, member string, upload_id string, batch_id string, file_id string, reason string, text string, outcome string, detected_vendor string, detected_os string"
)
ADMITTED = "batch_id string, upload_id string, file_id string, reason string"
COPIES = "file_id string, upload_id string, status string"


def staged(files: DataFrame) -> DataFrame:
    """Checked and detected files; the batch of a file is its folder.  A file that was refused keeps its reason and loses its text."""
    checked = ingest_files(files)
    upload = F.concat_ws("!", "file_path", "member")
    seen = detect.detect(detect.with_lines(checked.withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))))
    ok = F.col("reason").isNull()
    return seen.select(
        "file_path", "member", upload.alias("upload_id"), F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("batch_id"), "file_id", "reason", "text",
        *[F.when(ok, F.col(c)).alias(c) for c in ("outcome", "detected_vendor", "detected_os")],
    )


def admit(references: DataFrame, limit: int = tx.MAX_BATCH_FILES, quiet_ms: int = 60_000) -> DataFrame:
    """References (batch_id, upload_id, file_id, reason) with their last reason, NULL if admitted, given out when their batch closes or is refused.

    Only files with content count against the limit; an archive that could not be opened has none and is refused at once.  A file that comes after
    its batch has closed opens the batch again.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, files = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = lambda found: pd.DataFrame([(key[0], *r) for r in found], columns=["batch_id", "upload_id", "file_id", "reason"], dtype=object)
        if state.hasTimedOut:
            state.remove()
            yield rows(held)
            return
        for part in parts:
            out = []
            for upload, content, reason in zip(part["upload_id"], part["file_id"], part["reason"], strict=True):
                reason = None if pd.isna(reason) else reason
                if pd.isna(content):
                    out.append((upload, None, reason))
                    continue
                files += 1
                if files <= limit:
                    held.append((upload, content, reason))
                else:
                    out += [(u, c, "batch_limit_exceeded") for u, c, _ in held] + [(upload, content, "batch_limit_exceeded")]
                    held = []
            yield rows(out)
        state.update((json.dumps(held), files))
        state.setTimeoutDuration(quiet_ms)

    return references.groupBy("batch_id").applyInPandasWithState(judge, ADMITTED, "held string, files bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_copies(admitted: DataFrame) -> DataFrame:
    """``file_id, upload_id, status``: the first admitted copy of a content is ingested, all others are duplicates.

    Of copies that come in one micro-batch the one of smallest upload_id is the first.  An upload that is named again after it was ingested says nothing new.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        first = known
        rows = lambda uploads, status: pd.DataFrame([(key[0], u, status) for u in uploads], columns=["file_id", "upload_id", "status"])
        for part in parts:
            later = [u for u in part["upload_id"] if u != first]
            if known is None and later:
                best = min(later) if first is None else min(first, *later)
                later = [u for u in ([first] if first is not None else []) + later if u != best]
                first = best
            yield rows(later, "duplicate")
        if known is None and first is not None:
            state.update((first,))
            yield rows([first], "ingested")

    return admitted.select("file_id", "upload_id").groupBy("file_id").applyInPandasWithState(judge, COPIES, "upload_id string", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, limit: int = tx.MAX_BATCH_FILES, quiet_ms: int = 60_000, every: str = "10 seconds") -> list[StreamingQuery]:
    """The three streams; each has its own checkpoint and may be stopped and started again."""
    for name, schema in (("staged", STAGED), ("admitted", ADMITTED)):  # a stream reads only a folder that exists
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{target}/{name}")

    def write(rows: DataFrame, name: str) -> StreamingQuery:
        return rows.writeStream.format("parquet").option("path", f"{target}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(processingTime=every).start()

    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{target}/{name}")
    references = stream("staged", STAGED).select("batch_id", "upload_id", "file_id", "reason")
    return [
        write(staged(landing_stream(spark, folder)), "staged"),
        write(admit(references, limit, quiet_ms), "admitted"),
        write(first_copies(stream("admitted", ADMITTED).where("reason IS NULL")), "copies"),
    ]


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The first admitted copy of each content, with its text and platform."""
    first = spark.read.schema(COPIES).parquet(f"{target}/copies").where("status = 'ingested'").select("upload_id", "file_id")
    return spark.read.schema(STAGED).parquet(f"{target}/staged").join(first, ["upload_id", "file_id"]).drop("reason")


def read_rejects(spark: SparkSession, target: str) -> DataFrame:
    """One row for each refused file, with its reason."""
    return spark.read.schema(ADMITTED).parquet(f"{target}/admitted").where("reason IS NOT NULL")
