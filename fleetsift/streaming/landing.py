"""Continuous ingestion of a landing folder.

The stream is stateless up to the sink: files are expanded, decoded, gated and detected in their
own rows.  Each micro-batch then drops files that are already stored, by an anti-join on the
content address, and appends the rest, so a replayed batch adds nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsift.operators import detect
from fleetsift.operators.ingest import duplicate_status
from fleetsift.sources.files import ingest_files

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("file_path"), "content")


def store_batch(batch: DataFrame, target: str) -> None:
    """Gate, detect and append the new files of one micro-batch; refused ones go to ``<target>-rejects`` with their reason."""
    spark = batch.sparkSession
    checked = ingest_files(batch)
    checked.where(F.col("reason").isNotNull()).select("file_path", "member", "file_id", "reason").write.mode("append").parquet(f"{target}-rejects")
    seen = detect.detect(detect.with_lines(checked.where(F.col("reason").isNull())))
    stored = seen.select("file_path", "member", "file_id", "text", "outcome", "detected_vendor", "detected_os").withColumn(
        "upload_id", F.concat_ws("!", "file_path", "member")
    )
    try:
        known = spark.read.parquet(target).select("file_id")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = None
    fresh = duplicate_status(stored, known).where(F.col("status") == "ingested").drop("status")
    fresh.write.mode("append").parquet(target)


def start(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    return (
        landing_stream(spark, folder)
        .writeStream.foreachBatch(lambda batch, _: store_batch(batch, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
