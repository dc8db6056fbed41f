"""File sources: folder scan, archive expansion, and the path from bytes to checked uploads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.functions import text as tx
from fleetsift.operators import ingest

# Archive limits.
MAX_ENTRIES, MAX_TOTAL_BYTES, MAX_RATIO = 500, 200 * 1024 * 1024, 100
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")


def scan_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file below ``path`` as one row: ``file_path, size_bytes, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), "content")


def expand_archives(files: DataFrame, key: str = "file_path") -> DataFrame:
    """Members of ZIP files and all other files unchanged, with a reason where one is refused.

    The guards read only the archive's directory, in a fixed order: entry count, unsafe path,
    declared size, compression ratio, size of each entry.  Archives are one row each, so no
    archive ever meets another in a task's memory beyond its batch.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        import zlib
        from pathlib import PurePosixPath

        def unsafe(name: str) -> bool:
            absolute = name.startswith(("/", "\\")) or name[1:2] == ":"
            return absolute or ".." in PurePosixPath(name.replace("\\", "/")).parts

        def guard(entries: list[zipfile.ZipInfo]) -> str | None:
            total = sum(e.file_size for e in entries)
            packed = sum(e.compress_size for e in entries) or 1
            if len(entries) > MAX_ENTRIES:
                return "archive_too_many_entries"
            if any(unsafe(e.filename) for e in entries):
                return "archive_unsafe_path"
            if total > MAX_TOTAL_BYTES:
                return "archive_too_large"
            if total // packed > MAX_RATIO:
                return "archive_compression_bomb"
            return "archive_too_large" if any(e.file_size > tx.MAX_FILE_BYTES for e in entries) else None

        # What a damaged, encrypted or oddly packed file raises.
        DAMAGE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError)

        def member(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
            """Content, or the reason why there is none: one bad member costs no other."""
            try:
                return archive.read(entry), None
            except DAMAGE:
                return None, "undecodable"

        for batch in batches:
            for k, blob in zip(batch[key], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                        entries = [e for e in archive.infolist() if not e.is_dir()]
                        reason = guard(entries)
                        rows = [(k, None, None, reason)] if reason else [(k, e.filename, *member(archive, e)) for e in entries]
                except DAMAGE:
                    rows = [(k, None, None, "undecodable")]
                yield pd.DataFrame(rows, columns=[key, "member", "content", "reason"])

    kind = dict(files.dtypes)[key]
    is_zip = F.hex(F.substring("content", 1, 4)).isin(*ZIP_MAGIC)
    plain = files.where(~is_zip).select(key, F.lit(None).cast("string").alias("member"), "content", F.lit(None).cast("string").alias("reason"))
    packed = files.where(is_zip).select(key, "content").mapInPandas(expand, f"{key} {kind}, member string, content binary, reason string")
    return plain.unionByName(packed)


def ingest_files(files: DataFrame, batch_limit: int | None = None) -> DataFrame:
    """Bytes to checked uploads: batch limit, size gate, decoding, text gates, content address.

    With a ``batch_limit`` the files of a batch (column ``batch_id``) are counted after expansion, and every file of a batch above it is
    refused; a bulk load leaves it out.
    """
    members = expand_archives(files)
    if batch_limit is not None:
        batches = files.select("file_path", "batch_id")
        counted = members.select("file_path").join(batches, "file_path")
        over = batches.join(ingest.over_limit_batches(counted, batch_limit).select("batch_id"), "batch_id", "left_semi").select("file_path", F.lit("batch_limit_exceeded").alias("over"))
        members = members.join(over, "file_path", "left").withColumn("reason", F.coalesce("over", "reason")).drop("over")
    decoded = ingest.decode(members)
    size = F.length("content")
    reason = F.coalesce(F.col("reason"), ingest.size_reason(size), ingest.text_reason(F.col("text")))
    return decoded.withColumn("reason", reason).withColumn("file_id", F.sha2("content", 256))
