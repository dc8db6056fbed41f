"""Queries of the ingestion family (S rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.functions import text as tx
from fleetsift.operators import ingest as ops
from fleetsift.plans.registry import query
from fleetsift.sources import derived as d
from fleetsift.sources.files import expand_archives
from fleetsift.sources.tables import table

# The gates in SQL form, in the order they are applied.
_PRINTABLE = (
    "(length(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'), '[\\p{C}\\p{Z}]', '', 'g')) "
    "+ length(text) - length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')))::DOUBLE / length(text)"
)
_SNIFF = (
    "CASE WHEN regexp_extract(text, '^\\s*(\\S)', 1) = '<' THEN 'xml' "
    "WHEN regexp_extract(text, '^\\s*(\\S)', 1) IN ('{', '[') THEN 'json' ELSE 'cli' END"
)
_REASON = f"""CASE WHEN over_limit THEN 'batch_limit_exceeded'
  WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > {tx.MAX_FILE_BYTES} THEN 'too_large'
  WHEN {_PRINTABLE} < {tx.MIN_PRINTABLE} THEN 'binary_content'
  WHEN regexp_full_match(text, '\\s*') THEN 'empty'
  WHEN ({_SNIFF}) = 'json' AND NOT json_valid(text) THEN 'malformed_json'
  WHEN ({_SNIFF}) = 'xml' AND broken THEN 'malformed_xml' END"""
_CHECKED = f"""{d.UPLOADS_CTE}, over_b AS (SELECT batch_id FROM uploads GROUP BY 1 HAVING count(*) > {tx.MAX_BATCH_FILES}),
checked AS (SELECT u.upload_id, u.batch_id, u.text, {_REASON} AS reason
  FROM (SELECT x.*, o.batch_id IS NOT NULL AS over_limit FROM uploads x LEFT JOIN over_b o USING (batch_id)) u)"""


@query(
    "s01_batch_scan",
    f"WITH {_CHECKED} SELECT upload_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, "
    "reason, CASE WHEN reason IS NULL THEN sha256(text) END AS file_id FROM checked",
)
def s01_batch_scan(spark: SparkSession, sf: str) -> DataFrame:
    checked = ops.check_uploads(d.uploads(spark, sf))
    ok = F.col("reason").isNull()
    return checked.select(
        "upload_id",
        F.when(ok, "accepted").otherwise("rejected").alias("status"),
        "reason",
        F.when(ok, tx.line_hash(F.col("text"))).alias("file_id"),
    )


@query(
    "s02_archive_expand",
    "SELECT doc_id, 'a.cfg' AS member, CASE WHEN doc_id % 11 > 1 THEN strlen(text) END AS size, CASE WHEN doc_id % 11 <= 1 THEN 'undecodable' END AS reason FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'sub/b.cfg', 3, NULL FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 "
    "UNION ALL SELECT doc_id, NULL, NULL, 'archive_unsafe_path' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT doc_id, NULL, strlen(text), NULL FROM documents WHERE doc_id % 5 = 0",
)
def s02_archive_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Most documents are zipped with a second member; some archives try to escape their folder, some have a damaged or an encrypted member."""

    def pack(batches):
        import io
        import zipfile

        for batch in batches:
            blobs = []
            for n, text in zip(batch["doc_id"], batch["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("../a.cfg" if n % 7 == 0 else "a.cfg", text, zipfile.ZIP_DEFLATED if n % 11 == 0 else zipfile.ZIP_STORED)
                    z.writestr("sub/b.cfg", "abc")
                    first = z.infolist()[0]
                blob = bytearray(out.getvalue())
                if n % 11 == 0:
                    at = first.header_offset + 30 + len(first.filename)
                    blob[at : at + 2] = b"\xff\xff"
                elif n % 11 == 1:
                    for at in (first.header_offset + 6, blob.index(b"PK\x01\x02") + 8):
                        blob[at] |= 1
                blobs.append(text.encode() if n % 5 == 0 else bytes(blob))
            yield batch[["doc_id"]].assign(content=blobs)

    files = table(spark, sf, "documents").select("doc_id", "text").mapInPandas(pack, "doc_id long, content binary")
    return expand_archives(files, "doc_id").select("doc_id", "member", F.length("content").cast("bigint").alias("size"), "reason")


@query("s03_decode", "SELECT doc_id, 'utf-8' AS encoding, length(text) AS chars FROM documents WHERE doc_id % 2 = 0 "
       "UNION ALL SELECT doc_id, 'utf-16-le', length(text) FROM documents WHERE doc_id % 2 = 1")
def s03_decode(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    content = F.when(F.col("doc_id") % 2 == 1, wide).otherwise(F.encode("text", "UTF-8"))
    files = docs.select("doc_id", content.alias("content"))
    return ops.decode(files).select("doc_id", "encoding", F.length("text").alias("chars"))


@query(
    "s04_printable_ratio",
    f"SELECT doc_id, round({_PRINTABLE}, 6) AS ratio, {_PRINTABLE} >= {tx.MIN_PRINTABLE} AS passes FROM documents",
)
def s04_printable_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = tx.printable_ratio(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.round(ratio, 6).alias("ratio"), (ratio >= tx.MIN_PRINTABLE).alias("passes")
    )


@query(
    "s05_size_gate",
    f"WITH {d.UPLOADS_CTE} SELECT upload_id, strlen(text) AS size_bytes, CASE WHEN strlen(text) = 0 OR "
    f"regexp_full_match(text, '\\s*') THEN 'empty' WHEN strlen(text) > {tx.MAX_FILE_BYTES} THEN 'too_large' END AS reason FROM uploads",
)
def s05_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length(F.encode("text", "UTF-8"))
    return d.uploads(spark, sf).select(
        "upload_id",
        size.cast("bigint").alias("size_bytes"),
        F.coalesce(ops.size_reason(size), F.when(tx.is_blank(F.col("text")), "empty")).alias("reason"),
    )


@query(
    "s06_batch_limit",
    f"WITH {d.UPLOADS_CTE} SELECT batch_id, count(*) AS files, 'batch_limit_exceeded' AS reason, count(*) || "
    f"' files exceeds the batch limit of {tx.MAX_BATCH_FILES}' AS detail FROM uploads GROUP BY 1 HAVING count(*) > {tx.MAX_BATCH_FILES}",
)
def s06_batch_limit(spark: SparkSession, sf: str) -> DataFrame:
    return ops.over_limit_batches(d.uploads(spark, sf))


@query(
    "s07_format_sniff",
    f"WITH {d.UPLOADS_CTE} SELECT upload_id, {_SNIFF} AS format, "
    f"CASE WHEN ({_SNIFF}) = 'json' THEN json_valid(text) END AS parses FROM uploads",
)
def s07_format_sniff(spark: SparkSession, sf: str) -> DataFrame:
    kind = tx.sniff_format(F.col("text"))
    return d.uploads(spark, sf).select(
        "upload_id",
        kind.alias("format"),
        F.when(kind == "json", tx.json_parses(F.col("text"))).alias("parses"),
    )


@query("s07_xml_wellformed", f"WITH {d.UPLOADS_CTE} SELECT upload_id, NOT broken AS wellformed FROM uploads WHERE ({_SNIFF}) = 'xml'")
def s07_xml_wellformed(spark: SparkSession, sf: str) -> DataFrame:
    return ops.xml_wellformed(d.uploads(spark, sf), "upload_id")


@query("s08_reject_taxonomy", f"WITH {_CHECKED} SELECT reason, count(*) AS files FROM checked WHERE reason IS NOT NULL GROUP BY 1")
def s08_reject_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    checked = ops.check_uploads(d.uploads(spark, sf))
    return checked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("files"))


@query("s09_content_address", "SELECT doc_id, sha256(text) AS file_id, strlen(text) AS size_bytes FROM documents")
def s09_content_address(spark: SparkSession, sf: str) -> DataFrame:
    return d.cfg_file(spark, sf).select(
        "doc_id", F.sha2("content", 256).alias("file_id"), F.length("content").cast("bigint").alias("size_bytes")
    )


@query(
    "s10_duplicate_detect",
    f"""WITH {d.UPLOADS_CTE}, u AS (SELECT upload_id, sha256(text) AS file_id FROM uploads),
    hist AS (SELECT DISTINCT sha256(text) AS file_id FROM conversations UNION SELECT sha256(text) FROM benchmark)
    SELECT upload_id, file_id, CASE WHEN row_number() OVER (PARTITION BY file_id ORDER BY upload_id) = 1
      AND file_id NOT IN (SELECT file_id FROM hist) THEN 'ingested' ELSE 'duplicate' END AS status FROM u""",
)
def s10_duplicate_detect(spark: SparkSession, sf: str) -> DataFrame:
    ups = d.uploads(spark, sf).select("upload_id", tx.line_hash(F.col("text")).alias("file_id"))
    seen = table(spark, sf, "conversations").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    history = seen.select(tx.line_hash(F.col("text")).alias("file_id"))
    return ops.duplicate_status(ups, history).select("upload_id", "file_id", "status")


@query("s11_line_explode", f"WITH {d.DOC_LINES_CTE} SELECT doc_id, line_number, text FROM cfg_line")
def s11_line_explode(spark: SparkSession, sf: str) -> DataFrame:
    return d.doc_lines(spark, sf)


@query("s12_line_hash", f"WITH {d.DOC_LINES_CTE} SELECT doc_id, line_number, sha256(text) AS line_sha256 FROM cfg_line")
def s12_line_hash(spark: SparkSession, sf: str) -> DataFrame:
    return d.doc_lines(spark, sf).select("doc_id", "line_number", tx.line_hash(F.col("text")).alias("line_sha256"))


@query(
    "s13_terminators",
    "SELECT doc_id, sha256(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS norm_sha FROM "
    "(SELECT doc_id, replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END) AS t FROM documents)",
)
def s13_terminators(spark: SparkSession, sf: str) -> DataFrame:
    brk = F.when(F.col("doc_id") % 3 == 0, F.lit("\r\n")).when(F.col("doc_id") % 3 == 1, F.lit("\r")).otherwise(F.lit("\n"))
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), brk).alias("t"))
    return docs.select("doc_id", tx.line_hash(tx.normalise_terminators(F.col("t"))).alias("norm_sha"))


@query(
    "s14_line_cache",
    f"""WITH {d.DOC_LINES_CTE} SELECT sha256(text) AS line_sha256, text, count(*) AS occurrence_count,
    min(doc_id) AS first_doc, arg_min(line_number, doc_id * 1000000 + line_number) AS first_line FROM cfg_line GROUP BY text""",
)
def s14_line_cache(spark: SparkSession, sf: str) -> DataFrame:
    return ops.line_cache(d.doc_lines(spark, sf)).select(
        "line_sha256",
        "text",
        "occurrence_count",
        F.col("first_seen.doc_id").alias("first_doc"),
        F.col("first_seen.line_number").alias("first_line"),
    )


@query(
    "s14_line_cache_merge",
    f"""WITH {d.DOC_LINES_CTE} SELECT sha256(text) AS line_sha256, count(*) AS occurrence_count,
    min(doc_id) AS first_doc FROM cfg_line GROUP BY text""",
)
def s14_line_cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    lines = d.doc_lines(spark, sf)
    odd = F.col("doc_id") % 2 == 1
    merged = ops.merge_line_cache(ops.line_cache(lines.where(odd)), ops.line_cache(lines.where(~odd)))
    return merged.select("line_sha256", "occurrence_count", F.col("first_seen.doc_id").alias("first_doc"))


@query(
    "s15_cache_stats",
    f"WITH {d.DOC_LINES_CTE} SELECT count(DISTINCT text) AS distinct_lines, count(*) AS total_lines, "
    "count(*) - count(DISTINCT text) AS deduplicated FROM cfg_line",
)
def s15_cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    cache = ops.line_cache(d.doc_lines(spark, sf))
    return cache.agg(F.count("*").alias("distinct_lines"), F.sum("occurrence_count").alias("total_lines")).select(
        "*", (F.col("total_lines") - F.col("distinct_lines")).alias("deduplicated")
    )


@query("s16_line_readback", f"WITH {d.DOC_LINES_CTE} SELECT doc_id, line_number, text FROM cfg_line")
def s16_line_readback(spark: SparkSession, sf: str) -> DataFrame:
    lines = d.doc_lines(spark, sf).select("doc_id", "line_number", tx.line_hash(F.col("text")).alias("line_sha256"))
    return ops.read_back(lines, ops.line_cache(d.doc_lines(spark, sf))).select("doc_id", "line_number", "text")


@query(
    "s17_reconstruct",
    "SELECT doc_id, sha256(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END) AS text_sha FROM documents",
)
def s17_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    return d.doc_lines(spark, sf).groupBy("doc_id").agg(tx.line_hash(joined).alias("text_sha"))


@query(
    "s25_checksum_audit",
    """WITH f AS (SELECT doc_id, text, 'checksum: sha256:' || CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'stale' END AS dec FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN substr(dec, 11) END AS declared, 'sha256:' || sha256(text) AS computed,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 ELSE false END AS verified FROM f""",
)
def s25_checksum_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    digest = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.encode("text", "UTF-8"), 256)).otherwise(F.lit("stale"))
    stamped = F.concat(F.lit("checksum: sha256:"), digest, F.lit("\r\n"), F.col("text"))
    files = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, stamped).otherwise(F.col("text")).alias("text"))
    declared, computed = ops.checksum_of(F.col("text"))
    return files.select("doc_id", declared.alias("declared"), computed.alias("computed")).select(
        "*", F.coalesce(F.col("declared") == F.col("computed"), F.lit(False)).alias("verified")
    )
