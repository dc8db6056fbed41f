"""Hash-chained log: canonical form, append, verification, heads, queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetsift.operators.scan import bucketed_lag

GENESIS = "0" * 64
ALGO = "sha256"
KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, no white space, other scripts kept as they are; what is not JSON (``NaN``, say) is an error."""
    return F.to_json(F.parse_json(text))


def payload_hash() -> Column:
    """Hash of the stored payload text; the text is never rendered again."""
    return F.sha2(F.encode("payload_json", "UTF-8"), 256)


def _json_ends() -> tuple[Column, Column]:
    """Canonical record text before and after the previous hash, keys in order."""
    head = F.to_json(
        F.struct(
            F.col("action"), F.struct(F.col("actor_id").alias("id"), F.col("actor_role").alias("role"), F.col("actor_type").alias("type")).alias("actor"),
            F.col("payload_hash"),
        ),
        KEEP_NULLS,
    )
    tail = F.to_json(
        F.struct(
            F.col("seq"), F.struct(F.col("subject_id").alias("id"), F.col("subject_kind").alias("kind")).alias("subject"), canonical_ts(F.col("ts")).alias("timestamp")
        ),
        KEEP_NULLS,
    )
    return (
        F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"prev_hash":"')),
        F.concat(F.lit('",'), F.regexp_replace(tail, r"^\{", "")),
    )


def entry_hash() -> Column:
    before, after = _json_ends()
    return F.sha2(F.encode(F.concat(before, "prev_hash", after), "UTF-8"), 256)


def append(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain the records of every chain: adds ``payload_hash``, ``prev_hash``, ``entry_hash``.

    All hashing that does not depend on order is done in the JVM.  What is left is one digest per
    record, which is serial inside a chain by definition: records arrive sorted and stream through
    with one hash of state per chain, so a chain never has to fit in memory.  All columns travel along: one shuffle.
    """
    rows = records.withColumn("payload_hash", payload_hash())
    before, after = _json_ends()
    rows = rows.withColumn("before", before).withColumn("after", after)
    start = F.lit(GENESIS)
    if heads is not None:
        rows = rows.join(heads.select("chain_id", "last_hash"), "chain_id", "left")
        start = F.coalesce("last_hash", F.lit(GENESIS))
    rows = rows.withColumn("start", start).select(*records.columns, "payload_hash", "before", "after", "start")
    kept = [c for c in rows.columns if c not in ("before", "after", "start")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        chain, prev = None, ""
        for b in batches:
            prevs, hashes = [], []
            own = [b.column(rows_at).to_pylist() for rows_at in places]
            for cid, before_, after_, start_ in zip(*own, strict=True):
                if cid != chain:
                    chain, prev = cid, start_
                prevs.append(prev)
                prev = hashlib.sha256((before_ + prev + after_).encode()).hexdigest()
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*kept, "prev_hash", "entry_hash"])

    places = [rows.columns.index(c) for c in ("chain_id", "before", "after", "start")]
    ordered = rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq")
    schema = T.StructType([*ordered.select(*kept).schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    return ordered.mapInArrow(fold, schema).withColumn("hash_algo", F.lit(ALGO))


def heads_of(log: DataFrame) -> DataFrame:
    return log.groupBy("chain_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("entry_hash", "seq").alias("last_hash"), F.count("*").alias("record_count")
    )


def verify(log: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """One row per failure: ``chain_id, seq, kind``.

    A range is cut, together with the record right before it, before neighbours are looked up: it is anchored by that record if
    the log has it.  Recomputed hashes are plain columns; only the neighbour lookup shuffles.
    """
    if start:
        log = log.where(F.col("seq") >= start - 1)
    if end is not None:
        log = log.where(F.col("seq") <= end)
    seen = bucketed_lag(log, "chain_id", "seq", ["seq", "entry_hash"]).where(F.col("seq") >= start)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("prev_seq").isNotNull() & (F.col("seq") != F.col("prev_seq") + 1), "deleted_record"),
            F.when(F.col("hash_algo") != ALGO, "algo_mismatch"),
            F.when(payload_hash() != F.col("payload_hash"), "modified_payload"),
            F.when((F.col("seq") == 0) & (F.col("prev_hash") != GENESIS), "broken_genesis"),
            F.when(F.col("prev_entry_hash").isNotNull() & (F.col("prev_hash") != F.col("prev_entry_hash")), "broken_link"),
            F.when(entry_hash() != F.col("entry_hash"), "modified_record"),
        )
    )
    return seen.select("chain_id", "seq", F.explode_outer(kinds).alias("kind")).where(F.col("kind").isNotNull())


def anchors(log: DataFrame, start: int) -> DataFrame:
    """Per chain, whether a range from ``start`` has its predecessor in the log."""
    return log.groupBy("chain_id").agg(F.bool_or(F.col("seq") == start - 1).alias("anchored"))


def head_state(log: DataFrame, heads: DataFrame) -> DataFrame:
    """State of each chain's recorded head against its log, tested in a fixed order."""
    actual = heads_of(log).select("chain_id", F.col("last_seq").alias("top"), F.col("last_hash").alias("tail_hash"), F.col("record_count").alias("n"))
    both = actual.join(heads, "chain_id", "full_outer")
    state = (
        F.when(F.col("last_seq").isNull(), "missing").when(F.col("top").isNull() | (F.col("last_seq") > F.col("top")), "truncated")
        .when(F.col("last_seq") < F.col("top"), "lagging").when(F.col("tail_hash") != F.col("last_hash"), "hash_mismatch")
        .when(F.col("record_count") != F.col("n"), "count_mismatch").otherwise("consistent")
    )
    return both.select("chain_id", state.alias("state"))


def report(log: DataFrame, failures: DataFrame) -> DataFrame:
    """Per chain: records checked, failures, first failing number and the kinds seen."""
    checked = log.groupBy("chain_id").agg(F.count("*").alias("records_checked"))
    bad = failures.groupBy("chain_id").agg(
        F.count("*").alias("failures"), F.min("seq").alias("first_failure_seq"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )
    return checked.join(bad, "chain_id", "left").fillna(0, ["failures"]).withColumn("ok", F.col("failures") == 0)


def model_actor_violations(log: DataFrame, permitted: tuple[str, ...] = ("ai_suggested",)) -> DataFrame:
    return log.where((F.col("actor_type") == "model") & ~F.col("action").isin(*permitted))
