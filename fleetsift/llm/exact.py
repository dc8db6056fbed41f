"""Exact dedup by distributed most-significant-byte-first radix partitioning.

A document is the byte string of its normalised text, headed by its length.  Level by level, the documents
of a group are split by their next bytes; a group of one, or one whose bytes are used up, leaves.  The first level
takes the length and 32 bytes, later ones eight times as many bytes as the one before, so that the number of levels
is logarithmic in the longest text.  Members of an ended group went the same way through every byte: they are equal,
and no digest decides.  Each level counts groups with map-side combine and shuffles the bytes of the
documents that still share a prefix; their groups are joined on a unique key, so that Spark can split a hot one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import SPACE, empty_if_null, shared_table


def normalised(text: str) -> F.Column:
    return F.regexp_replace(empty_if_null(F.col(text)), SPACE + "+", "")


def _rest(value: F.Column, start: int) -> F.Column:
    return F.substring(value, start, 2**31 - 1)


def exact_groups(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text: str = "text", first: int = 32, factor: int = 8) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts (white space deleted; null counts as empty).

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the columns ``carry``.  The row with
    most code points in its original text, then the smallest id, stays; a null id comes after all others.  Rows that
    repeat the id of the row that stays, with as long a text, are that document and are kept with it.  Other columns of ``docs`` may have any name.
    """
    carry = carry or []
    norm = normalised(text)
    raw = norm.cast("binary")
    state = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("_")).alias("_carry"),
        F.char_length(empty_if_null(F.col(text))).cast("long").alias("_points"),
        F.sha2(raw, 256).alias("_sha"),
        F.octet_length(norm).cast("long").alias("_gid"),
        F.substring(raw, 1, first).alias("_chunk"),
        _rest(raw, first + 1).alias("_rest"),
    )
    left, width, level = [], first, 0
    own = ["_id", "_carry", "_points", "_sha"]
    while True:
        shared = state.groupBy("_gid", "_chunk").agg(F.count("*").alias("_n")).filter("_n > 1")
        # Written before it is joined: the numbers given to the groups must not change when a task runs again.
        shared = shared_table(shared.select("_gid", "_chunk", F.monotonically_increasing_id().alias("_next")), f"radix-groups-{level}")
        ended = F.octet_length("_rest") == 0
        # Merged at every size: the number of groups grows with the corpus, and so does what would be broadcast.
        split = state.join(shared.hint("merge"), ["_gid", "_chunk"], "left").select(
            *own,
            F.when(F.col("_next").isNull(), "alone").when(ended, "equal").otherwise("open").alias("_state"),
            F.col("_next").alias("_gid"),
            F.when(F.col("_next").isNotNull() & ~ended, F.col("_rest")).alias("_rest"),
        )
        split = shared_table(split, f"radix-level-{level}")
        left.append(split.filter("_state <> 'open'").select(*own, F.lit(level).alias("_level"), "_gid"))
        width *= factor
        still = split.filter("_state = 'open'")
        if still.isEmpty():
            break
        state = still.select(*own, "_gid", F.substring("_rest", 1, width).alias("_chunk"), _rest(F.col("_rest"), width + 1).alias("_rest"))
        level += 1
    done = reduce(DataFrame.unionByName, left)
    first_of = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i")))
    equal = done.filter("_gid is not null")
    # A table, so that both sides of the join are plain exchanges and a hot group can be split.
    groups = shared_table(equal.groupBy("_level", "_gid").agg(first_of.alias("_first"), F.count("*").alias("_n")), "radix-equal")

    def result(rows: DataFrame, keep: F.Column, size: F.Column, stays: F.Column) -> DataFrame:
        own = [F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(carry)]
        return rows.select(F.col("_id").alias(id_col), *own, keep.alias("keep_id"), size.cast("long").alias("group_size"), stays.alias("kept"), F.col("_sha").alias("text_sha256"))

    keep = F.col("_first.i")
    joined = equal.join(groups.hint("merge"), ["_level", "_gid"])
    alone = result(done.filter("_gid is null"), F.col("_id"), F.lit(1), F.lit(True))
    return alone.unionByName(result(joined, keep, F.col("_n"), F.col("_id").eqNullSafe(keep) & (F.col("_points") == -F.col("_first.p"))))
