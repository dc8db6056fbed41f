"""Prefix trie of conversations by truncation peeling.

Every conversation is a list of chained digests, one a turn, so that equal digests are equal prefixes.  Peeling starts at the greatest depth: the conversations that
end there are merged with the nodes that survive from below, rows of one digest become one node, whose sums are then final; the last turn is stripped and the rest is
grouped again.  Nodes are found and summed in the same pass, and a level never holds more rows than it has distinct prefixes.

Levels are peeled in bands.  A level of many rows is a band of its own, peeled by one grouping.  Levels of few rows, such as those that one endless conversation reaches
alone, form a band together: its rows are dealt out by their prefix at the band's floor and every task strips all levels of its own subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.llm.common import SPACE, empty_if_null, shared_table

#: Turns of each base conversation that others may take over, and how many ids share one.
HEAD, FAMILY = 3, 20
#: Rows, summed over its levels, of a band of more than one level.
BAND_ROWS = 1 << 13

_PEELED = "keys array<binary>, words array<int>, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NODE = "key binary, parent_key binary, depth int, " + _PEELED


def sequences(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> (conv_id, steps array of struct(step, words)), one row a conversation.

    Turns are ordered by ``turn``, null first, equal numbers by the digest of role and text.  A step is 128 bits of the SHA-256 of role and text.  Texts stay where they are:
    some 40 bytes a turn are shuffled, and a conversation of any length is one row of 20 bytes a turn.  Rows without a conv_id belong to no conversation.
    """
    role, text = empty_if_null(F.col("role")), empty_if_null(F.col("text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    step = F.substring(F.unhex(digest), 1, 16)
    cut = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", step.alias("step"), F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+")).alias("words"))
    grouped = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "step", "words"))).alias("steps"))
    return grouped.withColumn("steps", F.transform("steps", lambda x: F.struct(x["step"].alias("step"), x["words"].alias("words"))))


def rebuild(found: DataFrame) -> DataFrame:
    """Every conversation c as the first h steps of conversation c - c % 20 (none if absent), then its own after its first h; h is CRC-32 of c as text, modulo 4."""
    head = found.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("steps", 1, HEAD).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    joined = found.withColumns({"_base": base, "_h": h}).join(head, "_base", "left")
    own = F.slice("steps", F.col("_h") + 1, F.size("steps"))
    taken = F.when(F.col("_head").isNull(), F.slice("steps", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    return joined.select("conv_id", F.concat(taken, own).alias("steps"))


def chained(found: DataFrame) -> DataFrame:
    """(conv_id, steps) -> (conv_id, keys, words): the key of a prefix is the digest of the shorter prefix's key and the last step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = [], []
            for steps in b.column("steps"):
                before, chain, counts = b"", [], []
                for s in steps:
                    before = hashlib.sha256(before + s["step"].as_py()).digest()[:16]
                    chain.append(before)
                    counts.append(s["words"].as_py())
                keys.append(chain)
                words.append(counts)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(keys, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))], names=["conv_id", "keys", "words"])

    return found.mapInArrow(run, "conv_id long, keys array<binary>, words array<int>")


def _key(depth: Column) -> Column:
    """Key of the row's prefix of that depth; the root's is empty."""
    return F.when(depth < 1, F.lit(b"")).otherwise(F.try_element_at("keys", depth))


def end_digests(rows: DataFrame) -> DataFrame:
    """(key, conv_id) -> (key, ends): SHA-256 of the key's ids, ascending and joined by commas.  Sorted ids stream through the hash, so that a group of any size takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield _ends(done)
        yield _ends([(last, state.hexdigest())] if last is not None else [])

    return rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def _ends(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], names=["key", "ends"])


def ended(chains: DataFrame) -> DataFrame:
    """One row for each distinct whole sequence, as a node that has nothing below it yet."""
    rows = chains.withColumn("key", _key(F.size("keys")))
    merged = rows.groupBy("key").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("long")
    return merged.join(end_digests(rows), "key").select(
        F.size("keys").alias("len"), "keys", "words", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends"
    )


def bands(lengths: dict[int, int], most: int = BAND_ROWS) -> list[tuple[int, int]]:
    """(floor, top) from the greatest depth down to 1, a band being the levels above floor up to top; ``lengths``: sequences by their number of turns.

    A level's rows are at most the sequences that reach it; levels share a band as long as their rows add up to ``most``.
    """
    alive, reach = {}, 0
    for d in range(max(lengths, default=0), 0, -1):
        reach += lengths.get(d, 0)
        alive[d] = reach
    found, top = [], max(lengths, default=0)
    while top:
        floor, rows = top - 1, alive[top]
        while floor and rows + alive[floor] <= most:
            rows, floor = rows + alive[floor], floor - 1
        found.append((floor, top))
        top = floor
    return found


def peel_level(rows: DataFrame, depth: int) -> DataFrame:
    """One level by one grouping: rows whose prefix has that depth -> nodes of that depth."""
    d = F.lit(depth)
    sums = rows.groupBy(_key(d).alias("key")).agg(
        F.first("keys").alias("keys"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    own = F.coalesce(F.try_element_at("words", d), F.lit(0)) if depth else F.lit(0)
    made = {
        "depth": d, "parent_key": _key(d - 1) if depth else F.lit(None).cast("binary"),
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * own,
    }
    return sums.withColumns(made).select(*[c.split()[0] for c in _NODE.split(", ")])


def peel_band(rows: DataFrame, floor: int, top: int) -> DataFrame:
    """Several levels in the tasks that hold their subtrees; only nodes just above the floor keep the list of their keys, which the next band asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_depth: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                by_depth.setdefault(len(r["keys"]), []).append(r)
        below: list[dict] = []
        for d in range(top, floor, -1):
            nodes: dict[bytes, dict] = {}
            for r in by_depth.pop(d, []) + below:
                key = r["keys"][d - 1]
                n = nodes.get(key)
                if n is None:
                    nodes[key] = dict(r)
                    continue
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    n[c] += r[c]
                n["conv_id"], n["ends"] = min(n["conv_id"], r["conv_id"]), n["ends"] or r["ends"]
            done, below = [], []
            for key, n in nodes.items():
                keys, words = n["keys"], n["words"]
                n["n_leaves"] = n["n_leaves"] if n["n_children"] else 1
                n["saved_tokens"] += (n["n_convs"] - 1) * words[d - 1]
                kept = {"keys": keys[:d], "words": words[:d]} if d == floor + 1 else {"keys": None, "words": None}
                done.append(n | kept | {"key": key, "parent_key": keys[d - 2] if d > 1 else b"", "depth": d})
                below.append(n | {"n_children": 1, "ends": None})
            yield pa.RecordBatch.from_pylist(done, _SCHEMA)

    return rows.repartition(F.try_element_at("keys", F.lit(floor + 1))).mapInArrow(run, _NODE)


_SCHEMA = pa.schema(
    [("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int32()), ("keys", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))]
    + [(c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string())]
)


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` as rows of the level above: the last turn is gone, each is one child."""
    kept = {"keys": F.slice("keys", 1, depth - 1), "words": F.slice("words", 1, depth - 1), "n_children": F.lit(1).cast("long"), "ends": F.lit(None).cast("string")}
    return nodes.filter(F.col("depth") == depth).withColumns(kept).select(*[c.split()[0] for c in _PEELED.split(", ")])


def conversation_trie(turns: DataFrame, most: int = BAND_ROWS) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> the nodes of the trie of the rebuilt conversations, one row each.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Null roles and texts are empty; a
    conversation without turns ends at the root; rows without a conv_id are left out; repeated rows are repeated turns; an empty table has no node.  Other columns play no part.  Prefixes are
    told apart by 128-bit digests.
    """
    ends = shared_table(ended(chained(rebuild(sequences(turns)))).sortWithinPartitions("len"), "trie-ended")
    lengths = {r[0]: r[1] for r in ends.groupBy("len").count().collect()}  # one row for each length
    fields = [c.split()[0] for c in _PEELED.split(", ")]
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for floor, top in [*bands(lengths, most), (-1, 0)]:
        rows = ends.filter((F.col("len") > floor) & (F.col("len") <= top)).select(*fields)
        rows = rows if below is None else rows.unionByName(below)
        nodes = shared_table(peel_level(rows, top) if floor == top - 1 else peel_band(rows, floor, top), "trie-level")
        below = _stripped(nodes, floor + 1) if floor >= 0 else None
        levels.append(nodes.drop("keys", "words"))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    parents = found.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent_key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
