"""Mixing sources to target weights by Pfair scheduling.

A source of weight ``w`` of a total ``W`` gets its block ``i`` (from 0) released at slot ``floor(i W / w)`` and due by ``ceil((i+1) W / w)``.
In each slot the released block with the earliest deadline goes next.  As the shares add up to one no deadline is missed, and in every
prefix each source is less than one block away from its target.

Weights are kept as they are: releases and deadlines come from whole-number arithmetic on the exact values of the given floats, without rounding, for any number of sources.  The schedule has a row per
block of the mix and is made in one task by a heap that holds a block per source, as each slot depends on those before; its rows stream out, and documents meet them by equi-joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import shared_table
from fleetsift.operators.scan import dense_sequence


def schedule(weights: Mapping[str, float], needed: Mapping[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) from slot 0 until every source has its ``needed`` blocks, by the exact weights: earliest deadline among released blocks, ties by name."""
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("a source has no finite weight above zero")
    # Floats are fractions of powers of two: the largest denominator makes all of them whole.
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = max(x.denominator for x in exact.values())
    whole = {k: int(x * scale) for k, x in exact.items()}
    total, missing, slot = sum(whole.values()), len(whole), 0
    waiting: list[tuple[int, str, int]] = []
    ready = [(-(-total // w), k, 0) for k, w in whole.items()]
    heapq.heapify(ready)
    while missing:
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[k]), k, i))
        due, k, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block is late")
        yield k, i, slot
        missing -= i + 1 == needed[k]
        heapq.heappush(waiting, ((i + 1) * total // whole[k], k, i + 1))
        slot += 1


def _scheduled(batches: Iterator[pa.RecordBatch], weights: Mapping[str, float] | None, power: float, block: int) -> Iterator[pa.RecordBatch]:
    sizes = {k: n for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    if not sizes:
        return
    target = {k: float(n) ** power if weights is None else float(weights[k[1:]]) for k, n in sizes.items()}
    some: list[tuple[str, int, int]] = []
    names = ["_key", "_turn", "_slot"]
    for row in schedule(target, {k: -(-n // block) for k, n in sizes.items()}):
        some.append(row)
        if len(some) == 65536:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names=names)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names=names)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.8, block: int = 64, id_col: str = "doc_id", source: str = "source", names: tuple[str, str, str] = ("epoch", "slot", "position")) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, each as often as its source's target asks for.

    ``weights`` gives each source's target (every source that occurs needs one above zero); without it the target is the source's number
    of documents to the ``power``.  Targets are kept exactly.  The mix is as long as it must be for every document to occur:
    the source that is scarcest against its target is read once, others again from their start (``epoch`` 1, 2, ...), the last block being filled up
    likewise.  Added columns: ``epoch``, ``slot`` (of the block) and ``position``, from 0 without gaps; a column of that name is replaced.  Within a source documents come in the order of
    the MD5 of their id.  A null source is a source of its own (``weights`` key "").  An empty table gives an empty mix.
    """
    epoch, slot, position = names
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    own = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*own).alias("_row"), key.alias("_key"), F.col(id_col).alias("_id"), F.md5(F.col(id_col).cast("string")).alias("_order"))
    bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    numbered = dense_sequence(rows, "_key", F.coalesce(bucket, F.lit(-1)), ["_order", "_id"], "_rank")
    sizes = shared_table(rows.groupBy("_key").agg(F.count("*").alias("_n")), "mix-sizes")
    made = sizes.repartition(1).mapInArrow(lambda it: _scheduled(it, weights, power, block), "_key string, _turn long, _slot long")
    slots = shared_table(made, "mix-slots")
    # Written, so that Spark knows how small it is: a row per source.
    plan = shared_table(sizes.join(slots.groupBy("_key").agg((block * F.count("*")).alias("_total")), "_key"), "mix-plan")
    last = F.floor((F.col("_total") - 1 - F.col("_rank")) / F.col("_n")).cast("int")
    placed = numbered.join(plan, "_key").withColumn("_epoch", F.explode(F.sequence(F.lit(0), last)))
    place = F.col("_rank") + F.col("_epoch") * F.col("_n")
    placed = placed.withColumn("_turn", F.floor(place / block)).join(slots, ["_key", "_turn"])
    return placed.select("_row", "_epoch", "_slot", (F.col("_slot") * block + place % block).alias("_position")).select(
        "_row.*", F.col("_epoch").alias(epoch), F.col("_slot").cast("long").alias(slot), F.col("_position").cast("long").alias(position)
    )
