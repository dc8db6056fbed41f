"""Field patterns over tree nodes: scoped matching, capture, cast."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions.casts import CASTS
from fleetsift.functions.text import matches_any
from fleetsift.sources import packs


def in_scope(scope: list[str] | None) -> Column:
    """None matches roots only, an empty list any depth, else each header in full."""
    if scope is None:
        return F.size("block_path") == 0
    cond = F.size("block_path") >= len(scope)
    for i, header in enumerate(scope):
        cond = cond & F.try_element_at("block_path", F.lit(i + 1)).rlike(f"^(?:{header})$")
    return cond


def resolve_capture(text: Column, pattern: str, template: str) -> Column:
    """``$n`` parts become groups, other parts stay; a pattern without groups keeps the template."""
    groups = re.compile(pattern).groups
    if not groups:
        return F.lit(template)
    parts: list[Column] = []
    for part in template.split():
        ref = re.fullmatch(r"\$(\d+)", part)
        if ref is None:
            parts.append(F.lit(part))
            continue
        index = int(ref.group(1))
        if index > groups:
            raise ValueError(f"capture ${index} but {pattern!r} has {groups} group(s)")
        parts.append(F.regexp_extract(text, pattern, index))
    return F.concat_ws(" ", *parts)


def _match(order: int, row: tuple) -> Column:
    vendor, os_family, pid, field, scope, pattern, template, cast, source = row
    raw = resolve_capture(F.col("text"), pattern, template)
    slot, fn = CASTS[cast]
    value = fn(raw)
    fired = (
        (F.col("vendor") == vendor)
        & (F.col("os_family") == os_family)
        & in_scope(scope)
        & F.col("text").rlike(f"^(?:{pattern})")
        & value.isNotNull()
    )
    typed = [
        (value if name == slot else F.lit(None)).cast(kind).alias(name)
        for name, kind in (("v_bool", "boolean"), ("v_long", "bigint"), ("v_str", "string"))
    ]
    return F.when(
        fired,
        F.struct(
            F.lit(order).alias("pattern_ord"),
            F.lit(pid).alias("pattern_id"),
            F.lit(field).alias("field"),
            F.lit(cast).alias("cast"),
            F.lit(source).alias("source"),
            raw.alias("raw_capture"),
            *typed,
        ),
    )


_HITS = (
    "array<struct<pattern_ord:int,pattern_id:string,field:string,cast:string,source:string,raw_capture:string,v_bool:boolean,v_long:bigint,v_str:string>>"
)


def hits(patterns: Sequence[tuple] = packs.PATTERNS) -> Column:
    """One struct per pattern that fires on the node and whose value can be cast, NULL where no pattern can match.

    The dimension is unrolled into literal regexes: no join, no shuffle, one compile each.  One combined test drops the many nodes that no
    pattern can match before any is tried.
    """
    if not patterns:
        return F.lit(None).cast(_HITS)
    likely = matches_any(F.col("text"), [row[5] for row in patterns], "^")
    return F.when(likely, F.array_compact(F.array(*[_match(i, p) for i, p in enumerate(patterns)])).cast(_HITS))


def matches(nodes: DataFrame, keys: list[str], patterns: Sequence[tuple] = packs.PATTERNS) -> DataFrame:
    """One row per (node, pattern) that fires."""
    placed = nodes.where(F.col("placed")).withColumn("hits", hits(patterns))
    # The outer form keeps Spark from inferring a filter that would evaluate every pattern again.
    rows = placed.select(*keys, "line_number", "raw_line", F.explode_outer("hits").alias("m")).where(F.col("m").isNotNull())
    return rows.select(*keys, "line_number", "raw_line", "m.*")
