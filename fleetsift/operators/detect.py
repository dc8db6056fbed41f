"""Platform detection and identity, computed inside each file's row.

A file is one row with its lines in an array.  Every signature becomes a literal regex over
that array, so detection needs no shuffle and stops at plan depth one however many files
there are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions import text as tx
from fleetsift.session import pin
from fleetsift.sources import packs

SCORE = "decimal(10,6)"
HIT_CHARS = 200


def with_lines(files: DataFrame, text: str = "text") -> DataFrame:
    return pin(files, "lines", tx.split_lines(F.col(text)))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _hit(kind: str, pattern: str, weight: float) -> Column:
    """First hit of one signature as a struct, NULL without one; a bad regex never hits."""
    if not _compiles(pattern):
        return F.lit(None)
    fields = lambda number, line: F.struct(
        F.lit(pattern).alias("pattern"),
        F.lit(str(weight)).cast(SCORE).alias("weight"),
        number.alias("line_number"),
        F.left(line, F.lit(HIT_CHARS)).alias("raw_line"),
    )
    if kind == "filename":
        return F.when(F.col("file_path").rlike(pattern), fields(F.lit(None).cast("int"), F.col("file_path")))
    first = F.try_element_at(F.filter("signal", lambda x: x["t"].rlike(pattern)), F.lit(1))
    return F.when(first.isNotNull(), fields(first["n"], first["t"]))


def signal_lines(patterns: Sequence[str]) -> Column:
    """Numbered lines that match any of the patterns.

    Most lines match none, so one combined test per line replaces a test per pattern.
    """
    usable = [p for p in patterns if _compiles(p)]
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    return F.filter(numbered, lambda x: tx.matches_any(x["t"], usable))


def score_candidates(files: DataFrame, signatures: Sequence[tuple] = packs.SIGNATURES) -> DataFrame:
    """Add ``candidates``: platforms with a positive score, best first, with their hits.

    A signature counts once per file, however many lines it hits; decimal weights make the
    sum independent of order.
    """
    files = pin(files, "signal", signal_lines([p for _, _, kind, p, _ in signatures if kind != "filename"]))
    by_pack: dict[tuple[str, str], list[tuple]] = {}
    for vendor, os_family, kind, pattern, weight in signatures:
        by_pack.setdefault((vendor, os_family), []).append((kind, pattern, weight))
    cells = []
    for (vendor, os_family), sigs in by_pack.items():
        hits = F.array_compact(F.array(*[_hit(*s) for s in sigs]))
        cells.append(F.struct(F.lit(vendor).alias("vendor"), F.lit(os_family).alias("os_family"), hits.alias("hits")))
    scored = F.transform(
        F.array(*cells),
        lambda c: F.struct(
            (-F.aggregate(c["hits"], F.lit(0).cast(SCORE), lambda a, h: (a + h["weight"]).cast(SCORE))).alias("order_by"),
            c["vendor"].alias("vendor"),
            c["os_family"].alias("os_family"),
            c["hits"].alias("hits"),
        ),
    )
    kept = F.array_sort(F.filter(scored, lambda c: c["order_by"] < 0))
    ranked = F.transform(
        kept,
        lambda c: F.struct(
            c["vendor"].alias("vendor"),
            c["os_family"].alias("os_family"),
            (-c["order_by"]).cast(SCORE).alias("score"),
            c["hits"].alias("hits"),
        ),
    )
    return pin(files, "candidates", ranked).drop("signal")


def explode_candidates(scored: DataFrame, *keys: str) -> DataFrame:
    """One row ``c`` per candidate.

    The outer form keeps Spark from inferring a size filter, which it would push below the
    projection and so evaluate every signature twice.
    """
    return scored.select(*keys, F.explode_outer("candidates").alias("c")).where(F.col("c").isNotNull())


def decide(
    scored: DataFrame,
    *,
    min_score: float = packs.MIN_SCORE,
    min_margin: float = packs.MIN_MARGIN,
    have_packs: bool = True,
) -> DataFrame:
    """Outcome, platform, score and margin from the ranked candidates, tested in a fixed order."""
    best = F.try_element_at("candidates", F.lit(1))
    runner = F.coalesce(F.try_element_at("candidates", F.lit(2))["score"], F.lit(0).cast(SCORE))
    score = best["score"]
    margin = (score - runner).cast(SCORE)
    outcome = (
        F.when(F.lit(not have_packs), "no_packs_available")
        .when(F.size("candidates") == 0, "no_signature_matched")
        .when(score < F.lit(str(min_score)).cast(SCORE), "below_threshold")
        .when(margin < F.lit(str(min_margin)).cast(SCORE), "ambiguous")
        .otherwise("detected")
    )
    known = F.col("outcome") == "detected"
    out = scored.withColumn("outcome", outcome).withColumn("score", score).withColumn("margin", margin)
    return out.withColumn("detected_vendor", F.when(known, best["vendor"])).withColumn(
        "detected_os", F.when(known, best["os_family"])
    )


def detect(files: DataFrame, signatures: Sequence[tuple] = packs.SIGNATURES, **limits: float) -> DataFrame:
    return decide(score_candidates(files, signatures), have_packs=bool(signatures), **limits)


def explanation(min_score: float = packs.MIN_SCORE, min_margin: float = packs.MIN_MARGIN) -> Column:
    """One sentence per outcome, for the operator."""
    label = lambda i: F.concat_ws("/", F.try_element_at("candidates", F.lit(i))["vendor"], F.try_element_at("candidates", F.lit(i))["os_family"])
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    return (
        F.when(
            F.col("outcome") == "detected",
            F.concat(label(1), F.lit(" (score "), two(F.col("score")), F.lit(", margin "), two(F.col("margin")), F.lit(")")),
        )
        .when(
            F.col("outcome") == "ambiguous",
            F.concat(
                F.lit("UNKNOWN — "), label(1), F.lit(", "), label(2), F.lit(" scored too close to separate (margin "),
                two(F.col("margin")), F.lit(f" < {min_margin:.2f})"),
            ),
        )
        .when(
            F.col("outcome") == "below_threshold",
            F.concat(
                F.lit("UNKNOWN — best candidate "), label(1), F.lit(" scored "), two(F.col("score")),
                F.lit(f", below the {min_score:.2f} threshold"),
            ),
        )
        .when(F.col("outcome") == "no_packs_available", "UNKNOWN — no detection packs are loaded")
        .otherwise("UNKNOWN — no signature matched")
    )


def identity(files: DataFrame, identities: Sequence[tuple] = packs.IDENTITIES, vendor: str = "vendor", os_family: str = "os_family") -> DataFrame:
    """Add one struct per identity field: value, line number and raw line of the first pattern
    (in declaration order) that captures something, on its first such line."""

    files = pin(files, "signal", signal_lines([p for *_, p in identities]))

    def first_capture(pattern: str) -> Column:
        group = 1 if re.compile(pattern).groups else 0
        hits = F.transform(
            "signal",
            lambda x: F.struct(
                F.regexp_extract(x["t"], pattern, group).alias("value"), x["n"].alias("line_number"), x["t"].alias("raw_line")
            ),
        )
        return F.try_element_at(F.filter(hits, lambda h: h["value"] != ""), F.lit(1))

    for field in packs.IDENTITY_FIELDS:
        arms = []
        for v, o in dict.fromkeys((v, o) for v, o, f, _ in identities if f == field):
            found = F.coalesce(*[first_capture(p) for pv, po, f, p in identities if (pv, po, f) == (v, o, field)])
            arms.append(((F.col(vendor) == v) & (F.col(os_family) == o), found))
        if arms:
            value = reduce(lambda acc, arm: acc.when(*arm), arms[1:], F.when(*arms[0]))
        else:
            value = F.lit(None).cast("struct<value:string,line_number:int,raw_line:string>")
        files = files.withColumn(f"id_{field}", value)
    return files.drop("signal")


def syntax_mode(os_family: Column) -> Column:
    """Mode by platform; Junos takes braces when any line opens a block."""
    base = reduce(
        lambda acc, kv: acc.when(os_family == kv[0], kv[1]),
        list(packs.SYNTAX_MODE.items())[1:],
        F.when(os_family == next(iter(packs.SYNTAX_MODE)), next(iter(packs.SYNTAX_MODE.values()))),
    ).otherwise("indent")
    opens = F.exists("lines", lambda x: x.rlike(packs.BLOCK_OPENER))
    return F.when((os_family == "junos") & opens, "brace").otherwise(base)


def source_limits(fields: DataFrame) -> DataFrame:
    """Attach the note that says why an input type cannot carry a field."""
    limits = packs.SOURCE_LIMITS.frame(fields.sparkSession)
    return fields.join(limits, ["source_type", "field"], "left")
