"""Field assembly: from matches to one tri-state observation per declared field."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions.netaddr import let
from fleetsift.session import pin
from fleetsift.sources import packs

DETERMINABLE = ("present", "absent_default", "absent_unsupported")


def declared_fields(files: DataFrame, keys: list[str], patterns: Sequence[tuple] = packs.PATTERNS) -> DataFrame:
    """One row per (file, field its platform declares), exploded inside the row."""
    return files.select(*keys, *[c for c in ("vendor", "os_family") if c not in keys], F.explode(_declared(patterns)).alias("field"))


def _declared(patterns: Sequence[tuple]) -> Column:
    """Names of the fields that the platform of a file declares, NULL for an unknown platform."""
    arms = []
    for vendor, os_family in dict.fromkeys((p[0], p[1]) for p in patterns):
        fields = list(dict.fromkeys(p[3] for p in patterns if (p[0], p[1]) == (vendor, os_family)))
        arms.append(((F.col("vendor") == vendor) & (F.col("os_family") == os_family), F.array(*[F.lit(f) for f in fields])))
    return reduce(lambda acc, arm: acc.when(*arm), arms[1:], F.when(*arms[0]))


def _policy(field: Column, policy: dict[str, str]) -> Column:
    out = F.lit("undecided")
    for name, kind in policy.items():
        out = F.when(field == name, kind).otherwise(out)
    return out


MATCH = (
    "struct<pattern_ord:int,line_number:int,pattern_id:string,cast:string,source:string,v_bool:boolean,v_long:bigint,v_str:string,raw_line:string>"
)


def observation(matches: Column, field: Column, policy: dict[str, str]) -> Column:
    """State, value, method and evidence of one field of one file from its matches, in pattern and line order."""
    first = F.try_element_at(matches, F.lit(1))
    distinct = F.array_distinct(F.transform(matches, lambda m: F.struct(m["v_bool"], m["v_long"], m["v_str"])))
    pol = _policy(field, policy)
    has = lambda flag: F.exists(matches, lambda m: F.coalesce(m["v_bool"] == F.lit(flag), F.lit(False)))
    kind = (
        F.when(F.size(matches) == 0, "none")
        .when(first["cast"] == "list", "list")
        .when(F.size(distinct) <= 1, "one")
        .when((pol == "worst_case_true") & has(True), "true")
        .when((pol == "worst_case_false") & has(False), "false")
        .otherwise("conflict")
    )

    def state(kind: Column) -> Column:
        known = kind.isin("list", "one", "true", "false")
        return F.struct(
            field.alias("field"),
            F.when(known, "present").otherwise("unknown").alias("state"),
            F.when(kind == "none", "no_match").when(kind == "conflict", "conflicting_evidence").alias("unknown_reason"),
            F.when(known, first["cast"]).alias("cast"),
            F.when(kind == "true", F.lit(True)).when(kind == "false", F.lit(False)).when(kind == "one", first["v_bool"]).alias("v_bool"),
            F.when(kind == "one", first["v_long"]).alias("v_long"),
            F.when(kind == "one", first["v_str"]).alias("v_str"),
            F.when(kind == "list", F.transform(matches, lambda m: m["v_str"])).alias("v_list"),
            F.when(known, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(first["source"] == "admin_trained", "admin_confirmed").otherwise("deterministic").alias("method"),
            first["pattern_id"].alias("pattern_id"),
            F.transform(matches, lambda m: F.struct(m["line_number"].alias("line"), m["raw_line"].alias("raw_line"))).alias("evidence"),
            F.lit(None).cast("string").alias("default_ref"),
        )

    return let(kind, state)


def assemble(
    declared: DataFrame, found: DataFrame, keys: list[str], policy: dict[str, str] = packs.MERGE_POLICY
) -> DataFrame:
    """The observation of every declared field.

    Declared rows and matches are unioned and grouped once, so there is one shuffle and no
    join; the group is one field of one file, bounded by the file.
    """
    hit = F.struct("pattern_ord", "line_number", "pattern_id", "cast", "source", "v_bool", "v_long", "v_str", "raw_line").cast(MATCH)
    rows = declared.select(*keys, "field", F.lit(None).cast(MATCH).alias("m"), F.lit(True).alias("is_declared")).unionByName(
        found.select(*keys, "field", hit.alias("m"), F.lit(False).alias("is_declared"))
    )
    grouped = rows.groupBy(*keys, "field").agg(
        F.array_sort(F.array_compact(F.collect_list("m"))).alias("ms"), F.max("is_declared").alias("is_declared")
    ).where("is_declared")
    return pin(grouped, "o", observation(F.col("ms"), F.col("field"), policy)).select(*keys, "o.*")


def fields_of_model(policy: dict[str, str] = packs.MERGE_POLICY, patterns: Sequence[tuple] = packs.PATTERNS) -> Column:
    """Observations of a file's declared fields from the ``facts`` of its model: an array, in the file's own row."""
    def matches(field: Column) -> Column:
        own = F.transform(
            F.filter("facts", lambda f: f["hit"]["field"] == field),
            lambda f: F.struct(
                f["hit"]["pattern_ord"], f["line_number"], f["hit"]["pattern_id"], f["hit"]["cast"], f["hit"]["source"],
                f["hit"]["v_bool"], f["hit"]["v_long"], f["hit"]["v_str"], f["raw_line"],
            ).cast(MATCH),
        )
        return F.array_sort(own)

    return F.transform(_declared(patterns), lambda field: let(matches(field), lambda ms: observation(ms, field, policy)))


def value_type() -> Column:
    """Type family used by rule conditions."""
    return (
        F.when(F.col("v_bool").isNotNull(), "bool")
        .when(F.col("v_long").isNotNull(), "int")
        .when(F.col("v_str").isNotNull(), "str")
        .when(F.col("v_list").isNotNull(), "list")
    )


def value_text(of: Column | None = None) -> Column:
    """The value as text, of the row or of an observation."""
    v = F.col if of is None else lambda name: of[name]
    return F.coalesce(v("v_bool").cast("string"), v("v_long").cast("string"), v("v_str"), F.array_join(v("v_list"), ","))


def coverage(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Share of declared fields that are determinable; zero when nothing is declared."""
    known = F.count_if(F.col("state").isin(*DETERMINABLE))
    return fields.groupBy(*keys).agg(
        F.count("field").alias("declared"), known.alias("determinable"),
        F.when(F.count("field") > 0, known / F.count("field")).otherwise(0.0).alias("coverage"),
    )


def merge_flags(rows: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Merge policy alone, over boolean observations: map-side combined, any number of rows."""
    pol = _policy(F.col("field"), policy)
    agg = rows.groupBy(*keys).agg(F.bool_or("v").alias("hi"), F.bool_and("v").alias("lo"))
    value = (
        F.when(F.col("hi") == F.col("lo"), F.col("hi"))
        .when(pol == "worst_case_true", F.lit(True))
        .when(pol == "worst_case_false", F.lit(False))
    )
    return agg.select(*keys, value.alias("value"), F.when(value.isNotNull(), "present").otherwise("unknown").alias("state"))


def attribute_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence method by the first pattern, in declaration order, that matched."""
    first = F.min(F.struct("pattern_ord", "source"))
    return rows.groupBy(*keys).agg(first.alias("f")).select(
        *keys, F.col("f.pattern_ord").alias("pattern_ord"),
        F.when(F.col("f.source") == "admin_trained", "admin_confirmed").otherwise("deterministic").alias("method"),
    )
