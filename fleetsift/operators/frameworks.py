"""Framework catalogs: coverage of a device, control lookup, mappings and selections.

Catalog documents are a handful of literals, so coverage is an array built inside the device row and
exploded; nothing is joined to decide which catalogs describe which device.  Their controls are a table of any size and are joined by (framework, control id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions.conditions import outcome
from fleetsift.operators.evaluate import Rulebook, Rules, applicable_rules
from fleetsift.sources.literals import Literal
from fleetsift.sources.rules import CATALOGS, FRAMEWORKS, Catalog


def coverage_state(c: Catalog) -> Column:
    if c.covers is None:
        return F.lit("covered")
    vendor, os_family, release = c.covers
    version = F.coalesce("os_version", F.lit(""))
    same = F.coalesce((F.col("vendor") == vendor) & (F.col("os_family") == os_family), F.lit(False))
    return (
        F.when(~same, "not_covered").when(version == "", "undeterminable").when(version.rlike(release), "covered").otherwise("not_covered")
    )


def _why(c: Catalog, state: Column) -> Column:
    doc = f"{c.document} {c.edition}"
    yes = F.lit(f"{doc} covers this device.")
    if c.covers is None:
        return yes
    vendor, os_family, release = c.covers
    scope = f"{doc} is written for {vendor}/{os_family} with a release matching {release}"
    platform = F.concat_ws("/", F.coalesce("vendor", F.lit("unknown")), F.coalesce("os_family", F.lit("unknown")))
    return (
        F.when(state == "covered", yes)
        .when(state == "undeterminable", F.concat(F.lit(f"{scope}; the release of this "), platform, F.lit(" device is unknown.")))
        .otherwise(
            F.concat(
                F.lit(f"{scope}; this device is "), platform,
                F.coalesce(F.concat(F.lit(" release "), "os_version"), F.lit("")), F.lit("."),
            )
        )
    )


def coverage_array(catalogs: Sequence[Catalog] = CATALOGS) -> Column:
    cells = []
    for c in catalogs:
        state = coverage_state(c)
        cells.append(F.struct(F.lit(c.framework).alias("framework"), state.alias("coverage"), _why(c, state).alias("why")))
    return F.array(*cells)


def coverage(devices: DataFrame) -> DataFrame:
    return devices.select("device_id", F.explode(coverage_array()).alias("c")).select("device_id", "c.*")


def covering(catalogs: Sequence[Catalog] = CATALOGS) -> Column:
    """Sorted names of the frameworks whose catalog covers the row's device."""
    return F.array_sort(F.transform(F.filter(coverage_array(catalogs), lambda c: c["coverage"] == "covered"), lambda c: c["framework"]))


def absence(devices: DataFrame) -> DataFrame:
    """Every framework that contributes nothing to a device, and why."""
    missing = [f for f in FRAMEWORKS if f not in {c.framework for c in CATALOGS}]
    extra = [F.struct(F.lit(f).alias("framework"), F.lit("unsourced").alias("coverage"), F.lit(f"no {f.upper()} catalog has been sourced").alias("why")) for f in missing]
    rows = devices.select("device_id", F.explode(F.concat(coverage_array(), F.array(*extra))).alias("c"))
    return rows.where(F.col("c.coverage") != "covered").select("device_id", "c.framework", "c.why")


_CONTROLS = Literal(
    "framework_control", "framework string, control_id string, status string",
    [(c.framework, x, s) for c in CATALOGS for s, xs in (("live", c.live), ("withdrawn", c.withdrawn)) for x in xs],
)
_EDITIONS = Literal("framework_index", "framework string, document string, edition string", [(c.framework, c.document, c.edition) for c in CATALOGS])


def control_lookup(asked: DataFrame, controls: DataFrame | None = None, editions: DataFrame | None = None) -> DataFrame:
    """Status of each asked control id and its citation text; ``controls`` and ``editions`` as ``sources.catalogs`` reads them, the short built-in ones if not given."""
    spark = asked.sparkSession
    known = (_CONTROLS.frame(spark) if controls is None else controls).select("framework", "control_id", "status")
    cited = (_EDITIONS.frame(spark) if editions is None else editions).select("framework", "document", "edition")
    rows = asked.join(known, ["framework", "control_id"], "left").join(cited, "framework", "left")
    return rows.select(
        *asked.columns, F.coalesce("status", F.lit("unknown")).alias("status"),
        F.concat("document", F.lit(", edition "), "edition", F.lit(", control "), "control_id").alias("citation"),
    )


def refs_for_device(devices: DataFrame, rules: Rules) -> DataFrame:
    """References of each applicable rule whose catalog covers the device, decided in the row."""
    pairs = applicable_rules(devices.withColumn("covering", covering()), rules, carry=["covering"])
    kept = F.array_sort(F.filter("refs", lambda x: F.array_contains("covering", x["framework"])))
    text = F.array_join(F.transform(kept, lambda x: F.concat_ws(" ", x["framework"], x["control_id"])), ",")
    return pairs.select("device_id", "rule_id", text.alias("refs")).where(F.col("refs") != "")


def selection_scope(devices: DataFrame, rules: Rules, selection: Sequence[str]) -> DataFrame:
    """Effective and excluded frameworks of a selection, refusal, and the rules left out."""
    chosen = F.array(*[F.lit(s) for s in sorted(selection)])
    rows = devices.withColumn("effective", F.array_intersect(chosen, covering()))
    pairs = applicable_rules(rows, rules, carry=["effective"]).where((F.size("effective") > 0) & ~F.arrays_overlap("rule_frameworks", "effective"))
    left_out = pairs.groupBy("device_id").agg(F.array_sort(F.collect_list("rule_id")).alias("left_out"))
    return rows.join(left_out, "device_id", "left").select(
        "device_id", "effective", F.array_except(chosen, F.col("effective")).alias("excluded"), (F.size("effective") == 0).alias("refused"),
        F.coalesce("left_out", F.array().cast("array<string>")).alias("left_out"),
    )


def run_view(runs: DataFrame, devices: DataFrame, active_checksum: str) -> DataFrame:
    """Mappings are attached only to runs decided by the active rules; else the reason why not."""
    attached = F.coalesce(F.col("checksum") == active_checksum, F.lit(False))
    why = F.when(F.col("checksum").isNull(), "contents_not_recorded").when(~attached, "other_rulepack")
    dev = devices.select("device_id", F.array_join(covering(), ",").alias("covers"))
    return runs.join(dev, "device_id", "left").select(
        "audit_id", attached.alias("attached"), why.alias("withheld_reason"), F.when(attached, F.col("covers")).alias("covering")
    )


def mapping_problems(refs: DataFrame, gaps: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Duplicate references, frameworks both mapped and declined, ids that are not live; ``controls`` as for ``control_lookup``."""
    known = _CONTROLS.frame(refs.sparkSession) if controls is None else controls
    live = known.where(F.col("status") == "live").select("framework", "control_id").distinct()
    counted = refs.groupBy("rule_id", "framework", "control_id").agg(F.count("*").alias("n"))
    subject = F.concat_ws(" ", "framework", "control_id").alias("subject")
    dup = counted.where(F.col("n") > 1).select("rule_id", subject, F.lit("duplicate_ref").alias("problem"))
    both = refs.select("rule_id", "framework").distinct().join(gaps, ["rule_id", "framework"], "left_semi").select(
        "rule_id", F.col("framework").alias("subject"), F.lit("mapped_and_declined").alias("problem")
    )
    dead = counted.join(live, ["framework", "control_id"], "left_anti").select("rule_id", subject, F.lit("control_not_live").alias("problem"))
    return dup.unionByName(both).unionByName(dead)


def gap_reasons(devices: DataFrame, rules: Rules) -> DataFrame:
    """Declined mappings, shown only where the catalog covers the device."""
    gaps = rules.gaps if isinstance(rules, Rulebook) else Literal(
        "rule_gap", "rule_id string, framework string, reason string", [(r.rule_id, f, why) for r in rules for f, why in r.gaps]
    ).frame(devices.sparkSession)
    pairs = applicable_rules(devices.withColumn("covering", covering()), rules, carry=["covering"], declined=gaps)
    rows = pairs.select("device_id", "rule_id", "covering", F.inline("gaps"))
    return rows.where(F.array_contains("covering", F.col("framework"))).select("device_id", "rule_id", "framework", "reason")


def blind_conditions(conditions: DataFrame) -> DataFrame:
    """Conditions that are NULL on every sample shape: they would abstain on every device."""
    null = lambda t: F.lit(None).cast(t)
    types = ("boolean", "double", "string", "array<string>")
    samples = [("bool", F.lit(True)), ("num", F.lit(1.0)), ("str", F.lit("x")), ("list", F.array(F.lit("x")))]
    cells = []
    for i, (vt, value) in enumerate(samples):
        slots = [value if i == j else null(t) for j, t in enumerate(types)]
        cells.append(outcome(F.col("c"), F.lit(vt), *slots))
    return conditions.where(F.forall(F.array(*cells), lambda o: o.isNull()))
