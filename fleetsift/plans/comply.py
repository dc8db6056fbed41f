"""Queries of rule evaluation and frameworks (C rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsift.functions import conditions as cond
from fleetsift.functions.tristate import strict_all
from fleetsift.operators import detect, evaluate as ev, fields as fo, frameworks as fw, match, normalise, tree
from fleetsift.plans.detect import CFG, HITS_CTE, RANKED_CTE, SCORES_CTE, configs, quote
from fleetsift.plans.parse import CAPABILITIES, DEFAULTS, FACTS_CTE, FIELDS_CTE, RESOLVED_CTE
from fleetsift.plans.registry import query
from fleetsift.session import checkpoint_dir
from fleetsift.sources import catalogs
from fleetsift.sources import derived as d
from fleetsift.sources.rules import BASE_RULES, CATALOGS, FRAMEWORKS, VERDICTS, Rule

# ---- observations derived from customers ------------------------------------------------

_FIELDS = ("ssh_version", "telnet_enabled", "banner_text", "ntp_servers")
DEV_CTE = """dev AS (SELECT c_custkey AS n, 'c-' || c_custkey AS device_id, CASE c_nationkey % 4 WHEN 0 THEN 'cisco' WHEN 1 THEN 'cisco' WHEN 2 THEN 'arista' END AS vendor,
   CASE c_nationkey % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'nxos' WHEN 2 THEN 'eos' END AS os_family,
   CASE WHEN c_custkey % 9 <> 0 THEN (15 + c_custkey % 4) || '.' || (c_custkey % 10) END AS os_version, c_mktsegment AS seg FROM customer)"""
OBS_CTE = f"""{DEV_CTE}, obs AS (SELECT n, device_id, vendor, os_family, field, state,
   CASE WHEN state = 'unknown' THEN CASE WHEN n % 2 = 0 THEN 'no_match' ELSE 'conflicting_evidence' END END AS unknown_reason,
   CASE WHEN state IN ('unknown', 'absent_unsupported') THEN NULL WHEN f = 0 THEN 'num' WHEN f = 1 THEN 'bool' WHEN f = 2 THEN 'str' ELSE 'list' END AS vt,
   CASE WHEN f = 1 AND state IN ('present', 'absent_default') THEN n % 2 = 0 END AS vb, CASE WHEN f = 0 AND state IN ('present', 'absent_default') THEN (1 + n % 3)::DOUBLE END AS vn,
   CASE WHEN f = 2 AND state IN ('present', 'absent_default') THEN seg END AS vs,
   CASE WHEN f = 3 AND state IN ('present', 'absent_default') THEN CASE WHEN n % 5 = 0 THEN []::VARCHAR[] ELSE ['10.0.0.' || (n % 3), '10.0.0.9'] END END AS vl,
   CASE WHEN state = 'present' AND n % 29 <> 0 THEN 1 ELSE 0 END AS ev, CASE WHEN state = 'absent_default' AND n % 31 <> 0 THEN 'guide p.' || f END AS ref
  FROM (SELECT *, CASE WHEN (n * 7 + f * 13) % 11 = 0 THEN 'unknown' WHEN (n * 5 + f) % 13 < 2 THEN 'absent_default' WHEN (n + f) % 17 = 0 THEN 'absent_unsupported' ELSE 'present' END AS state
        FROM (SELECT dev.*, unnest([0, 1, 2, 3]) AS f, unnest([{', '.join(quote(f) for f in _FIELDS)}]) AS field FROM dev)) WHERE (n + f) % 23 <> 0)"""


def devices(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("c_nationkey") % 4
    n = F.col("c_custkey")
    return d.table(spark, sf, "customer").select(
        n.alias("n"), F.concat(F.lit("c-"), n).alias("device_id"),
        F.when(r < 2, "cisco").when(r == 2, "arista").alias("vendor"),
        F.when(r == 0, "ios").when(r == 1, "nxos").when(r == 2, "eos").alias("os_family"),
        F.when(n % 9 != 0, F.concat(15 + n % 4, F.lit("."), n % 10)).alias("os_version"),
        F.col("c_mktsegment").alias("seg"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(x).alias("field")) for i, x in enumerate(_FIELDS)])
    rows = devices(spark, sf).select("*", F.explode(cells).alias("x")).select("*", "x.*")
    n, f = F.col("n"), F.col("f")
    rows = rows.where((n + f) % 23 != 0).withColumn(
        "state",
        F.when((n * 7 + f * 13) % 11 == 0, "unknown").when((n * 5 + f) % 13 < 2, "absent_default")
        .when((n + f) % 17 == 0, "absent_unsupported").otherwise("present"),
    )
    known = F.col("state").isin("present", "absent_default")
    empty = F.array().cast("array<string>")
    return rows.select(
        "n", "device_id", "vendor", "os_family", "field", "state",
        F.when(F.col("state") == "unknown", F.when(n % 2 == 0, "no_match").otherwise("conflicting_evidence")).alias("unknown_reason"),
        F.when(known, F.when(f == 0, "num").when(f == 1, "bool").when(f == 2, "str").otherwise("list")).alias("value_type"),
        F.when(known & (f == 1), n % 2 == 0).alias("v_bool"),
        F.when(known & (f == 0), (1 + n % 3).cast("double")).alias("v_num"),
        F.when(known & (f == 2), F.col("seg")).alias("v_str"),
        F.when(known & (f == 3), F.when(n % 5 == 0, empty).otherwise(F.array(F.concat(F.lit("10.0.0."), n % 3), F.lit("10.0.0.9")))).alias("v_list"),
        F.when((F.col("state") == "present") & (n % 29 != 0), 1).otherwise(0).alias("evidence_count"),
        F.when((F.col("state") == "absent_default") & (n % 31 != 0), F.concat(F.lit("guide p."), f)).alias("default_ref"),
    )


# ---- the twelve operators ---------------------------------------------------------------

def sql_outcome(op: str, operand: object = None) -> str:
    """One condition on one observation, in SQL."""
    is_list = isinstance(operand, list)
    nums = is_list and all(isinstance(x, int) for x in operand)
    lit = "NULL" if operand is None else str(operand).lower() if isinstance(operand, bool | int) else quote(operand) if isinstance(operand, str) else "[" + ", ".join(
        str(x) if nums else quote(x) for x in operand) + "]"
    kind = "bool" if isinstance(operand, bool) else "num" if isinstance(operand, int) else "str" if isinstance(operand, str) else "list" if is_list else "none"
    col = {"bool": "vb", "num": "vn", "str": "vs", "list": "vl"}.get(kind)
    if op in ("equals", "not_equals"):
        eq = "false" if kind == "list" and nums else f"{col} = {lit}"
        return f"CASE WHEN vt = '{kind}' THEN {'NOT ' if op == 'not_equals' else ''}({eq}) END"
    if op in ("gt", "gte", "lt", "lte"):
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
        return f"CASE WHEN vt = 'num' THEN vn {sign} {lit} END" if kind == "num" else "NULL::BOOLEAN"
    if op in ("in", "not_in"):
        no = "NOT " if op == "not_in" else ""
        if kind != "list":
            return "NULL::BOOLEAN"
        if nums:
            return f"CASE WHEN vt = 'num' THEN {no}list_contains({lit}::DOUBLE[], vn) WHEN vt = 'bool' THEN {no}list_contains({lit}::DOUBLE[], vb::INT::DOUBLE) WHEN vt = 'str' THEN {no}false END"
        return f"CASE WHEN vt = 'str' THEN {no}list_contains({lit}, vs) WHEN vt IN ('num', 'bool') THEN {no}false END"
    if op == "contains":
        return f"CASE WHEN vt = 'list' THEN list_contains(vl, {lit}) WHEN vt = 'str' THEN contains(vs, {lit}) END" if kind == "str" else "CASE WHEN vt IN ('list', 'str') THEN false END"
    return {
        "is_true": "CASE WHEN vt = 'bool' THEN vb END", "is_false": "CASE WHEN vt = 'bool' THEN NOT vb END",
        "non_empty": "CASE WHEN vt = 'list' THEN len(vl) > 0 WHEN vt = 'str' THEN length(vs) > 0 END",
    }[op]


_MIXED = [2, True, "BUILDING", ["10.0.0.1", "10.0.0.9"]]
_LISTS = [["BUILDING", "MACHINERY"], [1, 2], "BUILDING"]
OP_CASES = {
    "c01_equals": ("equals", _MIXED), "c02_not_equals": ("not_equals", _MIXED), "c03_gt": ("gt", [2, "2", True]), "c04_gte": ("gte", [2, "2"]),
    "c05_lt": ("lt", [2, "2"]), "c06_lte": ("lte", [2, "2"]), "c07_in": ("in", _LISTS), "c08_not_in": ("not_in", _LISTS),
    "c09_contains": ("contains", ["10.0.0.1", "BUILD", 5]), "c10_is_true": ("is_true", [None]), "c11_is_false": ("is_false", [None]),
    "c12_non_empty": ("non_empty", [None]),
}


def _register_operator(name: str, op: str, operands: list) -> None:
    sql = f"WITH {OBS_CTE} " + " UNION ALL ".join(
        f"SELECT device_id, field, {i} AS case_no, {sql_outcome(op, x)} AS outcome FROM obs" for i, x in enumerate(operands)
    )

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        conds = F.array(*[cond.condition(op, x) for x in operands])
        got = observations(spark, sf).select("device_id", "field", F.posexplode_outer(cond.outcomes(conds)).alias("case_no", "outcome"))
        return got


for _name, (_op, _operands) in OP_CASES.items():
    _register_operator(_name, _op, _operands)

_PAIRS = [(("gt", 1), ("lte", 2)), (("gt", 1), ("is_true",)), (("non_empty",), ("contains", "10.0.0.9"))]


@query(
    "c13_all_of",
    f"WITH {OBS_CTE} " + " UNION ALL ".join(
        f"SELECT device_id, field, {i} AS case_no, CASE WHEN ({sql_outcome(*a)}) IS NULL OR ({sql_outcome(*b)}) IS NULL THEN NULL "
        f"ELSE ({sql_outcome(*a)}) AND ({sql_outcome(*b)}) END AS outcome FROM obs" for i, (a, b) in enumerate(_PAIRS)
    ),
)
def c13_all_of(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("case_no"), strict_all(cond.outcomes(F.array(*[cond.condition(*c) for c in p]))).alias("outcome")) for i, p in enumerate(_PAIRS)])
    return observations(spark, sf).select("device_id", "field", F.explode(cells).alias("x")).select("device_id", "field", "x.*")


_OP_LIST = "[" + ", ".join(quote(o) for o in cond.OPERATORS) + "]"


def _derived_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """One condition per part: operator by key, operand kind and value by size."""
    p, z = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("num", "str", "bool", "strlist", "none")]), (z % 5 + 1).cast("int"))
    return d.table(spark, sf, "part").select(
        p.alias("condition_id"),
        F.struct(
            F.element_at(F.array(*[F.lit(o) for o in cond.OPERATORS]), (p % 12 + 1).cast("int")).alias("op"), kind.alias("kind"),
            F.when(kind == "bool", p % 2 == 0).alias("b"), F.when(kind == "num", z.cast("double")).alias("n"), F.when(kind == "str", F.col("p_brand")).alias("s"),
            F.when(kind == "strlist", F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("l"), F.array().cast("array<double>").alias("ln"),
        ).alias("c"),
    )


@query(
    "c14_expected_text",
    f"""WITH c AS (SELECT p_partkey AS condition_id, {_OP_LIST}[(p_partkey % 12 + 1)::INT] AS op, p_size % 5 AS z, p_size, p_brand, p_partkey FROM part)
    SELECT condition_id, CASE op WHEN 'is_true' THEN 'enabled' WHEN 'is_false' THEN 'disabled' WHEN 'non_empty' THEN 'at least one value configured' ELSE
      replace(op, '_', ' ') || ' ' || CASE z WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '''' || p_brand || '''' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END
      WHEN 3 THEN '[''' || p_brand || ''']' ELSE 'None' END END AS expected FROM c""",
)
def c14_expected_text(spark: SparkSession, sf: str) -> DataFrame:
    return _derived_conditions(spark, sf).select("condition_id", cond.expected_text(F.col("c")).alias("expected"))


_BLIND = """CASE op WHEN 'equals' THEN z = 4 WHEN 'not_equals' THEN z = 4 WHEN 'gt' THEN z <> 0 WHEN 'gte' THEN z <> 0 WHEN 'lt' THEN z <> 0 WHEN 'lte' THEN z <> 0
  WHEN 'in' THEN z <> 3 WHEN 'not_in' THEN z <> 3 ELSE false END"""


@query("c15_self_check", f"SELECT condition_id, op FROM (SELECT p_partkey AS condition_id, {_OP_LIST}[(p_partkey % 12 + 1)::INT] AS op, p_size % 5 AS z FROM part) WHERE {_BLIND}")
def c15_self_check(spark: SparkSession, sf: str) -> DataFrame:
    return fw.blind_conditions(_derived_conditions(spark, sf)).select("condition_id", F.col("c.op").alias("op"))


# ---- rules over the derived observations ------------------------------------------------

RULES = (
    Rule("R-SSH", "high", "ssh_version", (("equals", 2),), refs=(("nist", "AC-17(02)"), ("cis", "2.1.1.2"))),
    Rule("R-SSH-RANGE", "medium", "ssh_version", (("gt", 0), ("lte", 2)), vendors=("cisco",), on_absent_default="pass", on_absent_unsupported="fail", refs=(("nist", "AC-12"),)),
    Rule("R-TELNET", "critical", "telnet_enabled", (("is_false",),), os_families=("ios", "eos"), on_absent_default="fail", on_absent_unsupported="pass", refs=(("stig", "CISC-ND-001210"),)),
    Rule("R-BANNER", "low", "banner_text", (("in", ["BUILDING", "MACHINERY"]),), on_absent_default="not_applicable", refs=(("nist", "AC-08"), ("cis", "1.3.3")), gaps=(("stig", "no matching control"),)),
    Rule("R-BANNER-TYPE", "info", "banner_text", (("gt", 3),), on_absent_default="unknown", gaps=(("cis", "not in this edition"),)),
    Rule("R-NTP", "low", "ntp_servers", (("non_empty",), ("contains", "10.0.0.9")), vendors=("cisco", "arista"), on_absent_unsupported="unknown", refs=(("nist", "SC-45(01)"), ("cis", "2.3.2"))),
    Rule("R-AAA", "medium", "aaa_enabled", (("is_true",),), vendors=("arista",), on_capability_unknown="unknown"),
)


def _sql_list(xs: tuple) -> str:
    return "[" + ", ".join(quote(x) for x in xs) + "]"


def _rule_sql(r: Rule, i: int) -> str:
    parts = [sql_outcome(*c) for c in r.conditions]
    out = " OR ".join(f"({p}) IS NULL" for p in parts)
    both = " AND ".join(f"({p})" for p in parts)
    vendor = "true" if "*" in r.vendors else f"coalesce(v.vendor IN ({', '.join(quote(x) for x in r.vendors)}), false)"
    osf = "true" if "*" in r.os_families else f"coalesce(v.os_family IN ({', '.join(quote(x) for x in r.os_families)}), false)"
    action = f"CASE o.state WHEN 'absent_default' THEN '{r.on_absent_default}' WHEN 'absent_unsupported' THEN '{r.on_absent_unsupported}' ELSE '{r.on_capability_unknown}' END"
    from fleetsift.functions.conditions import describe_all

    return (
        f"SELECT v.n, v.device_id, v.vendor, v.os_family, v.os_version, '{r.rule_id}' AS rule_id, {i} AS rule_ord, '{r.severity}' AS severity, '{r.field}' AS field, "
        f"{quote(describe_all(r.conditions))} AS expected, o.state, o.unknown_reason AS obs_reason, o.ev, o.ref, {action} AS action, "
        f"CASE WHEN {out} THEN NULL ELSE {both} END AS outcome FROM dev v LEFT JOIN obs o ON o.device_id = v.device_id AND o.field = '{r.field}' WHERE {vendor} AND {osf}"
    )


FINDINGS_CTE = f"""{OBS_CTE}, pairs AS ({' UNION ALL '.join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
  judged AS (SELECT *, coalesce(state = 'present' OR action = 'evaluate', false) AS judge, coalesce(ev, 0) > 0 OR coalesce(ref <> '', false) AS proven FROM pairs),
  finding AS (SELECT *, 'run:' || device_id || ':' || rule_id AS finding_id,
    CASE WHEN state IS NULL THEN 'unknown' WHEN judge THEN CASE WHEN outcome IS NULL OR NOT proven THEN 'unknown' WHEN outcome THEN 'pass' ELSE 'fail' END
      WHEN action IN ('pass', 'fail', 'not_applicable') THEN action ELSE 'unknown' END AS status,
    CASE WHEN state IS NULL THEN 'no_match' WHEN judge THEN CASE WHEN outcome IS NULL THEN 'rule_type_mismatch' WHEN NOT proven THEN 'no_evidence' END
      WHEN action NOT IN ('pass', 'fail', 'not_applicable') THEN coalesce(obs_reason, 'capability_unknown') END AS unknown_reason FROM judged)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evaluate_fleet(devices(spark, sf), observations(spark, sf), RULES)


@query("c16_applicability", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id FROM pairs")
def c16_applicability(spark: SparkSession, sf: str) -> DataFrame:
    return ev.applicable_rules(devices(spark, sf), RULES).select("device_id", "rule_id")


@query("c17_absence_policy", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id, state, action FROM pairs WHERE state IS NOT NULL AND state <> 'present'")
def c17_absence_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.applicable_rules(devices(spark, sf), RULES).join(observations(spark, sf).select("device_id", "field", "state"), ["device_id", "field"])
    return rows.where(F.col("state") != "present").select("device_id", "rule_id", "state", ev.absence_action(F.col("state")).alias("action"))


@query("c18_verdicts", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id, status, unknown_reason FROM finding")
def c18_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("device_id", "rule_id", "status", "unknown_reason")


@query("c19_evidence_gate", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id, state FROM finding WHERE unknown_reason = 'no_evidence'")
def c19_evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).where(F.col("unknown_reason") == "no_evidence").select("device_id", "rule_id", "observed.state")


@query(
    "c20_finding_build",
    f"WITH {FINDINGS_CTE} SELECT finding_id, severity, expected, coalesce(state, 'unknown') AS observed_state, coalesce(ev, 0) AS evidence_count, "
    "CASE WHEN status <> 'unknown' THEN ref END AS absence_reason FROM finding",
)
def c20_finding_build(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("finding_id", "severity", "expected", F.col("observed.state").alias("observed_state"), "evidence_count", "absence_reason")


@query("c21_fleet_evaluate", f"WITH {FINDINGS_CTE} SELECT rule_id, status, count(*) AS findings, count(DISTINCT device_id) AS devices FROM finding GROUP BY ALL")
def c21_fleet_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    # A device has one finding per rule, so counting rows counts devices.
    return findings(spark, sf).groupBy("rule_id", "status").agg(F.count("*").alias("findings"), F.count("*").alias("devices"))


def config_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered configurations to findings: detect, parse, resolve, evaluate."""
    seen = detect.detect(configs(spark, sf).drop("vendor", "os_family", "syntax_mode"))
    files = seen.withColumnsRenamed({"detected_vendor": "vendor", "detected_os": "os_family"}).withColumn(
        "syntax_mode", detect.syntax_mode(F.col("os_family"))
    ).select("device_id", "vendor", "os_family", "syntax_mode", "lines")
    keys = ["device_id", "vendor", "os_family"]
    hits = match.matches(tree.build_tree(files, ["device_id", "vendor"]), keys)
    parsed = fo.assemble(fo.declared_fields(files, ["device_id"]).select(*keys, "field"), hits, keys)
    resolved = normalise.resolve_absence(parsed, CAPABILITIES.frame(spark), DEFAULTS.frame(spark))
    obs = resolved.select(
        "device_id", "field", "state", "unknown_reason", F.when(fo.value_type() == "int", "num").otherwise(fo.value_type()).alias("value_type"),
        "v_bool", F.col("v_long").cast("double").alias("v_num"), "v_str", "v_list", F.size("evidence").alias("evidence_count"), "default_ref",
    )
    return ev.evaluate_fleet(files.select("device_id", "vendor", "os_family"), obs, BASE_RULES)


_CFG_RULES = [
    ("SSH-001", "ssh_version", "value = '2'"), ("TELNET-001", "telnet_enabled", "value = 'false'"), ("HTTP-001", "http_server_enabled", "value = 'false'"),
    ("TIMEOUT-001", "idle_timeout_seconds", "value::BIGINT > 0 AND value::BIGINT <= 600"), ("LOGGING-001", "logging_hosts", "value <> ''"),
    ("NTP-001", "ntp_servers", "value <> ''"), ("BANNER-001", "banner_present", "value = 'true'"),
]
_CFG_FINDINGS = f"""{CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE}, {FACTS_CTE}, {FIELDS_CTE}, {RESOLVED_CTE},
  cf AS ({' UNION ALL '.join(
      f"SELECT q.k, '{rid}' AS rule_id, CASE WHEN r.k IS NULL THEN 'unknown' WHEN r.state IN ('present', 'absent_default') THEN CASE WHEN {c} THEN 'pass' ELSE 'fail' END "
      f"WHEN r.state = 'absent_unsupported' THEN 'not_applicable' ELSE 'unknown' END AS status FROM decided q LEFT JOIN resolved r ON r.k = q.k AND r.field = '{f}' "
      f"AND q.outcome = 'detected' AND q.vendor = 'cisco'" for rid, f, c in _CFG_RULES)})"""


@query(
    "c22_verdict_summary",
    f"WITH {_CFG_FINDINGS} SELECT 'dev-' || k AS device_id, {', '.join(f'count(*) FILTER (status = {quote(v)}) AS n_{v}' for v in VERDICTS)}, count(*) AS rules_evaluated FROM cf GROUP BY k",
)
def c22_verdict_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.verdict_summary(config_findings(spark, sf), "device_id")


@query("c23_needs_training", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id, unknown_reason FROM finding WHERE status = 'unknown' AND unknown_reason IN ('no_match', 'low_confidence', 'uncalibrated_confidence', 'unparsed_block')")
def c23_needs_training(spark: SparkSession, sf: str) -> DataFrame:
    return ev.needs_training(findings(spark, sf)).select("device_id", "rule_id", "unknown_reason")


# ---- rules and catalogs as tables -------------------------------------------------------

_POLICIES = ("evaluate", "pass", "fail", "not_applicable", "unknown")


def part_rules(spark: SparkSession, sf: str) -> ev.Rulebook:
    """A rule for every part: one or two conditions on one of the fields, most for platforms that no device has."""
    p, size = F.col("p_partkey"), F.col("p_size")
    f = (p % 4).cast("int")
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    part = d.table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("P-"), p).alias("rule_id"), f.alias("f"))
    rules = part.select(
        p.cast("bigint").alias("rule_ord"), "rule_id", F.lit("low").alias("severity"), pick(_FIELDS, f).alias("field"),
        F.when(p % 3 == 0, F.array(F.lit("cisco"))).when(p % 3 == 1, F.array(F.lit("arista"), F.lit("cisco"))).otherwise(F.array(F.lit("*"), F.lit("cisco"))).alias("vendors"),
        F.array(F.when(p % 200 < 4, "ios").when(p % 200 < 8, "nxos").when(p % 200 < 12, "*").otherwise(F.concat(F.lit("os"), p % 200))).alias("os_families"),
        pick(_POLICIES, size % 5).alias("on_absent_default"), pick(_POLICIES, size % 3).alias("on_absent_unsupported"), F.lit("unknown").alias("on_capability_unknown"),
    )

    def cell(n: int, op: str | Column, kind: str = "none", b: bool | None = None, num: Column | None = None, s: Column | None = None) -> Column:
        null = F.lit(None)
        return F.struct(
            F.lit(n).alias("ordinal"), (F.lit(op) if isinstance(op, str) else op).alias("op"), F.lit(kind).alias("kind"), F.lit(b).cast("boolean").alias("b"),
            (null if num is None else num).cast("double").alias("n"), (null if s is None else s).cast("string").alias("s"),
            F.array().cast("array<string>").alias("l"), F.array().cast("array<double>").alias("ln"),
        )

    first = (
        F.when(f == 0, cell(1, "gte", "num", num=p % 3)).when(f == 1, cell(1, F.when(p % 8 < 4, "is_true").otherwise("is_false")))
        .when(f == 2, cell(1, "equals", "str", s=F.lit("BUILDING"))).otherwise(cell(1, "contains", "str", s=F.concat(F.lit("10.0.0."), p % 3)))
    )
    second = F.when(f == 0, cell(2, "lte", "num", num=F.lit(2))).when(f == 1, cell(2, "equals", "bool", b=True)).otherwise(cell(2, "non_empty"))
    conditions = part.select("rule_id", F.inline(F.array_compact(F.array(F.when(size % 2 == 0, second), first))))
    refs = part.where(p % 2 == 0).select("rule_id", pick(("nist", "cis", "stig"), p % 3).alias("framework"), F.concat(F.lit("C-"), p).alias("control_id"))
    gaps = part.where(p % 7 == 0).select("rule_id", F.lit("nist").alias("framework"), F.concat(F.lit("size "), "p_size").alias("reason"))
    return ev.Rulebook(rules, conditions, refs, gaps)


_PART_RULES = f"""{OBS_CTE}, pr AS (SELECT 'P-' || p_partkey AS rule_id, p_partkey AS p, p_size AS z, p_partkey % 4 AS f, [{', '.join(quote(x) for x in _FIELDS)}][(p_partkey % 4 + 1)::INT] AS field,
   CASE p_partkey % 3 WHEN 0 THEN ['cisco'] WHEN 1 THEN ['arista', 'cisco'] ELSE ['*'] END AS vendors,
   CASE WHEN p_partkey % 200 < 4 THEN 'ios' WHEN p_partkey % 200 < 8 THEN 'nxos' WHEN p_partkey % 200 < 12 THEN '*' ELSE 'os' || (p_partkey % 200) END AS os,
   {_sql_list(_POLICIES)}[(p_size % 5 + 1)::INT] AS absent, {_sql_list(_POLICIES)}[(p_size % 3 + 1)::INT] AS unsupported FROM part),
  pp AS (SELECT v.device_id, pr.*, o.state, o.unknown_reason AS obs_reason, o.ev, o.ref,
     CASE o.state WHEN 'absent_default' THEN absent WHEN 'absent_unsupported' THEN unsupported ELSE 'unknown' END AS action,
     CASE pr.f WHEN 0 THEN CASE WHEN vt = 'num' THEN vn >= p % 3 END WHEN 1 THEN CASE WHEN vt = 'bool' THEN vb = (p % 8 < 4) END WHEN 2 THEN CASE WHEN vt = 'str' THEN vs = 'BUILDING' END
       ELSE CASE WHEN vt = 'list' THEN list_contains(vl, '10.0.0.' || (p % 3)) END END AS o1,
     CASE WHEN z % 2 = 1 THEN true ELSE CASE pr.f WHEN 0 THEN CASE WHEN vt = 'num' THEN vn <= 2 END WHEN 1 THEN CASE WHEN vt = 'bool' THEN vb END
       WHEN 2 THEN CASE WHEN vt = 'str' THEN length(vs) > 0 END ELSE CASE WHEN vt = 'list' THEN len(vl) > 0 END END END AS o2,
     CASE pr.f WHEN 0 THEN 'gte ' || (p % 3) WHEN 1 THEN CASE WHEN p % 8 < 4 THEN 'enabled' ELSE 'disabled' END WHEN 2 THEN 'equals ''BUILDING''' ELSE 'contains ''10.0.0.' || (p % 3) || '''' END ||
       CASE WHEN z % 2 = 1 THEN '' ELSE ' and ' || CASE pr.f WHEN 0 THEN 'lte 2' WHEN 1 THEN 'equals True' ELSE 'at least one value configured' END END AS expected
   FROM pr JOIN dev v ON (pr.vendors[1] = '*' OR coalesce(list_contains(pr.vendors, v.vendor), false)) AND (pr.os = '*' OR coalesce(pr.os = v.os_family, false))
   LEFT JOIN obs o ON o.device_id = v.device_id AND o.field = pr.field),
  pj AS (SELECT *, CASE WHEN o1 IS NULL OR o2 IS NULL THEN NULL ELSE o1 AND o2 END AS outcome, coalesce(state = 'present' OR action = 'evaluate', false) AS judge,
     coalesce(ev, 0) > 0 OR coalesce(ref <> '', false) AS proven FROM pp)"""


@query(
    "c18_rule_tables",
    f"WITH {_PART_RULES} SELECT device_id, rule_id, expected, CASE WHEN state IS NULL THEN 'unknown' WHEN judge THEN CASE WHEN outcome IS NULL OR NOT proven THEN 'unknown' WHEN outcome THEN 'pass' ELSE 'fail' END "
    "WHEN action IN ('pass', 'fail', 'not_applicable') THEN action ELSE 'unknown' END AS status FROM pj",
)
def c18_rule_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of rules that are rows: operators, operands, scopes and policies all come from a table."""
    return ev.evaluate_fleet(devices(spark, sf), observations(spark, sf), part_rules(spark, sf)).select("device_id", "rule_id", "expected", "status")


@query("c34_gap_tables", f"WITH {_PART_RULES} SELECT device_id, rule_id, 'nist' AS framework, 'size ' || z AS reason FROM pp WHERE p % 7 = 0")
def c34_gap_tables(spark: SparkSession, sf: str) -> DataFrame:
    return fw.gap_reasons(devices(spark, sf), part_rules(spark, sf))


def catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    """Index files written from the parts, a document of each framework in files of some thousand ids, and read again; one file in ten lacks its edition."""
    p = F.col("p_partkey")
    rows = d.table(spark, sf, "part").select(
        F.element_at(F.array(*[F.lit(x) for x in ("nist", "cis", "stig")]), (p % 3 + 1).cast("int")).alias("framework"), F.floor(p / 300).cast("int").alias("part"),
        F.when(F.col("p_size") % 7 == 0, "withdrawn").otherwise("controls").alias("section"), F.concat(F.lit("C-"), p).alias("id"),
    )
    ids = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.concat(F.lit("- "), "id")))), "\n")
    edition = F.when(F.col("part") % 10 == 4, "").otherwise("edition: '7.1'\n")
    head = F.concat(F.lit("# made\nframework: "), "framework", F.lit('\ndocument: "Standard '), "framework", F.lit('"\n'), edition, F.lit("source_note: a: b\n  folded\ncovers:\n  vendor: cisco\n"))
    text = rows.groupBy("framework", "part").agg(F.concat(head, F.lit("controls:\n"), ids("controls"), F.lit("\nwithdrawn:\n"), ids("withdrawn"), F.lit("\n")).alias("text"))
    path = f"{checkpoint_dir(spark)}/catalogs-{uuid.uuid4().hex}"
    text.withColumn("folder", F.concat_ws("-", "framework", "part")).select("folder", "text").write.partitionBy("folder").text(path)
    return catalogs.read_catalogs(spark, path)


_CATALOG_CTE = """ctl AS (SELECT ['nist', 'cis', 'stig'][(p_partkey % 3 + 1)::INT] AS framework, 'C-' || p_partkey AS control_id, CASE WHEN p_size % 7 = 0 THEN 'withdrawn' ELSE 'live' END AS status
   FROM part WHERE (p_partkey // 300) % 10 <> 4),
  asked AS (SELECT DISTINCT l_suppkey, l_partkey, ['nist', 'cis', 'stig', 'iso'][(l_partkey % 3 + 1 + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END)::INT] AS framework, 'C-' || l_partkey AS control_id FROM lineitem)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("l_partkey") % 3 + 1 + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)
    framework = F.element_at(F.array(*[F.lit(x) for x in ("nist", "cis", "stig", "iso")]), at.cast("int"))
    return d.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", framework.alias("framework"), F.concat(F.lit("C-"), "l_partkey").alias("control_id")).distinct()


@query(
    "c26_catalog_files",
    f"WITH {_CATALOG_CTE} SELECT a.*, coalesce(status, 'unknown') AS status, CASE WHEN a.framework <> 'iso' THEN 'Standard ' || a.framework || ', edition 7.1, control ' || a.control_id END AS citation "
    "FROM asked a LEFT JOIN ctl c ON c.framework = a.framework AND c.control_id = a.control_id",
)
def c26_catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup over whole catalogs read from index files."""
    found = catalog_files(spark, sf)
    return fw.control_lookup(_asked(spark, sf), catalogs.controls(found), catalogs.editions(found))


@query(
    "c33_catalog_files",
    f"WITH {_CATALOG_CTE}, ref AS (SELECT DISTINCT 'rule-' || l_suppkey AS rule_id, framework, control_id FROM asked) SELECT rule_id, framework || ' ' || control_id AS subject, 'control_not_live' AS problem "
    "FROM ref WHERE NOT EXISTS (SELECT 1 FROM ctl c WHERE c.framework = ref.framework AND c.control_id = ref.control_id AND c.status = 'live')",
)
def c33_catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    refs = _asked(spark, sf).select(F.concat(F.lit("rule-"), "l_suppkey").alias("rule_id"), "framework", "control_id")
    return fw.mapping_problems(refs, refs.select("rule_id", "framework").limit(0), catalogs.controls(catalog_files(spark, sf)))


# ---- frameworks -------------------------------------------------------------------------

def _cov_sql(c) -> str:
    if c.covers is None:
        return "'covered'"
    v, o, p = c.covers
    return (
        f"CASE WHEN vendor IS DISTINCT FROM '{v}' OR os_family IS DISTINCT FROM '{o}' THEN 'not_covered' WHEN coalesce(os_version, '') = '' THEN 'undeterminable' "
        f"WHEN regexp_matches(os_version, {quote(p)}) THEN 'covered' ELSE 'not_covered' END"
    )


def _why_sql(c) -> str:
    doc = f"{c.document} {c.edition}"
    if c.covers is None:
        return quote(f"{doc} covers this device.")
    v, o, p = c.covers
    scope = f"{v}/{o} with a release matching {p}"
    plat = "coalesce(vendor, 'unknown') || '/' || coalesce(os_family, 'unknown')"
    return (
        f"CASE coverage WHEN 'covered' THEN {quote(doc + ' covers this device.')} WHEN 'undeterminable' THEN {quote(f'{doc} is written for {scope}; the release of this ')} || {plat} || "
        f"' device is unknown.' ELSE {quote(f'{doc} is written for {scope}; this device is ')} || {plat} || coalesce(' release ' || os_version, '') || '.' END"
    )


COVER_CTE = f"""{DEV_CTE}, cover AS (SELECT device_id, vendor, os_family, os_version, framework, coverage,
   CASE framework {' '.join(f"WHEN '{c.framework}' THEN {_why_sql(c)}" for c in CATALOGS)} ELSE 'no ' || upper(framework) || ' catalog has been sourced' END AS why FROM (
   {' UNION ALL '.join(f"SELECT *, '{c.framework}' AS framework, {_cov_sql(c)} AS coverage FROM dev" for c in CATALOGS)}
   UNION ALL SELECT *, 'iso', 'unsourced' FROM dev))"""
_REFS = [(r.rule_id, f, c) for r in RULES for f, c in r.refs]
_GAPS = [(r.rule_id, f, why) for r in RULES for f, why in r.gaps]
REFS_CTE = "refs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _REFS) + ") t(rule_id, framework, control_id))"
GAPS_CTE = "gaps AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _GAPS) + ") t(rule_id, framework, reason))"


@query("c24_catalog_coverage", f"WITH {COVER_CTE} SELECT device_id, framework, coverage FROM cover WHERE framework <> 'iso'")
def c24_catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return fw.coverage(devices(spark, sf)).select("device_id", "framework", "coverage")


@query("c25_coverage_explanation", f"WITH {COVER_CTE} SELECT device_id, framework, why FROM cover WHERE framework <> 'iso'")
def c25_coverage_explanation(spark: SparkSession, sf: str) -> DataFrame:
    return fw.coverage(devices(spark, sf)).select("device_id", "framework", "why")


@query(
    "c26_control_lookup",
    "WITH asked AS (SELECT p_partkey, ['nist', 'cis', 'stig'][(p_partkey % 3 + 1)::INT] AS framework, ['AC-12', 'AC-13', '1.2.8', 'CISC-ND-000010', 'nope'][(p_partkey % 5 + 1)::INT] AS control_id FROM part), "
    "ctl AS (SELECT * FROM (VALUES " + ", ".join(f"('{c.framework}', '{x}', '{s}')" for c in CATALOGS for s, xs in (("live", c.live), ("withdrawn", c.withdrawn)) for x in xs) + ") t(framework, control_id, status)) "
    "SELECT p_partkey, a.framework, a.control_id, coalesce(status, 'unknown') AS status, CASE a.framework " + " ".join(f"WHEN '{c.framework}' THEN '{c.document}, edition {c.edition}, control '" for c in CATALOGS) + " END || a.control_id AS citation FROM asked a LEFT JOIN ctl USING (framework, control_id)",
)
def c26_control_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]), (p % m + 1).cast("int"))
    asked = d.table(spark, sf, "part").select(
        "p_partkey", pick(("nist", "cis", "stig"), 3).alias("framework"), pick(("AC-12", "AC-13", "1.2.8", "CISC-ND-000010", "nope"), 5).alias("control_id")
    )
    return fw.control_lookup(asked)


@query(
    "c27_refs_for_device",
    f"WITH {FINDINGS_CTE}, {COVER_CTE[len(DEV_CTE) + 2:]}, {REFS_CTE} SELECT p.device_id, p.rule_id, string_agg(r.framework || ' ' || r.control_id, ',' ORDER BY r.framework, r.control_id) AS refs "
    "FROM pairs p JOIN refs r USING (rule_id) JOIN cover c ON c.device_id = p.device_id AND c.framework = r.framework AND c.coverage = 'covered' GROUP BY ALL",
)
def c27_refs_for_device(spark: SparkSession, sf: str) -> DataFrame:
    return fw.refs_for_device(devices(spark, sf), RULES)


@query("c28_absence_explanation", f"WITH {COVER_CTE} SELECT device_id, framework, why FROM cover WHERE coverage <> 'covered'")
def c28_absence_explanation(spark: SparkSession, sf: str) -> DataFrame:
    return fw.absence(devices(spark, sf))


_SEL = ("cis", "stig")


@query(
    "c29_selection_scope",
    f"WITH {FINDINGS_CTE}, {COVER_CTE[len(DEV_CTE) + 2:]}, {REFS_CTE}, eff AS (SELECT device_id, string_agg(CASE WHEN coverage = 'covered' THEN framework END, ',' ORDER BY framework) AS effective, "
    "string_agg(CASE WHEN coverage <> 'covered' THEN framework END, ',' ORDER BY framework) AS excluded FROM cover WHERE framework IN ('cis', 'stig') GROUP BY 1), "
    "lo AS (SELECT p.device_id, string_agg(p.rule_id, ',' ORDER BY p.rule_id) AS left_out FROM pairs p JOIN eff e ON e.device_id = p.device_id AND e.effective IS NOT NULL WHERE NOT EXISTS "
    "(SELECT 1 FROM refs r WHERE r.rule_id = p.rule_id AND list_contains(string_split(e.effective, ','), r.framework)) GROUP BY 1) "
    "SELECT e.device_id, coalesce(effective, '') AS effective, coalesce(excluded, '') AS excluded, effective IS NULL AS refused, coalesce(left_out, '') AS left_out FROM eff e LEFT JOIN lo USING (device_id)",
)
def c29_selection_scope(spark: SparkSession, sf: str) -> DataFrame:
    scope = fw.selection_scope(devices(spark, sf), RULES, _SEL)
    return scope.select(
        "device_id", F.array_join("effective", ",").alias("effective"), F.array_join("excluded", ",").alias("excluded"), "refused", F.array_join("left_out", ",").alias("left_out")
    )


@query(
    "c30_framework_filter",
    f"WITH {FINDINGS_CTE}, {REFS_CTE} SELECT device_id, rule_id FROM pairs WHERE rule_id IN (SELECT rule_id FROM refs WHERE framework IN ('cis', 'stig'))",
)
def c30_framework_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ev.applicable_rules(devices(spark, sf), RULES, _SEL).select("device_id", "rule_id")


@query(
    "c31_run_view",
    f"WITH {DEV_CTE}, run AS (SELECT o_orderkey AS audit_id, 'c-' || o_custkey AS device_id, CASE o_orderstatus WHEN 'O' THEN 'sum-active' WHEN 'F' THEN 'sum-old' END AS checksum FROM orders) "
    "SELECT audit_id, coalesce(checksum = 'sum-active', false) AS attached, CASE WHEN checksum IS NULL THEN 'contents_not_recorded' WHEN checksum <> 'sum-active' THEN 'other_rulepack' END AS withheld_reason, "
    "CASE WHEN checksum = 'sum-active' THEN CASE WHEN vendor = 'cisco' AND os_family = 'ios' AND regexp_matches(coalesce(os_version, ''), '^17\\.') THEN 'cis,nist,stig' WHEN vendor = 'cisco' AND os_family = 'ios' AND regexp_matches(coalesce(os_version, ''), '^1[67]\\.') THEN 'nist,stig' ELSE 'nist' END END AS covering "
    "FROM run LEFT JOIN dev USING (device_id)",
)
def c31_run_view(spark: SparkSession, sf: str) -> DataFrame:
    runs = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("audit_id"), F.concat(F.lit("c-"), "o_custkey").alias("device_id"),
        F.when(F.col("o_orderstatus") == "O", "sum-active").when(F.col("o_orderstatus") == "F", "sum-old").alias("checksum"),
    )
    return fw.run_view(runs, devices(spark, sf), "sum-active")


@query("c32_device_options", f"WITH {COVER_CTE} SELECT device_id, framework, coverage = 'covered' AS describes_device, CASE WHEN coverage <> 'covered' THEN why END AS reason FROM cover WHERE framework <> 'iso'")
def c32_device_options(spark: SparkSession, sf: str) -> DataFrame:
    return fw.coverage(devices(spark, sf)).select(
        "device_id", "framework", (F.col("coverage") == "covered").alias("describes_device"), F.when(F.col("coverage") != "covered", F.col("why")).alias("reason")
    )


_MAP_CTE = """ref AS (SELECT 'rule-' || (l_orderkey % 500) AS rule_id, ['nist', 'cis', 'stig'][(l_linenumber % 3 + 1)::INT] AS framework,
   ['AC-12', 'AC-13', '1.2.8', 'CISC-ND-001210', 'nope'][(l_partkey % 5 + 1)::INT] AS control_id FROM lineitem),
   gap AS (SELECT DISTINCT 'rule-' || (l_orderkey % 500) AS rule_id, ['nist', 'cis', 'stig'][(l_linenumber % 3 + 1)::INT] AS framework FROM lineitem WHERE l_discount > 0.09 AND l_tax < 0.01)"""


@query(
    "c33_mapping_validity",
    f"WITH {_MAP_CTE} SELECT rule_id, framework || ' ' || control_id AS subject, 'duplicate_ref' AS problem FROM ref GROUP BY rule_id, framework, control_id HAVING count(*) > 1 "
    "UNION ALL SELECT DISTINCT rule_id, framework, 'mapped_and_declined' FROM ref SEMI JOIN gap USING (rule_id, framework) "
    "UNION ALL SELECT DISTINCT rule_id, framework || ' ' || control_id, 'control_not_live' FROM ref WHERE (framework, control_id) NOT IN ("
    + ", ".join(f"('{c.framework}', '{x}')" for c in CATALOGS for x in c.live) + ")",
)
def c33_mapping_validity(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem")
    rule = F.concat(F.lit("rule-"), F.col("l_orderkey") % 500).alias("rule_id")
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c + 1).cast("int"))
    framework = pick(("nist", "cis", "stig"), F.col("l_linenumber") % 3).alias("framework")
    refs = li.select(rule, framework, pick(("AC-12", "AC-13", "1.2.8", "CISC-ND-001210", "nope"), F.col("l_partkey") % 5).alias("control_id"))
    gaps = li.where((F.col("l_discount") > 0.09) & (F.col("l_tax") < 0.01)).select(rule, framework).distinct()
    return fw.mapping_problems(refs, gaps)


@query(
    "c34_gap_reasons",
    f"WITH {FINDINGS_CTE}, {COVER_CTE[len(DEV_CTE) + 2:]}, {GAPS_CTE} SELECT p.device_id, p.rule_id, g.framework, g.reason FROM pairs p JOIN gaps g USING (rule_id) "
    "JOIN cover c ON c.device_id = p.device_id AND c.framework = g.framework AND c.coverage = 'covered'",
)
def c34_gap_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return fw.gap_reasons(devices(spark, sf), RULES)
