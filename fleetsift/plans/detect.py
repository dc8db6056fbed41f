"""Queries of platform detection and identity (D rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.operators import detect as ops
from fleetsift.operators import packstore
from fleetsift.plans.registry import query
from fleetsift.sources import derived as d
from fleetsift.sources import packs


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HITS_CTE = "hits AS (" + " UNION ALL ".join(
    f"SELECT k, {quote(v)} AS vendor, {quote(o)} AS os_family, {quote(p)} AS pattern, {w} AS weight, "
    f"min(line_number) AS line_number, left(arg_min(raw_line, line_number), 200) AS raw_line "
    f"FROM cfgl WHERE regexp_matches(raw_line, {quote(p)}) GROUP BY k"
    for v, o, _, p, w in packs.SIGNATURES
) + ")"
SCORES_CTE = "scores AS (SELECT k, vendor, os_family, round(sum(weight::DECIMAL(10,6)), 6)::DOUBLE AS score FROM hits GROUP BY ALL)"
RANKED_CTE = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vendor, os_family) AS r FROM scores), "
    "best AS (SELECT b.k, a.score, a.vendor, a.os_family, a.score - coalesce(z.score, 0) AS margin, z.vendor AS v2, z.os_family AS o2 "
    "FROM base b LEFT JOIN ranked a ON a.k = b.k AND a.r = 1 LEFT JOIN ranked z ON z.k = b.k AND z.r = 2), "
    f"decided AS (SELECT *, CASE WHEN score IS NULL THEN 'no_signature_matched' WHEN round(score, 6) < {packs.MIN_SCORE} "
    f"THEN 'below_threshold' WHEN round(margin, 6) < {packs.MIN_MARGIN} THEN 'ambiguous' ELSE 'detected' END AS outcome FROM best)"
)
CFG = d.config_lines_cte()


def configs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.with_lines(d.device_config(spark, sf))


@query("d01_signature_match", f"WITH {CFG}, {HITS_CTE} SELECT k, vendor, os_family, pattern, line_number, raw_line FROM hits")
def d01_signature_match(spark: SparkSession, sf: str) -> DataFrame:
    scored = ops.score_candidates(configs(spark, sf).drop("vendor", "os_family"))
    flat = ops.explode_candidates(scored, "k").select("k", "c.vendor", "c.os_family", F.explode_outer("c.hits").alias("h"))
    return flat.select("k", "vendor", "os_family", "h.pattern", "h.line_number", "h.raw_line")


@query("d02_weighted_score", f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE} SELECT k, vendor, os_family, score FROM scores")
def d02_weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = ops.score_candidates(configs(spark, sf).drop("vendor", "os_family"))
    return ops.explode_candidates(scored, "k").select("k", "c.vendor", "c.os_family", F.col("c.score").cast("double").alias("score"))


@query(
    "d03_rank_threshold",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE} SELECT k, outcome, CASE WHEN outcome = 'detected' THEN vendor END AS detected_vendor, "
    "CASE WHEN outcome = 'detected' THEN os_family END AS detected_os, score, round(margin, 6) AS margin FROM decided",
)
def d03_rank_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ops.detect(configs(spark, sf)).select(
        "k", "outcome", "detected_vendor", "detected_os", F.col("score").cast("double").alias("score"), F.col("margin").cast("double").alias("margin")
    )


@query(
    "d04_candidate_evidence",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE} SELECT s.k, s.vendor, s.os_family, s.score, "
    "string_agg(h.line_number || ':' || h.raw_line, '|' ORDER BY h.line_number, h.raw_line, h.pattern) AS hit_lines FROM scores s JOIN hits h "
    "ON h.k = s.k AND h.vendor = s.vendor AND h.os_family = s.os_family GROUP BY ALL",
)
def d04_candidate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    scored = ops.score_candidates(configs(spark, sf).drop("vendor", "os_family"))
    lines = F.transform(
        F.array_sort(F.transform("c.hits", lambda h: F.struct(h["line_number"].alias("n"), h["raw_line"].alias("t"), h["pattern"].alias("p")))),
        lambda h: F.concat(h["n"], F.lit(":"), h["t"]),
    )
    return ops.explode_candidates(scored, "k").select(
        "k", "c.vendor", "c.os_family", F.col("c.score").cast("double").alias("score"), F.array_join(lines, "|").alias("hit_lines")
    )


@query(
    "d05_explanation",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE} SELECT k, CASE outcome "
    "WHEN 'detected' THEN printf('%s/%s (score %.2f, margin %.2f)', vendor, os_family, score, margin) "
    f"WHEN 'ambiguous' THEN printf('UNKNOWN — %s/%s, %s/%s scored too close to separate (margin %.2f < {packs.MIN_MARGIN:.2f})', vendor, os_family, v2, o2, margin) "
    f"WHEN 'below_threshold' THEN printf('UNKNOWN — best candidate %s/%s scored %.2f, below the {packs.MIN_SCORE:.2f} threshold', vendor, os_family, score) "
    "ELSE 'UNKNOWN — no signature matched' END AS explanation FROM decided",
)
def d05_explanation(spark: SparkSession, sf: str) -> DataFrame:
    return ops.detect(configs(spark, sf)).select("k", ops.explanation().alias("explanation"))


# Facts of the rendered files: which template line holds what, and its value.
IDENTITY_FACTS = [
    ("1-URGENT", 2, "hostname", "'edge-' || k"), ("1-URGENT", 0, "os_version", "'17.' || (k % 10)"),
    ("2-HIGH", 1, "hostname", "'leaf-' || k"), ("2-HIGH", 0, "os_version", "'9.3(' || (k % 8) || ')'"),
    ("3-MEDIUM", 3, "hostname", "'sw-' || k"), ("3-MEDIUM", 0, "os_version", "'4.29.' || (k % 9) || 'F'"),
    ("3-MEDIUM", 0, "model", "'DCS-7050SX3'"),
    ("4-NOT SPECIFIED", 1, "hostname", "'srx-' || k"), ("4-NOT SPECIFIED", 0, "os_version", "'21.4R' || (k % 9)"),
    ("5-LOW", 3, "hostname", "'core-' || k"), ("5-LOW", 1, "os_version", "'21.4R' || (k % 9) || '.15'"),
]
IDENTITY_CTE = "ident AS (" + " UNION ALL ".join(
    f"SELECT k, {quote(f)} AS field, {v} AS value, line_number, raw_line FROM cfgl WHERE pr = {quote(pr)} AND tpl = {t}"
    for pr, t, f, v in IDENTITY_FACTS
) + ")"


@query("d06_identity", f"WITH {CFG}, {IDENTITY_CTE} SELECT k, field, value, line_number, raw_line FROM ident")
def d06_identity(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.identity(configs(spark, sf))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"id_{f}").alias("v")) for f in packs.IDENTITY_FIELDS])
    return found.select("k", F.explode(cells).alias("c")).where(F.col("c.v").isNotNull()).select("k", "c.field", "c.v.*")


@query(
    "d07_identity_projection",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE}, {IDENTITY_CTE}, pv AS (SELECT k, max(value) FILTER (field = 'hostname') AS hostname, "
    "max(value) FILTER (field = 'os_version') AS os_version, max(value) FILTER (field = 'model') AS model FROM ident GROUP BY k) "
    "SELECT 'dev-' || q.k AS device_id, CASE WHEN outcome = 'detected' THEN vendor END AS vendor, CASE WHEN outcome = 'detected' THEN os_family END AS os_family, "
    "CASE WHEN outcome = 'detected' THEN hostname END AS hostname, CASE WHEN outcome = 'detected' THEN os_version END AS os_version, "
    "CASE WHEN outcome = 'detected' THEN model END AS model FROM decided q LEFT JOIN pv USING (k)",
)
def d07_identity_projection(spark: SparkSession, sf: str) -> DataFrame:
    detected = ops.detect(configs(spark, sf).drop("vendor", "os_family"))
    named = detected.withColumnRenamed("detected_vendor", "vendor").withColumnRenamed("detected_os", "os_family")
    return ops.identity(named).select(
        "device_id", "vendor", "os_family",
        F.col("id_hostname.value").alias("hostname"), F.col("id_os_version.value").alias("os_version"), F.col("id_model.value").alias("model"),
    )


# Pack versions derived from parts: one platform per brand and type, versions by size.
PACK_CTE = """pack_version AS (SELECT p_brand || '/' || p_type AS pack_id, '1.' || p_size || '.' || (p_partkey % 12) AS version,
  CASE WHEN p_partkey % 9 = 0 THEN 'active' WHEN p_partkey % 9 = 1 THEN 'validated' ELSE 'deprecated' END AS status FROM part),
pin AS (SELECT s_nationkey AS n, 'Brand#' || s_nationkey || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'ECONOMY' ELSE 'STANDARD' END AS pack_id,
  '1.' || (s_suppkey % 50) || '.' || (s_suppkey % 12) AS version FROM supplier WHERE s_acctbal < 0), -- the others are not pinned
pins AS (SELECT pack_id, min(version) AS version FROM pin GROUP BY 1),
pv AS (SELECT DISTINCT * FROM pack_version),
chosen AS (SELECT v.pack_id, v.version FROM pv v LEFT JOIN pins p USING (pack_id)
  WHERE CASE WHEN p.version IS NOT NULL THEN p.version = v.version ELSE v.status = 'active' END)"""


def _pack_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = d.table(spark, sf, "part")
    r = F.col("p_partkey") % 9
    versions = part.select(
        F.concat_ws("/", "p_brand", "p_type").alias("pack_id"),
        F.concat(F.lit("1."), "p_size", F.lit("."), F.col("p_partkey") % 12).alias("version"),
        F.when(r == 0, "active").when(r == 1, "validated").otherwise("deprecated").alias("status"),
    ).distinct()
    kind = F.when(F.col("s_suppkey") % 2 == 0, "ECONOMY").otherwise("STANDARD")
    pins = (
        d.table(spark, sf, "supplier")
        .select(
            F.concat(F.lit("Brand#"), "s_nationkey", F.lit("/"), kind).alias("pack_id"),
            F.concat(F.lit("1."), F.col("s_suppkey") % 50, F.lit("."), F.col("s_suppkey") % 12).alias("version"), (F.col("s_acctbal") < 0).alias("pinned"),
        )
    )
    return versions, pins


@query(
    "d08_active_version",
    f"""WITH {PACK_CTE} SELECT pack_id, version, 'active' AS outcome FROM chosen WHERE pack_id IN (SELECT pack_id FROM chosen GROUP BY 1 HAVING count(DISTINCT version) = 1)
    UNION SELECT pack_id, NULL, 'two_active_versions' FROM chosen GROUP BY 1 HAVING count(DISTINCT version) > 1
    UNION SELECT pack_id, version, 'pinned_version_missing' FROM pins WHERE pack_id NOT IN (SELECT pack_id FROM chosen)""",
)
def d08_active_version(spark: SparkSession, sf: str) -> DataFrame:
    versions, pins = _pack_versions(spark, sf)
    return packstore.active_versions(versions, pins)


@query(
    "d09_semver_order",
    f"""WITH {PACK_CTE} SELECT pack_id, version, row_number() OVER (PARTITION BY pack_id ORDER BY
      [x::INT FOR x IN string_split(version, '.')] DESC, status) AS newest_first FROM pv""",
)
def d09_semver_order(spark: SparkSession, sf: str) -> DataFrame:
    versions, _ = _pack_versions(spark, sf)
    return packstore.newest_first(versions).select("pack_id", "version", "newest_first")


@query(
    "d10_pack_lookup",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE} SELECT k, CASE WHEN outcome = 'detected' THEN vendor || '/' || os_family END AS pack_id FROM decided",
)
def d10_pack_lookup(spark: SparkSession, sf: str) -> DataFrame:
    detected = ops.detect(configs(spark, sf).drop("vendor", "os_family"))
    files = detected.select("k", F.col("detected_vendor").alias("vendor"), F.col("detected_os").alias("os_family"))
    return packstore.find_pack(files).select("k", "pack_id")


@query(
    "d11_syntax_mode",
    "WITH " + d.BASE_CTE + " SELECT k, CASE pr WHEN '4-NOT SPECIFIED' THEN 'set_path' WHEN '5-LOW' THEN 'brace' ELSE 'indent' END AS mode FROM base",
)
def d11_syntax_mode(spark: SparkSession, sf: str) -> DataFrame:
    return configs(spark, sf).select("k", ops.syntax_mode(F.col("os_family")).alias("mode"))


@query(
    "d12_source_limits",
    f"WITH {CFG}, {IDENTITY_CTE}, {packs.SOURCE_LIMITS.cte()}, f AS (SELECT k, unnest(['hostname', 'serial']) AS field FROM base) "
    "SELECT f.k, f.field, i.value, CASE WHEN i.value IS NULL THEN l.note END AS note FROM f LEFT JOIN ident i ON i.k = f.k AND i.field = f.field "
    "LEFT JOIN source_limit l ON l.field = f.field AND l.source_type = 'cli'",
)
def d12_source_limits(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.identity(configs(spark, sf))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"id_{f}.value").alias("value")) for f in ("hostname", "serial")])
    rows = found.select("k", F.lit("cli").alias("source_type"), F.explode(cells).alias("c")).select("k", "source_type", "c.*")
    return ops.source_limits(rows).select("k", "field", "value", F.when(F.col("value").isNull(), F.col("note")).alias("note"))
