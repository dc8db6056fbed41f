"""Queries of parsing, structures and normalisation (P, X and N rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.functions import casts, secrets
from fleetsift.functions import text as tx
from fleetsift.operators import detect, fields as fo, match, normalise, structures as st, tree
from fleetsift.plans.detect import CFG, IDENTITY_CTE, configs, quote
from fleetsift.plans.registry import query
from fleetsift.sources import derived as d
from fleetsift.sources import packs
from fleetsift.sources.literals import Literal

KEYS = ["k", "vendor"]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build_tree(configs(spark, sf), KEYS)


INDENT = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
# Reason why a rendered line is not a node, from the template position and the line's own shape.
REASONED_CTE = """reasoned AS (SELECT *, CASE
  WHEN pr = '1-URGENT' AND tpl IN (25, 26) THEN 'literal block body'
  WHEN pr IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND starts_with(raw_line, '!') THEN 'comment'
  WHEN pr = '5-LOW' AND tpl IN (5, 6) THEN 'block comment'
  WHEN pr = '5-LOW' AND starts_with(raw_line, '##') THEN 'blank line'
  WHEN pr = '5-LOW' AND tpl = 54 THEN 'unmatched closing brace'
  WHEN pr = '5-LOW' AND trim(raw_line) = '}' THEN 'block terminator' END AS reason FROM cfgl)"""


@query(
    "p01_indent_tree",
    f"WITH {CFG}, {REASONED_CTE} SELECT k, line_number, trim(raw_line) AS text, CASE WHEN starts_with(raw_line, ' ') THEN 1 ELSE 0 END AS depth, "
    "CASE WHEN starts_with(raw_line, ' ') THEN last_value(CASE WHEN NOT starts_with(raw_line, ' ') THEN line_number END IGNORE NULLS) OVER w END AS parent_line, "
    "CASE WHEN starts_with(raw_line, ' ') THEN last_value(CASE WHEN NOT starts_with(raw_line, ' ') THEN raw_line END IGNORE NULLS) OVER w ELSE '' END AS block_path "
    f"FROM reasoned WHERE reason IS NULL AND pr IN {INDENT} WINDOW w AS (PARTITION BY k ORDER BY line_number)",
)
def p01_indent_tree(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).where(F.col("syntax_mode") == "indent")
    return tree.build_tree(files, KEYS).where("placed").select(
        "k", "line_number", "text", "depth", "parent_line", F.array_join("block_path", " > ").alias("block_path")
    )


@query(
    "p02_brace_tree",
    f"WITH {CFG}, {REASONED_CTE}, depths AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL AND ends_with(raw_line, '{{') THEN 1 "
    "WHEN reason = 'block terminator' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth "
    "FROM reasoned WHERE pr = '5-LOW') SELECT n.k, n.line_number, rtrim(rtrim(trim(n.raw_line), '{;')) AS text, n.depth, "
    "(SELECT max(o.line_number) FROM depths o WHERE o.k = n.k AND o.line_number < n.line_number AND o.depth = n.depth - 1 AND o.reason IS NULL "
    "AND ends_with(o.raw_line, '{')) AS parent_line FROM depths n WHERE n.reason IS NULL",
)
def p02_brace_tree(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).where(F.col("syntax_mode") == "brace")
    return tree.build_tree(files, KEYS).where("placed").select("k", "line_number", "text", "depth", "parent_line")


@query("p03_flat_tree", f"WITH {CFG} SELECT k, line_number, raw_line AS text FROM cfgl WHERE pr = '4-NOT SPECIFIED'")
def p03_flat_tree(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).where(F.col("syntax_mode") == "set_path")
    return tree.flat_nodes(files, ["k"]).where("placed").select("k", "line_number", "text")


@query(
    "p04_line_reasons",
    f"WITH {CFG}, {REASONED_CTE} SELECT pr, reason, count(*) AS lines FROM reasoned WHERE reason IS NOT NULL GROUP BY ALL",
)
def p04_line_reasons(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).withColumn("pr2", F.col("pr"))
    return tree.build_tree(files, ["k", "pr"]).where(~F.col("placed")).groupBy("pr", "reason").agg(F.count("*").alias("lines"))


@query(
    "p05_literal_blocks",
    f"WITH {CFG} SELECT k, max(line_number) FILTER (tpl = 24) + 1 AS opened_after, max(line_number) - max(line_number) FILTER (tpl = 24) - 1 AS lines_swallowed FROM cfgl "
    "WHERE pr = '1-URGENT' AND k % 3 = 0 GROUP BY k",
)
def p05_literal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All rendered files; in every third the banner's end is gone, so that it swallows the rest and is reported."""
    base = d.device_config(spark, sf)
    text = F.when(F.col("k") % 3 == 0, F.regexp_replace("text", r"(?m)^#$\R", "")).otherwise(F.col("text"))
    files = detect.with_lines(base.withColumn("text", text))
    return tree.tree_errors(tree.build_tree(files, ["k"]), ["k"]).select("k", "opened_after", "lines_swallowed")


@query(
    "p06_totality",
    f"WITH {CFG}, {REASONED_CTE} SELECT k, count(*) AS rows_out, count(DISTINCT line_number) AS distinct_lines, max(line_number) AS last_line, "
    "count(*) FILTER (reason IS NULL) AS nodes, count(*) = max(line_number) AS total FROM reasoned GROUP BY k",
)
def p06_totality(spark: SparkSession, sf: str) -> DataFrame:
    return tree.totality(nodes(spark, sf), ["k"])


@query("p07_lossless", "WITH " + d.CONFIG_CTE + " SELECT k, true AS lossless FROM device_config")
def p07_lossless(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).withColumn("want", tx.line_hash(tx.normalise_terminators(F.col("text"))))
    back = tree.reconstruct(tree.build_tree(files, ["k", "want"]), ["k", "want"])
    return back.select("k", (tx.line_hash(F.col("rebuilt")) == F.col("want")).alias("lossless"))


@query("p08_hierarchy", f"WITH {d.BASE_CTE} SELECT k, 19 AS in_block, 5 AS term_children FROM base WHERE pr = '5-LOW'")
def p08_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes below ``firewall > family inet`` and the direct children of its terms."""
    files = configs(spark, sf).where(F.col("syntax_mode") == "brace")
    inside = tree.build_tree(files, KEYS).where("placed").where(tree.in_block(["firewall", "family inet"]))
    is_term_child = F.element_at("block_path", -1).startswith("term ")
    return inside.groupBy("k").agg(F.count("*").alias("in_block"), F.count_if(is_term_child).alias("term_children"))


# (priority, template line, pattern id, field, value), all SQL over the order's columns.
MATCH_FACTS = [
    ("1-URGENT", 6, "'p-ssh-version-001'", "ssh_version", "(1 + k % 2)::VARCHAR"),
    ("1-URGENT", 31, "CASE WHEN k % 8 = 0 THEN 'p-telnet-enabled-001' ELSE 'p-telnet-enabled-002' END", "telnet_enabled", "(k % 8 = 0)::VARCHAR"),
    ("1-URGENT", 34, "CASE WHEN k % 9 = 0 THEN 'p-telnet-enabled-001' ELSE 'p-telnet-enabled-002' END", "telnet_enabled", "(k % 9 = 0)::VARCHAR"),
    ("1-URGENT", 7, "CASE WHEN k % 3 = 0 THEN 'p-http-server-002' ELSE 'p-http-server-001' END", "http_server_enabled", "(k % 3 = 0)::VARCHAR"),
    ("1-URGENT", 30, "'p-idle-timeout-001'", "idle_timeout_seconds", "((5 + k % 10) * 60 + 30)::VARCHAR"),
    ("1-URGENT", 33, "'p-idle-timeout-001'", "idle_timeout_seconds", "((20 + k % 3) * 60)::VARCHAR"),
    ("1-URGENT", 35, "'p-logging-host-001'", "logging_hosts", "'10.9.' || (k % 256) || '.1'"),
    ("1-URGENT", 36, "'p-logging-host-001'", "logging_hosts", "'10.9.' || (k % 256) || '.2'"),
    ("1-URGENT", 37, "'p-ntp-server-001'", "ntp_servers", "'10.8.' || (k % 256) || '.1'"),
    ("1-URGENT", 24, "'p-banner-present-001'", "banner_present", "'true'"),
    ("2-HIGH", 3, "CASE WHEN k % 8 = 0 THEN 'p-nxos-telnet-002' ELSE 'p-nxos-telnet-001' END", "telnet_enabled", "(k % 8 = 0)::VARCHAR"),
    ("2-HIGH", 4, "'p-nxos-http-001'", "http_server_enabled", "'false'"),
    ("2-HIGH", 21, "'p-nxos-idle-timeout-001'", "idle_timeout_seconds", "((k % 30) * 60)::VARCHAR"),
    ("2-HIGH", 22, "'p-nxos-logging-host-001'", "logging_hosts", "'198.51.100.' || (k % 200)"),
    ("2-HIGH", 23, "'p-nxos-ntp-001'", "ntp_servers", "'192.0.2.' || (k % 200)"),
    ("2-HIGH", 24, "'p-nxos-banner-001'", "banner_present", "'true'"),
    ("2-HIGH", 25, "'p-nxos-aaa-001'", "aaa_enabled", "'true'"),
]
FACTS_CTE = "facts AS (" + " UNION ALL ".join(
    f"SELECT k, line_number, {p} AS pattern_id, {quote(f)} AS field, {v} AS value FROM cfgl WHERE pr = {quote(pr)} AND tpl = {t}"
    for pr, t, p, f, v in MATCH_FACTS
) + ")"
_BY_OS = {"ios": "1-URGENT", "nxos": "2-HIGH"}
DECLARED = Literal(
    "declared", "pr string, field string, kind string",
    sorted({(_BY_OS[p[1]], p[3], "list" if p[7] == "list" else "scalar") for p in packs.PATTERNS}),
)
FIELDS_CTE = f"""{DECLARED.cte()}, grouped AS (SELECT k, field, count(DISTINCT value) AS nd, bool_or(value = 'true') AS any_true,
    string_agg(value, ',' ORDER BY line_number) AS vs, min(value) AS v1, min(line_number) AS first_line,
    string_agg(line_number, ',' ORDER BY line_number) AS lines FROM facts GROUP BY ALL),
  fieldobs AS (SELECT b.k, b.pr, d.field, g.first_line, coalesce(g.lines, '') AS lines,
    CASE WHEN g.k IS NULL THEN 'unknown' WHEN d.kind = 'list' OR nd = 1 OR (d.field = 'telnet_enabled' AND any_true) THEN 'present' ELSE 'unknown' END AS state,
    CASE WHEN g.k IS NULL THEN 'no_match' WHEN d.kind = 'list' OR nd = 1 OR (d.field = 'telnet_enabled' AND any_true) THEN NULL ELSE 'conflicting_evidence' END AS unknown_reason,
    CASE WHEN d.kind = 'list' THEN vs WHEN nd = 1 THEN v1 WHEN d.field = 'telnet_enabled' AND any_true THEN 'true' END AS value
    FROM base b JOIN declared d ON d.pr = b.pr LEFT JOIN grouped g ON g.k = b.k AND g.field = d.field)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    return match.matches(nodes(spark, sf), KEYS)


def parsed_fields(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf)
    declared = fo.declared_fields(d.device_config(spark, sf), KEYS + ["os_family"])
    hits = match.matches(tree.build_tree(files, KEYS), KEYS + ["os_family"])
    return fo.assemble(declared, hits, KEYS + ["os_family"])


@query("p09_scoped_match", f"WITH {CFG}, {FACTS_CTE} SELECT k, line_number, pattern_id, field FROM facts")
def p09_scoped_match(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("k", "line_number", "pattern_id", "field")


@query("p10_capture", f"WITH {CFG}, {FACTS_CTE} SELECT k, line_number, field, value FROM facts")
def p10_capture(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce(F.col("v_bool").cast("string"), F.col("v_long").cast("string"), F.col("v_str"))
    return found(spark, sf).select("k", "line_number", "field", value.alias("value"))


@query(
    "p11_cast_int",
    "SELECT event_id, CASE WHEN regexp_full_match(v, '\\s*[+-]?\\d+\\s*') THEN trim(v)::BIGINT END AS value FROM "
    "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN '-' || user_id WHEN 2 THEN event_type ELSE user_id || '.5' END AS v FROM events)",
)
def p11_cast_int(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 4
    raw = (
        F.when(r == 0, F.concat(F.lit(" "), "user_id", F.lit(" ")))
        .when(r == 1, F.concat(F.lit("-"), "user_id")).when(r == 2, F.col("event_type")).otherwise(F.concat("user_id", F.lit(".5")))
    )
    return d.table(spark, sf, "events").select("event_id", casts.cast_int(raw).alias("value"))


_TOKEN_WORDS = ("true", "FALSE", " Yes ", "no", "ON", "off", "enable", "Disabled", "1", "0", "maybe", "")


@query(
    "p12_cast_bool",
    "SELECT event_id, CASE WHEN lower(trim(v)) IN ('true','yes','on','enable','enabled','1') THEN true WHEN lower(trim(v)) IN "
    "('false','no','off','disable','disabled','0') THEN false END AS value FROM (SELECT event_id, ["
    + ", ".join(quote(w) for w in _TOKEN_WORDS) + "][(event_id % 12 + 1)::INT] AS v FROM events)",
)
def p12_cast_bool(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _TOKEN_WORDS])
    raw = F.element_at(words, (F.col("event_id") % 12 + 1).cast("int"))
    return d.table(spark, sf, "events").select("event_id", casts.cast_bool(raw).alias("value"))


@query("p13_cast_str", f"WITH {d.DOC_LINES_CTE} SELECT doc_id, line_number, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS value FROM cfg_line")
def p13_cast_str(spark: SparkSession, sf: str) -> DataFrame:
    return d.doc_lines(spark, sf).select("doc_id", "line_number", casts.cast_str(F.col("text")).alias("value"))


@query(
    "p14_cast_cidr",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 256)::BIGINT AS a, (l_suppkey % 256)::BIGINT AS b,
      (l_linenumber * 37 % 256)::BIGINT AS c, (l_partkey % 36)::INT AS len FROM lineitem),
    n AS (SELECT *, CASE WHEN len <= 32 THEN (10::BIGINT * 16777216 + a * 65536 + b * 256 + c) // (2::BIGINT ** (32 - len))::BIGINT * (2::BIGINT ** (32 - len))::BIGINT END AS lo FROM r)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN lo IS NOT NULL THEN (lo // 16777216) || '.' || (lo // 65536 % 256) || '.' || (lo // 256 % 256)
      || '.' || (lo % 256) || '/' || len END AS cidr FROM n""",
)
def p14_cast_cidr(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(
        F.lit("10."), F.col("l_partkey") % 256, F.lit("."), F.col("l_suppkey") % 256, F.lit("."), F.col("l_linenumber") * 37 % 256,
        F.lit("/"), F.col("l_partkey") % 36,
    )
    return d.spread(d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey").select(
        "*", casts.cast_cidr(raw).alias("cidr")
    )


@query(
    "p15_cast_duration",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id * 60 + event_id % 60 END AS seconds FROM events",
)
def p15_cast_duration(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 4
    raw = (
        F.when(r == 0, F.col("user_id").cast("string"))
        .when(r == 1, F.concat("user_id", F.lit("  "), F.col("event_id") % 60))
        .when(r == 2, F.concat("user_id", F.lit(" 1 2")))
        .otherwise(F.concat(F.lit("-1"), "user_id", F.lit(" 0")))
    )
    return d.table(spark, sf, "events").select("event_id", casts.cast_duration(raw).alias("seconds"))


@query(
    "p16_cast_duration_minutes",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id * 60 END AS seconds FROM events",
)
def p16_cast_duration_minutes(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 3
    raw = F.when(r == 0, F.col("user_id").cast("string")).when(r == 1, F.concat("user_id", F.lit(" 30"))).otherwise(F.concat(F.lit("-1"), "user_id"))
    return d.table(spark, sf, "events").select("event_id", casts.cast_duration_minutes(raw).alias("seconds"))


@query(
    "p17_cast_failure",
    "SELECT event_id, (string_split(v, ' ')[2])::BIGINT AS value FROM (SELECT event_id, event_type || ' ' || CASE WHEN value < 20 THEN 'n/a' ELSE user_id::VARCHAR END AS v FROM events) "
    "WHERE regexp_full_match(string_split(v, ' ')[2], '[+-]?\\d+')",
)
def p17_cast_failure(spark: SparkSession, sf: str) -> DataFrame:
    """A capture that is not a number never becomes a fact."""
    text = F.concat("event_type", F.lit(" "), F.when(F.col("value") < 20, "n/a").otherwise(F.col("user_id").cast("string")))
    raw = F.regexp_extract(text, r"^\S+ (\S+)$", 1)
    rows = d.table(spark, sf, "events").select("event_id", casts.cast_int(raw).alias("value"))
    return rows.where(F.col("value").isNotNull())


@query(
    "p18_field_assembly",
    f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE} SELECT k, field, state, unknown_reason, value, lines FROM fieldobs",
)
def p18_field_assembly(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.transform("evidence", lambda e: e["line"])), lambda n: n.cast("string")), ",")
    return parsed_fields(spark, sf).select("k", "field", "state", "unknown_reason", fo.value_text().alias("value"), lines.alias("lines"))


@query(
    "p19_merge_policy",
    """WITH r AS (SELECT o_custkey AS dev, o_orderkey AS n, o_orderstatus = 'F' AS v FROM orders),
    g AS (SELECT dev, f AS field, bool_or(v) AS hi, bool_and(v) AS lo FROM r, (VALUES ('telnet_enabled'), ('snmp_v3_only'), ('aaa_enabled')) t(f) GROUP BY ALL)
    SELECT dev, field, CASE WHEN hi = lo THEN hi WHEN field = 'telnet_enabled' THEN true WHEN field = 'snmp_v3_only' THEN false END AS value,
    CASE WHEN hi = lo OR field <> 'aaa_enabled' THEN 'present' ELSE 'unknown' END AS state FROM g""",
)
def p19_merge_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Worst case true, worst case false and undecided, over every order of a customer."""
    names = ("telnet_enabled", "snmp_v3_only", "aaa_enabled")
    rows = d.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dev"), (F.col("o_orderstatus") == "F").alias("v"), F.explode(F.array(*[F.lit(n) for n in names])).alias("field")
    )
    return fo.merge_flags(rows, ["dev", "field"], {"telnet_enabled": "worst_case_true", "snmp_v3_only": "worst_case_false"})


@query(
    "p20_source_attribution",
    """SELECT o_custkey AS dev, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN 'admin_confirmed' ELSE 'deterministic' END, o_orderkey) AS method,
    min(o_orderkey) AS first_pattern FROM orders GROUP BY 1""",
)
def p20_source_attribution(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("o_orderkey") % 3 == 0, "admin_trained").otherwise("builtin")
    rows = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("dev"), F.col("o_orderkey").alias("pattern_ord"), source.alias("source"))
    return fo.attribute_source(rows, ["dev"]).select("dev", "method", F.col("pattern_ord").alias("first_pattern"))


_BRACE_TEXTS = [text.strip("' {") for _, text in d.JUNOS_BRACE]
_FILTER_AT = _BRACE_TEXTS.index("filter PROTECT")
_FILTER_END = len(d.JUNOS_BRACE) - 4  # its closing brace; those of its two parents and a stray one follow
_RESIDUE = f"""read_lines AS (SELECT DISTINCT k, line_number FROM facts),
  residue AS (SELECT l.k, l.line_number, CASE WHEN pr = '5-LOW' THEN rtrim(rtrim(trim(l.raw_line), '{{;')) ELSE trim(l.raw_line) END AS text FROM reasoned l ANTI JOIN read_lines f ON f.k = l.k AND f.line_number = l.line_number
   WHERE reason IS NULL
   AND NOT (pr = '1-URGENT' AND (tpl BETWEEN 8 AND 15 OR (tpl BETWEEN 16 AND 23 AND k % 13 <> 0)))
   AND NOT (pr = '2-HIGH' AND (tpl BETWEEN 11 AND 19 OR tpl BETWEEN 6 AND 10))
   AND NOT (pr = '4-NOT SPECIFIED' AND k % 13 <> 0 AND (starts_with(raw_line, 'set firewall family inet filter PROTECT ') OR (starts_with(raw_line, 'set policy-options prefix-list MGMT '))))
   AND NOT (pr = '5-LOW' AND k % 13 <> 0 AND tpl BETWEEN {_FILTER_AT} AND {_FILTER_END}))"""


FILE = ["k", "vendor", "os_family"]


def model(spark: SparkSession, sf: str, patterns: Sequence[tuple] = (), **only: str) -> DataFrame:
    """Models of the files, of those of one platform or syntax alone if asked; others are left out before their trees are built."""
    files = configs(spark, sf)
    for column, value in only.items():
        files = files.where(F.col(column) == value)
    return st.file_model(files, FILE, patterns)


def residue_lines(spark: SparkSession, sf: str) -> DataFrame:
    return st.residue(model(spark, sf, packs.PATTERNS), FILE)


@query("p21_residue", f"WITH {CFG}, {REASONED_CTE}, {FACTS_CTE}, {_RESIDUE} SELECT k, line_number, text FROM residue")
def p21_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue_lines(spark, sf).select("k", "line_number", "text")


@query(
    "p22_coverage",
    f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE} SELECT k, count(*) AS declared, count(*) FILTER (state <> 'unknown') AS determinable, "
    "count(*) FILTER (state <> 'unknown')::DOUBLE / count(*) AS coverage FROM fieldobs GROUP BY k",
)
def p22_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return fo.coverage(parsed_fields(spark, sf), ["k"])


# ---- structures -----------------------------------------------------------------------

IFACE_CTE = """ifaces AS (
  SELECT k, 'GigabitEthernet0/0' AS name, 'uplink ' || c AS description, '10.' || (c % 200) || '.' || (k % 250) || '.1' AS addresses,
    true AS enabled, CASE WHEN k % 2 = 0 THEN 'EDGE-IN:in' ELSE '' END AS applied, pr FROM base WHERE pr = '1-URGENT'
  UNION ALL SELECT k, 'Vlan' || (1 + k % 90), NULL, CASE WHEN k % 4 <> 0 THEN '192.168.' || (k % 256) || '.1' ELSE '' END,
    CASE WHEN k % 3 = 1 THEN false END, '', pr FROM base WHERE pr = '1-URGENT'
  UNION ALL SELECT k, 'mgmt0', 'oob ' || c, '10.1.' || (k % 250) || '.2/24', true, 'MGMT-IN:in', pr FROM base WHERE pr = '2-HIGH'
  UNION ALL SELECT k, 'Ethernet1/' || (1 + k % 48), 'to spine ' || (c % 8), CASE WHEN k % 4 <> 0 THEN '10.10.' || (k % 250) || '.1/30' ELSE '' END,
    CASE WHEN k % 5 = 0 THEN false END, '', pr FROM base WHERE pr = '2-HIGH')"""


def ifaces(spark: SparkSession, sf: str) -> DataFrame:
    return st.interfaces(model(spark, sf), FILE)


@query("x01_interfaces", f"WITH {d.BASE_CTE}, {IFACE_CTE} SELECT k, name, description, addresses, enabled, applied FROM ifaces")
def x01_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    applied = F.array_join(F.transform("applied", lambda a: F.concat_ws(":", a["acl"], a["direction"])), ",")
    return ifaces(spark, sf).select("k", "name", "description", F.array_join("addresses", ",").alias("addresses"), "enabled", applied.alias("applied"))


# Entries of the rendered lists, stated directly: seq, action, protocol, source, destination, ports, flags.
_E = "k, '{n}' AS acl_name, {seq} AS seq, '{a}' AS action, '{p}' AS protocol, {s} AS src, {sp} AS src_port, {t} AS dst, {tp} AS dst_port, {e} AS established, {l} AS log"


def _entry(pr: str, name: str, seq: str, action: str, proto: str, src: str, dst: str, dport: str = "'0-65535'", est: str = "false", log: str = "false", cond: str = "true") -> str:
    cols = _E.format(n=name, seq=seq, a=action, p=proto, s=src, sp="'0-65535'", t=dst, tp=dport, e=est, l=log)
    return f"SELECT {cols} FROM base WHERE pr = '{pr}' AND {cond}"


IOS_ENTRIES = " UNION ALL ".join([
    _entry("1-URGENT", "EDGE-IN", "1", "permit", "tcp", "'10.' || (k % 200) || '.0.0/16'", "'any'", "'443-443'", cond="k % 13 <> 0"),
    _entry("1-URGENT", "EDGE-IN", "2", "deny", "udp", "'any'", "'192.0.2.' || (k % 250) || '/32'", "'161-161'", cond="k % 13 <> 0"),
    _entry("1-URGENT", "EDGE-IN", "3", "permit", "tcp", "'any'", "'any'", est="true", cond="k % 13 <> 0"),
    _entry("1-URGENT", "EDGE-IN", "4", "permit", "tcp", "'10.' || (k % 200) || '.' || (c % 200) || '.0/24'", "'any'", "'443-443'", log="true", cond="k % 13 <> 0"),
    _entry("1-URGENT", "EDGE-IN", "5", "permit", "ip", "'object SRV'", "'any'", cond="k % 13 <> 0 AND k % 11 = 0"),
    _entry("1-URGENT", "EDGE-IN", "CASE WHEN k % 11 = 0 THEN 6 ELSE 5 END", "deny", "ip", "'any'", "'any'", log="true", cond="k % 13 <> 0"),
])
NXOS_ENTRIES = " UNION ALL ".join([
    _entry("2-HIGH", "MGMT-IN", "1", "permit", "tcp", "'198.51.100.0/24'", "'any'", "'22-22'"),
    _entry("2-HIGH", "MGMT-IN", "2", "permit", "tcp", "'198.51.100.' || (k % 250) || '/32'", "'any'", "'22-22'"),
    _entry("2-HIGH", "MGMT-IN", "3", "permit", "udp", "'object MON'", "'any'", cond="k % 7 = 0"),
    _entry("2-HIGH", "MGMT-IN", "CASE WHEN k % 7 = 0 THEN 4 ELSE 3 END", "deny", "ip", "'any'", "'any'", log="true"),
])


def _junos_entries(pr: str) -> str:
    return " UNION ALL ".join([
        _entry(pr, "PROTECT", "1", "permit", "tcp", "'198.51.100.0/24 192.0.2.' || (k % 250) || '/32'", "'any'", "'22-22'", cond="k % 13 <> 0"),
        _entry(pr, "PROTECT", "2", "permit", "tcp", "'198.51.100.0/24 192.0.2.' || (k % 250) || '/32'", "'any'", "'443-443'", cond="k % 13 <> 0"),
        _entry(pr, "PROTECT", "3", "permit", "udp", "'10.' || (k % 200) || '.0.0/16'", "'any'", "'161-161'", log="true", cond="k % 13 <> 0"),
        _entry(pr, "PROTECT", "4", "deny", "any", "'any'", "'any'", cond="k % 13 <> 0"),
    ])


def _entry_view(entries: DataFrame) -> DataFrame:
    def addr(c: str):
        return F.when(F.col(f"{c}.kind") == "any", "any").when(
            F.size(f"{c}.cidrs") == 0, F.concat(F.lit("object "), F.col(f"{c}.value"))
        ).otherwise(F.array_join(f"{c}.cidrs", " "))

    port = lambda c: F.concat_ws("-", F.col(f"{c}.lo").cast("string"), F.col(f"{c}.hi").cast("string"))
    return entries.select(
        "k", "acl_name", "seq", "action", "protocol", addr("src").alias("src"), port("src_port").alias("src_port"),
        addr("dst").alias("dst"), port("dst_port").alias("dst_port"), "established", "log",
    )


def entries(spark: SparkSession, sf: str, **only: str) -> DataFrame:
    return _entry_view(st.list_entries(st.access_lists(model(spark, sf, **only), FILE), ["k"]))


@query("x02_ios_entries", f"WITH {d.BASE_CTE} {IOS_ENTRIES}")
def x02_ios_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf, os_family="ios")


@query(
    "x03_wildcard_cidr",
    """WITH w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, [0, 255, 65535, 3, 254, 65280, 4294967295][l_linenumber] AS wild,
      10 * 16777216::BIGINT + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_linenumber AS addr FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN wild & (wild + 1) = 0 THEN ((addr - addr % (wild + 1)) // 16777216) || '.' ||
      ((addr - addr % (wild + 1)) // 65536 % 256) || '.' || ((addr - addr % (wild + 1)) // 256 % 256) || '.' || ((addr - addr % (wild + 1)) % 256)
      || '/' || (32 - bit_count(wild)) END AS cidr FROM w""",
)
def x03_wildcard_cidr(spark: SparkSession, sf: str) -> DataFrame:
    masks = ("0.0.0.0", "0.0.0.255", "0.0.255.255", "0.0.0.3", "0.0.0.254", "0.0.255.0", "255.255.255.255")
    wild = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("l_linenumber"))
    addr = F.concat(F.lit("10."), F.col("l_partkey") % 256, F.lit("."), F.col("l_suppkey") % 256, F.lit("."), F.col("l_linenumber"))
    rows = d.spread(d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey")
    return rows.select("*", st.wildcard_to_cidr(addr, wild).alias("cidr"))


@query("x04_nxos_entries", f"WITH {d.BASE_CTE} {NXOS_ENTRIES}")
def x04_nxos_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf, os_family="nxos")


@query("x05_junos_set_filters", f"WITH {d.BASE_CTE} {_junos_entries('4-NOT SPECIFIED')}")
def x05_junos_set_filters(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf, syntax_mode="set_path")


@query("x06_junos_brace_filters", f"WITH {d.BASE_CTE} {_junos_entries('5-LOW')}")
def x06_junos_brace_filters(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf, syntax_mode="brace")


@query(
    "x07_prefix_lists",
    f"WITH {d.BASE_CTE} SELECT k, 'MGMT' AS name, '198.51.100.0/24 192.0.2.' || (k % 250) || '/32' AS members FROM base WHERE pr IN ('4-NOT SPECIFIED', '5-LOW')",
)
def x07_prefix_lists(spark: SparkSession, sf: str) -> DataFrame:
    return st.prefix_lists(model(spark, sf), FILE).select("k", "name", F.array_join("members", " ").alias("members"))


_PORT_OPS = ("eq", "lt", "gt", "neq", "range", "eq", "any")


@query(
    "x08_port_parse",
    """WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['eq','lt','gt','neq','range','name','any'][l_linenumber] AS op,
      CASE WHEN l_partkey % 50 = 0 THEN 0 WHEN l_partkey % 50 = 1 THEN 65535 WHEN l_partkey % 50 = 2 THEN 70000 ELSE l_partkey * 7 % 65536 END AS v FROM lineitem),
    n AS (SELECT *, CASE WHEN op = 'name' THEN CASE l_suppkey % 3 WHEN 0 THEN 443 WHEN 1 THEN 161 END WHEN v <= 65535 THEN v END AS n FROM p)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CASE op WHEN 'any' THEN '0-65535' WHEN 'lt' THEN '0-' || greatest(0, n - 1) WHEN 'gt' THEN least(65535, n + 1) || '-65535'
        WHEN 'range' THEN CASE WHEN n <= least(n + 10, 65535) THEN n || '-' || least(n + 10, 65535) END ELSE n || '-' || n END AS port FROM n""",
)
def x08_port_parse(spark: SparkSession, sf: str) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(o) for o in _PORT_OPS]), F.col("l_linenumber"))
    r = F.col("l_partkey") % 50
    number = F.when(r == 0, 0).when(r == 1, 65535).when(r == 2, 70000).otherwise(F.col("l_partkey") * 7 % 65536).cast("string")
    name = F.when(F.col("l_suppkey") % 3 == 0, "HTTPS").when(F.col("l_suppkey") % 3 == 1, "snmp").otherwise("weird")
    token = F.when(F.col("l_linenumber") == 6, name).otherwise(number)
    low = st.port_number(token)
    got = st.port_interval(op, low, F.least(low + 10, F.lit(65535)))
    rows = d.spread(d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey")
    return rows.select("*", F.when(got.isNotNull(), F.concat_ws("-", got["lo"].cast("string"), got["hi"].cast("string"))).alias("port"))


@query(
    "x09_multi_port",
    f"WITH {d.BASE_CTE} SELECT k, count(*) AS entries, string_agg(dst_port, ',' ORDER BY seq) AS ports FROM ({_junos_entries('4-NOT SPECIFIED')} UNION ALL {_junos_entries('5-LOW')}) GROUP BY k",
)
def x09_multi_port(spark: SparkSession, sf: str) -> DataFrame:
    both = entries(spark, sf, vendor="juniper")
    ports = F.transform(F.array_sort(F.collect_list(F.struct("seq", "dst_port"))), lambda x: x["dst_port"])
    return both.groupBy("k").agg(F.count("*").alias("entries"), F.array_join(ports, ",").alias("ports"))


@query(
    "x10_all_or_nothing",
    f"WITH {CFG} SELECT k, 'EDGE-IN' AS acl_name, line_number AS entry_line, trim(raw_line) AS entry_text, 'unknown_port' AS reason FROM cfgl "
    "WHERE pr = '1-URGENT' AND tpl = 19 AND k % 13 = 0 UNION ALL SELECT k, 'PROTECT', line_number, 'term mon', 'unread_clause' FROM cfgl "
    "WHERE ((pr = '4-NOT SPECIFIED' AND tpl = 12) OR (pr = '5-LOW' AND tpl = 41)) AND k % 13 = 0",
)
def x10_all_or_nothing(spark: SparkSession, sf: str) -> DataFrame:
    return st.list_failures(st.access_lists(model(spark, sf), FILE), ["k"])


@query(
    "x11_bindings",
    f"WITH {d.BASE_CTE} SELECT k, 'EDGE-IN' AS acl_name, CASE WHEN k % 2 = 0 THEN 'GigabitEthernet0/0:in' ELSE '' END AS applied_to FROM base WHERE pr = '1-URGENT' AND k % 13 <> 0 "
    "UNION ALL SELECT k, 'MGMT-IN', 'mgmt0:in' FROM base WHERE pr = '2-HIGH'",
)
def x11_bindings(spark: SparkSession, sf: str) -> DataFrame:
    bound = st.bindings(model(spark, sf, vendor="cisco"), FILE)  # the platforms whose interfaces name lists
    text = F.array_join(F.transform("applied_to", lambda b: F.concat_ws(":", b["interface"], b["direction"])), ",")
    return bound.select("k", "acl_name", F.coalesce(text, F.lit("")).alias("applied_to"))


# ---- normalisation --------------------------------------------------------------------

CAPABILITIES = Literal(
    "capability", "vendor string, os_family string, field string, supported boolean, provenance string, ref string",
    [
        ("cisco", "ios", "ssh_version", True, "sourced", "ios guide ch.1"), ("cisco", "ios", "https_server_enabled", True, "sourced", "ios guide ch.2"),
        ("cisco", "ios", "ntp_servers", True, "sourced", "ios guide ch.3"), ("cisco", "nxos", "http_server_enabled", False, "sourced", "nxos guide ch.1"),
        ("cisco", "nxos", "aaa_enabled", False, "unsourced", "forum post"),
    ],
)
DEFAULTS = Literal(
    "platform_default", "vendor string, os_family string, field string, value string, provenance string, ref string",
    [
        ("cisco", "ios", "https_server_enabled", "false", "sourced", "ios defaults p.9"), ("cisco", "ios", "ntp_servers", "none", "unsourced", "memory"),
        ("cisco", "ios", "ssh_version", "1", "sourced", "ios defaults p.4"),
    ],
)
RESOLVED_CTE = f"""{CAPABILITIES.cte()}, {DEFAULTS.cte()}, resolved AS (SELECT f.k, f.field, f.pr, f.lines,
   CASE WHEN NOT open THEN f.state WHEN c.supported AND p.provenance = 'sourced' THEN 'absent_default'
        WHEN NOT c.supported AND c.provenance = 'sourced' THEN 'absent_unsupported' ELSE 'unknown' END AS state,
   CASE WHEN NOT open THEN f.unknown_reason WHEN c.supported IS NULL OR (NOT c.supported AND c.provenance <> 'sourced') THEN 'capability_unknown'
        WHEN c.supported AND (p.provenance IS NULL OR p.provenance <> 'sourced') THEN 'no_match' END AS unknown_reason,
   CASE WHEN NOT open THEN f.value WHEN c.supported AND p.provenance = 'sourced' THEN p.value END AS value,
   CASE WHEN open AND c.supported AND p.provenance = 'sourced' THEN p.ref WHEN open AND NOT c.supported AND c.provenance = 'sourced' THEN c.ref END AS default_ref
  FROM (SELECT *, state = 'unknown' AND unknown_reason = 'no_match' AS open, CASE pr WHEN '1-URGENT' THEN 'ios' ELSE 'nxos' END AS os FROM fieldobs) f
  LEFT JOIN capability c ON c.os_family = f.os AND c.field = f.field LEFT JOIN platform_default p ON p.os_family = f.os AND p.field = f.field)"""


def resolved_fields(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.resolve_absence(parsed_fields(spark, sf), CAPABILITIES.frame(spark), DEFAULTS.frame(spark))


@query("n01_absence", f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE}, {RESOLVED_CTE} SELECT k, field, state, unknown_reason, value, default_ref FROM resolved")
def n01_absence(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_fields(spark, sf).select("k", "field", "state", "unknown_reason", fo.value_text().alias("value"), "default_ref")


@query(
    "n02_admissibility",
    f"WITH {d.BASE_CTE}, {CAPABILITIES.cte()} SELECT b.k, c.field, c.ref FROM base b JOIN capability c ON c.provenance = 'sourced' AND "
    "c.os_family = CASE b.pr WHEN '1-URGENT' THEN 'ios' WHEN '2-HIGH' THEN 'nxos' END",
)
def n02_admissibility(spark: SparkSession, sf: str) -> DataFrame:
    facts = normalise.admissible(CAPABILITIES.frame(spark))
    return d.device_config(spark, sf).select("k", "vendor", "os_family").join(facts, ["vendor", "os_family"]).select("k", "field", "ref")


_OBS_CTE = """obs AS (SELECT o_custkey AS dev, 'f' || (o_orderkey % 3) AS field, CASE WHEN o_custkey % 17 = 0 THEN o_orderstatus ELSE 'O' END AS value,
  CASE WHEN o_custkey % 19 = 0 AND o_orderkey % 2 = 0 THEN 'absent_default' ELSE 'present' END AS state FROM orders),
  og AS (SELECT dev, field, min(value || '/' || state) AS lo, max(value || '/' || state) AS hi, count(*) AS sources FROM obs GROUP BY ALL)"""


def _source_obs(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dev"), F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("field"),
        F.when(F.col("o_custkey") % 17 == 0, F.col("o_orderstatus")).otherwise("O").alias("value"),
        F.when((F.col("o_custkey") % 19 == 0) & (F.col("o_orderkey") % 2 == 0), "absent_default").otherwise("present").alias("state"),
    )


@query("n03_merge_sources", f"WITH {_OBS_CTE} SELECT dev, field, split_part(lo, '/', 1) AS value, split_part(lo, '/', 2) AS state, sources FROM og WHERE lo = hi")
def n03_merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.merge_sources(_source_obs(spark, sf), ["dev", "field"])[0]


@query(
    "n03_source_conflicts",
    f"WITH {_OBS_CTE} SELECT dev, field, split_part(lo, '/', 1) AS value_a, split_part(lo, '/', 2) AS state_a, split_part(hi, '/', 1) AS value_b, split_part(hi, '/', 2) AS state_b FROM og WHERE lo <> hi",
)
def n03_source_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.merge_sources(_source_obs(spark, sf), ["dev", "field"])[1]


ROLES = [
    ("cisco", "nxos", r"mgmt\d+", True, "sourced", "nxos guide ch.7"), ("cisco", "ios", r"Vlan\d+", False, "unsourced", "guess"),
    ("cisco", "ios", r"GigabitEthernet0/0$", True, "sourced", "ios guide ch.7"), ("cisco", "nxos", r"Ethernet\d", False, "sourced", "nxos guide ch.8"),
]
CLASSIFIED_CTE = """classified AS (SELECT *, CASE WHEN name = 'mgmt0' THEN true WHEN pr = '1-URGENT' AND name = 'GigabitEthernet0/0' THEN true
  WHEN pr = '2-HIGH' THEN false END AS is_management, CASE WHEN name = 'mgmt0' THEN 'nxos guide ch.7' WHEN pr = '1-URGENT' AND name = 'GigabitEthernet0/0'
  THEN 'ios guide ch.7' WHEN pr = '2-HIGH' THEN 'nxos guide ch.8' END AS management_ref FROM ifaces)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.classify_interfaces(ifaces(spark, sf), ROLES)


@query("n04_interface_roles", f"WITH {d.BASE_CTE}, {IFACE_CTE}, {CLASSIFIED_CTE} SELECT k, name, is_management, management_ref FROM classified")
def n04_interface_roles(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("k", "name", "is_management", "management_ref")


_CLAIMS_CTE = """claims AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['deterministic','uncalibrated_similarity','calibrated_similarity','platform_default',
   'platform_default','calibrated_similarity','admin_confirmed'][l_linenumber] AS method, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_returnflag = 'A' AND l_linenumber > 3
   THEN 'absent_default' ELSE 'present' END AS state, l_quantity / 50 AS confidence, l_shipdate::VARCHAR AS value FROM lineitem),
   why AS (SELECT *, CASE WHEN method = 'uncalibrated_similarity' AND state <> 'unknown' THEN 'uncalibrated_confidence'
     WHEN method = 'calibrated_similarity' AND state = 'present' AND confidence < 0.85 THEN 'low_confidence'
     WHEN method = 'platform_default' AND state IN ('present', 'absent_default') AND confidence < 0.9 THEN 'low_confidence' END AS why FROM claims)"""


@query(
    "n05_abstention",
    f"WITH {_CLAIMS_CTE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN why IS NULL THEN state ELSE 'unknown' END AS state, "
    "CASE WHEN state = 'unknown' THEN 'no_match' ELSE why END AS unknown_reason, CASE WHEN why IS NULL AND state <> 'unknown' THEN confidence END AS value FROM why",
)
def n05_abstention(spark: SparkSession, sf: str) -> DataFrame:
    methods = ("deterministic", "uncalibrated_similarity", "calibrated_similarity", "platform_default", "platform_default", "calibrated_similarity", "admin_confirmed")
    li = d.table(spark, sf, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "unknown").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 3), "absent_default").otherwise("present")
    conf = F.col("l_quantity") / 50
    claims = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.element_at(F.array(*[F.lit(m) for m in methods]), F.col("l_linenumber")).alias("method"),
        state.alias("state"), conf.alias("confidence"), F.when(state != "unknown", conf).alias("value"), F.when(state == "unknown", "no_match").alias("unknown_reason"),
    )
    return normalise.coerce_abstention(claims).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "state", "unknown_reason", "value")


@query(
    "n06_unknown_lines",
    f"WITH {CFG}, {REASONED_CTE}, {FACTS_CTE}, {_RESIDUE} SELECT k, line_number, CASE WHEN text = 'enable secret 5 abc' || k THEN 'enable secret 5 <redacted>' "
    "WHEN text = 'snmp-server community public RO' THEN 'snmp-server community <redacted> RO' ELSE text END AS text_scrubbed FROM residue",
)
def n06_unknown_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalise.unknown_lines(residue_lines(spark, sf), secrets.scrub_for_inference(F.col("text")))
    return rows.select("k", "line_number", "text_scrubbed")


@query(
    "n07_device_document",
    f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE}, {REASONED_CTE}, {_RESIDUE}, {IFACE_CTE}, "
    "fa AS (SELECT k, string_agg(field || '=' || state || ':' || coalesce(value, ''), ';' ORDER BY field) AS fields FROM fieldobs GROUP BY k), "
    "ia AS (SELECT k, string_agg(name, ',' ORDER BY name) AS interfaces FROM ifaces GROUP BY k), ra AS (SELECT k, count(*) AS residue_lines FROM residue GROUP BY k) "
    "SELECT 'dev-' || b.k AS device_id, fa.fields, ia.interfaces, CASE WHEN b.pr = '1-URGENT' AND b.k % 13 <> 0 THEN 'EDGE-IN' WHEN b.pr = '2-HIGH' THEN 'MGMT-IN' WHEN b.pr = '1-URGENT' THEN '' END AS acls, "
    "CASE WHEN b.pr = '1-URGENT' AND b.k % 13 = 0 THEN 'EDGE-IN' WHEN b.pr IN ('1-URGENT', '2-HIGH') THEN '' END AS acl_failures, ra.residue_lines FROM base b LEFT JOIN fa USING (k) LEFT JOIN ia USING (k) LEFT JOIN ra USING (k)",
)
def n07_device_document(spark: SparkSession, sf: str) -> DataFrame:
    doc = normalise.device_document(st.file_model(configs(spark, sf), ["device_id", "vendor", "os_family"], packs.PATTERNS))
    pairs = F.transform(
        F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["state"], F.lit(":"), F.coalesce(e["value"]["value"], F.lit("")))
    )
    return doc.select(
        "device_id", F.array_join(pairs, ";").alias("fields"), F.array_join("interfaces", ",").alias("interfaces"),
        F.array_join("acls", ",").alias("acls"), F.array_join("acl_failures", ",").alias("acl_failures"), "residue_lines",
    )


@query(
    "n08_state_split",
    f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE}, {RESOLVED_CTE}, grid AS (SELECT k, unnest([{', '.join(quote(f) for f in packs.CANONICAL_FIELDS)}]) AS field FROM base) "
    "SELECT 'dev-' || g.k AS device_id, g.field, coalesce(r.state, 'unknown') AS state, coalesce(r.state, 'unknown') <> 'unknown' AS determinable FROM grid g LEFT JOIN resolved r ON r.k = g.k AND r.field = g.field",
)
def n08_state_split(spark: SparkSession, sf: str) -> DataFrame:
    got = resolved_fields(spark, sf).withColumn("device_id", F.concat(F.lit("dev-"), "k"))
    return normalise.state_grid(d.device_config(spark, sf), got, packs.CANONICAL_FIELDS)
