"""Queries of access-list analysis, exposure and baselines (A, E and B rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsift.operators import acl, baseline as bl, exposure as ex
from fleetsift.plans.comply import FINDINGS_CTE, OBS_CTE, devices, findings, observations
from fleetsift.plans.registry import query
from fleetsift.sources import derived as d
from fleetsift.sources.rules import SEVERITY_WEIGHT
from fleetsift.sources.tables import deal_out

# ---- access-list entries from line items -------------------------------------------------
# The sequence number is unique and narrow: line number, part and supplier in one number.

ENTRY_CTE = """raw AS (SELECT l_orderkey AS acl_id, (l_linenumber::BIGINT * 10000000 + l_partkey) * 100000 + l_suppkey AS seq,
    CASE WHEN l_returnflag = 'R' THEN 'deny' ELSE 'permit' END AS action,
    CASE WHEN l_linestatus = 'O' THEN 'ip' WHEN l_suppkey % 2 = 0 THEN 'tcp' WHEN l_suppkey % 7 = 0 THEN 'proto6' ELSE 'udp' END AS proto,
    CASE WHEN l_linestatus <> 'O' AND (l_suppkey % 2 = 0 OR l_suppkey % 7 = 0) THEN 6 END AS proto_num,
    CASE WHEN l_tax < 0.02 THEN 'object' WHEN l_tax >= 0.05 THEN 'any' ELSE 'cidr' END AS src_kind, CASE WHEN l_discount > 0.085 THEN 'object' WHEN l_discount < 0.06 THEN 'any' ELSE 'cidr' END AS dst_kind,
    [8, 16, 24][(l_partkey % 3 + 1)::INT] AS slen, [16, 24][(l_suppkey % 2 + 1)::INT] AS dlen, l_partkey % 4 AS sa, l_suppkey % 3 AS da, l_linenumber = 7 AS two,
    0 AS sp_lo, CASE WHEN l_quantity < 5 THEN 1023 ELSE 65535 END AS sp_hi,
    CASE WHEN l_quantity < 30 THEN 0 WHEN l_quantity < 40 THEN 443 ELSE 400 END AS dp_lo, CASE WHEN l_quantity < 30 THEN 65535 WHEN l_quantity < 40 THEN 443 ELSE 500 END AS dp_hi,
    l_tax > 0.075 AS established, l_discount > 0.095 AND l_partkey % 2 = 0 AS disabled FROM lineitem),
  ent AS (SELECT acl_id, seq, action, proto, proto_num, src_kind, dst_kind, sp_lo, sp_hi, dp_lo, dp_hi, established, disabled,
    CASE src_kind WHEN 'any' THEN [{'v': 4, 'lo': 0::BIGINT, 'hi': 4294967295::BIGINT}, {'v': 6, 'lo': 0, 'hi': 0}]
      WHEN 'cidr' THEN CASE WHEN two THEN [{'v': 4, 'lo': s0, 'hi': s1}, {'v': 4, 'lo': 3232235520::BIGINT, 'hi': 3232235775::BIGINT}] ELSE [{'v': 4, 'lo': s0, 'hi': s1}] END END AS src,
    CASE dst_kind WHEN 'any' THEN [{'v': 4, 'lo': 0::BIGINT, 'hi': 4294967295::BIGINT}, {'v': 6, 'lo': 0, 'hi': 0}] WHEN 'cidr' THEN [{'v': 4, 'lo': d0, 'hi': d1}] END AS dst
   FROM (SELECT *, a - a % sz AS s0, a - a % sz + sz - 1 AS s1, b - b % dz AS d0, b - b % dz + dz - 1 AS d1 FROM (SELECT *, 167772160::BIGINT + sa * 65536 + sa * 256 AS a, 2886729728::BIGINT + da * 256 AS b,
     (2::BIGINT ** (32 - slen))::BIGINT AS sz, (2::BIGINT ** (32 - dlen))::BIGINT AS dz FROM raw))),
  live AS (SELECT * FROM ent WHERE NOT disabled)"""
_NET = "len([1 FOR x IN i.{c} IF len([1 FOR y IN o.{c} IF y.v = x.v AND y.lo <= x.lo AND y.hi >= x.hi]) = 0]) = 0"
_ADDR = "CASE WHEN o.{c} IS NULL OR i.{c} IS NULL THEN NULL ELSE " + _NET + " END"
PAIR_CTE = f"""{ENTRY_CTE}, pair AS (SELECT i.acl_id, i.seq, o.seq AS cause_seq, i.action = o.action AS same,
    (NOT o.established OR i.established) AND (o.proto = 'ip' OR (i.proto <> 'ip' AND (o.proto = i.proto OR coalesce(o.proto_num = i.proto_num, false))))
    AND ({_ADDR.format(c='src')}) AND ({_ADDR.format(c='dst')}) AND (o.sp_lo <= i.sp_lo AND i.sp_hi <= o.sp_hi) AND (o.dp_lo <= i.dp_lo AND i.dp_hi <= o.dp_hi) AS cov
   FROM live i JOIN live o ON o.acl_id = i.acl_id AND o.seq < i.seq)"""
KIND_CTE = f"""{PAIR_CTE}, kinds AS (SELECT e.*, CASE WHEN e.src IS NULL OR e.dst IS NULL THEN 'undetermined' WHEN p.shadow THEN 'shadowed' WHEN p.red THEN 'redundant' WHEN p.open THEN 'undetermined' END AS kind,
    action = 'permit' AND src_kind = 'any' AND dst_kind = 'any' AND proto = 'ip' AND dp_lo = 0 AND dp_hi = 65535 AS permissive
   FROM live e LEFT JOIN (SELECT acl_id, seq, bool_or(cov AND NOT same) AS shadow, bool_or(cov AND same) AS red, bool_or(cov IS NULL) AS open FROM pair GROUP BY ALL) p USING (acl_id, seq)),
  seen AS (SELECT acl_id, seq, 'overly_permissive' AS kind, 'high' AS severity, NULL AS unresolved_reason FROM kinds WHERE permissive
    UNION ALL SELECT acl_id, seq, kind, CASE kind WHEN 'shadowed' THEN 'medium' WHEN 'redundant' THEN 'low' ELSE 'info' END,
      CASE WHEN kind = 'undetermined' THEN CASE WHEN src IS NULL OR dst IS NULL THEN 'unresolved_object' ELSE 'unresolved_earlier_entry' END END FROM kinds WHERE kind IS NOT NULL)"""


def _raw_entries(spark: SparkSession, sf: str) -> DataFrame:
    li = deal_out(
        d.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
        ),
        "l_orderkey",
    )  # by list, while they are narrow: nothing moves them again
    p, s, ln, q, tax, dis = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "linenumber", "quantity", "tax", "discount"))
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    own = F.col("l_linestatus") == "O"
    none = F.array().cast("array<string>")
    src = F.concat(F.lit("10."), p % 4, F.lit("."), p % 4, F.lit(".0/"), pick((8, 16, 24), p % 3))
    dst = F.concat(F.lit("172.16."), s % 3, F.lit(".0/"), pick((16, 24), s % 2))
    src_kind = F.when(tax < 0.02, "object").when(tax >= 0.05, "any").otherwise("cidr")
    dst_kind = F.when(dis > 0.085, "object").when(dis < 0.06, "any").otherwise("cidr")
    return li.select(
        F.col("l_orderkey").alias("acl_id"),
        ((ln.cast("bigint") * 10000000 + p) * 100000 + s).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "deny").otherwise("permit").alias("action"),
        F.when(own, "ip").when(s % 2 == 0, "tcp").when(s % 7 == 0, "proto6").otherwise("udp").alias("proto"),
        F.when(~own & ((s % 2 == 0) | (s % 7 == 0)), F.lit(6)).alias("proto_num"),
        src_kind.alias("src_kind"), dst_kind.alias("dst_kind"),
        F.when(src_kind == "cidr", F.when(ln == 7, F.array(src, F.lit("192.168.0.0/24"))).otherwise(F.array(src))).otherwise(none).alias("src_cidrs"),
        F.when(dst_kind == "cidr", F.array(dst)).otherwise(none).alias("dst_cidrs"),
        F.lit(0).alias("sp_lo"), F.when(q < 5, 1023).otherwise(65535).alias("sp_hi"),
        F.when(q < 30, 0).when(q < 40, 443).otherwise(400).alias("dp_lo"), F.when(q < 30, 65535).when(q < 40, 443).otherwise(500).alias("dp_hi"),
        (tax > 0.075).alias("established"), ((dis > 0.095) & (p % 2 == 0)).alias("disabled"),
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw_entries(spark, sf)
    return raw.withColumn("src", acl.networks(F.col("src_kind"), F.col("src_cidrs"))).withColumn(
        "dst", acl.networks(F.col("dst_kind"), F.col("dst_cidrs"))
    ).drop("src_cidrs", "dst_cidrs")


@query("a01_active_entries", f"WITH {ENTRY_CTE} SELECT acl_id, seq FROM live")
def a01_active_entries(spark: SparkSession, sf: str) -> DataFrame:
    return acl.active(_raw_entries(spark, sf)).select("acl_id", "seq")


@query(
    "a02_network_expansion",
    f"WITH {ENTRY_CTE} SELECT acl_id, seq, CASE WHEN src IS NULL THEN NULL ELSE len(src) END AS nets, src[1].lo AS first_lo, src[1].hi AS first_hi FROM ent",
)
def a02_network_expansion(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda h: F.conv(F.right(h, F.lit(8)), 16, 10).cast("bigint")
    e = entries(spark, sf)
    return e.select(
        "acl_id", "seq", F.when(F.col("src").isNotNull(), F.size("src")).alias("nets"),
        number(F.col("src")[0]["lo"]).alias("first_lo"), number(F.col("src")[0]["hi"]).alias("first_hi"),
    )


def _self_check(spark: SparkSession, sf: str, fn) -> DataFrame:
    """Each entry against the list's whole-network and single-service probes."""
    probes = [("10.0.0.0/8", "tcp", 443, 443), ("10.1.1.0/24", "udp", 0, 65535), ("0.0.0.0/0", "ip", 0, 65535)]
    cells = F.array(*[F.struct(F.lit(i).alias("probe"), fn(*p).alias("covers")) for i, p in enumerate(probes)])
    return entries(spark, sf).select("acl_id", "seq", F.explode(cells).alias("x")).select("acl_id", "seq", "x.*")


_PROBES = [(167772160, 184549375, "tcp", 443, 443), (167837952, 167838207, "udp", 0, 65535), (0, 4294967295, "ip", 0, 65535)]


@query(
    "a03_address_coverage",
    f"WITH {ENTRY_CTE} " + " UNION ALL ".join(
        f"SELECT acl_id, seq, {i} AS probe, CASE WHEN src IS NULL THEN NULL ELSE len([1 FOR y IN src IF y.v = 4 AND y.lo <= {lo} AND y.hi >= {hi}]) > 0 END AS covers FROM ent"
        for i, (lo, hi, *_) in enumerate(_PROBES)
    ),
)
def a03_address_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _self_check(spark, sf, lambda net, *_: acl.net_covers(F.col("src"), F.array(acl.network(F.lit(net)))))


@query(
    "a04_port_coverage",
    f"WITH {ENTRY_CTE} " + " UNION ALL ".join(f"SELECT acl_id, seq, {i} AS probe, dp_lo <= {lo} AND {hi} <= dp_hi AS covers FROM ent" for i, (*_, lo, hi) in enumerate(_PROBES)),
)
def a04_port_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _self_check(spark, sf, lambda _n, _p, lo, hi: acl.port_covers(F.col("dp_lo"), F.col("dp_hi"), F.lit(lo), F.lit(hi)))


@query(
    "a05_protocol_coverage",
    f"WITH {ENTRY_CTE} " + " UNION ALL ".join(
        f"SELECT acl_id, seq, {i} AS probe, proto = 'ip' OR ('{p}' <> 'ip' AND (proto = '{p}' OR ('{p}' = 'tcp' AND coalesce(proto_num = 6, false)))) AS covers FROM ent" for i, (_, _, p, *_) in enumerate(_PROBES)
    ),
)
def a05_protocol_coverage(spark: SparkSession, sf: str) -> DataFrame:
    number = {"tcp": 6}
    return _self_check(spark, sf, lambda _n, p, *_: acl.proto_covers(F.col("proto"), F.lit(p.upper()), F.col("proto_num"), F.lit(number.get(p)).cast("int")))


@query(
    "a06_tri_state_and",
    f"WITH {ENTRY_CTE} SELECT acl_id, seq, CASE WHEN src IS NULL THEN NULL ELSE len([1 FOR y IN src IF y.v = 4 AND y.lo <= 167772160 AND y.hi >= 184549375]) > 0 END "
    "AND CASE WHEN dst IS NULL THEN NULL ELSE len([1 FOR y IN dst IF y.v = 4 AND y.lo <= 2886729728 AND y.hi >= 2886729983]) > 0 END AND (dp_lo <= 443 AND 443 <= dp_hi) AS covers FROM ent",
)
def a06_tri_state_and(spark: SparkSession, sf: str) -> DataFrame:
    from fleetsift.functions.tristate import all_true

    net = lambda t: F.array(acl.network(F.lit(t)))
    both = all_true(
        acl.net_covers(F.col("src"), net("10.0.0.0/8")), acl.net_covers(F.col("dst"), net("172.16.0.0/24")),
        acl.port_covers(F.col("dp_lo"), F.col("dp_hi"), F.lit(443), F.lit(443)),
    )
    return entries(spark, sf).select("acl_id", "seq", both.alias("covers"))


@query("a07_pair_coverage", f"WITH {PAIR_CTE} SELECT acl_id, seq, count(*) AS covering FROM pair WHERE cov GROUP BY ALL")
def a07_pair_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Number of earlier entries that cover each entry."""
    live = acl.active(entries(spark, sf))
    return acl.covering_counts(live)


@query("a08_shadowed", f"WITH {KIND_CTE} SELECT p.acl_id, p.seq, p.cause_seq FROM pair p JOIN kinds k USING (acl_id, seq) WHERE k.kind = 'shadowed' AND p.cov AND NOT p.same")
def a08_shadowed(spark: SparkSession, sf: str) -> DataFrame:
    return acl.causes(entries(spark, sf), "shadowed")


@query("a09_redundant", f"WITH {KIND_CTE} SELECT p.acl_id, p.seq, p.cause_seq FROM pair p JOIN kinds k USING (acl_id, seq) WHERE k.kind = 'redundant' AND p.cov AND p.same")
def a09_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return acl.causes(entries(spark, sf), "redundant")


@query("a10_overly_permissive", f"WITH {KIND_CTE} SELECT acl_id, seq FROM kinds WHERE permissive")
def a10_overly_permissive(spark: SparkSession, sf: str) -> DataFrame:
    return acl.active(_raw_entries(spark, sf)).where(acl.permissive()).select("acl_id", "seq")


@query("a11_undetermined", f"WITH {KIND_CTE} SELECT acl_id, seq, unresolved_reason FROM seen WHERE kind = 'undetermined'")
def a11_undetermined(spark: SparkSession, sf: str) -> DataFrame:
    return acl.observations(entries(spark, sf)).where(F.col("kind") == "undetermined").select("acl_id", "seq", "unresolved_reason")


@query("a12_observations", f"WITH {KIND_CTE} SELECT acl_id, seq, kind, severity, unresolved_reason FROM seen")
def a12_observations(spark: SparkSession, sf: str) -> DataFrame:
    return acl.observations(entries(spark, sf))


@query(
    "a13_device_summary",
    f"WITH {KIND_CTE}, lists AS (SELECT o.o_custkey AS device_id, e.acl_id FROM orders o LEFT JOIN (SELECT DISTINCT acl_id FROM ent) e ON e.acl_id = o.o_orderkey), "
    "pl AS (SELECT acl_id, count(*) FILTER (kind = 'shadowed') AS shadowed, count(*) FILTER (kind = 'redundant') AS redundant, count(*) FILTER (kind = 'overly_permissive') AS overly_permissive, "
    "count(*) FILTER (kind = 'undetermined') AS undetermined FROM seen GROUP BY 1) SELECT device_id, count(acl_id) AS lists, count(*) FILTER (acl_id IS NOT NULL AND shadowed IS NULL) AS clean_lists, "
    "coalesce(sum(shadowed), 0)::BIGINT AS shadowed, coalesce(sum(redundant), 0)::BIGINT AS redundant, coalesce(sum(overly_permissive), 0)::BIGINT AS overly_permissive, coalesce(sum(undetermined), 0)::BIGINT AS undetermined, "
    "count(acl_id) = 0 AS analysed_nothing FROM lists LEFT JOIN pl USING (acl_id) GROUP BY 1",
)
def a13_device_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    have = e.select("acl_id").distinct()
    orders = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("acl_id"))
    owned = orders.join(have.withColumn("present", F.lit(True)), "acl_id", "left").select("device_id", F.when(F.col("present"), F.col("acl_id")).alias("acl_id"))
    return acl.summary(owned, e, acl.observations(e))


@query("a14_interval_overlap", f"WITH {ENTRY_CTE} SELECT acl_id, seq, dp_lo <= 450 AND 440 <= dp_hi AS overlaps FROM ent")
def a14_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_entries(spark, sf).select(
        "acl_id", "seq", acl.ports_overlap(F.col("dp_lo"), F.col("dp_hi"), F.lit(440), F.lit(450)).alias("overlaps")
    )


@query("x12_sequence_validity", "SELECT l_orderkey AS acl_id, l_linenumber AS seq, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def x12_sequence_validity(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("acl_id"), F.col("l_linenumber").alias("seq"))
    return acl.sequence_errors(li)


# ---- exposure ----------------------------------------------------------------------------

PLANE_CTE = """ifc AS (SELECT 'c-' || o_custkey AS device_id, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false WHEN '3-MEDIUM' THEN CASE WHEN o_custkey % 2 = 0 THEN true ELSE false END ELSE CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE false END END AS is_management,
   CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS enabled, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n_addresses FROM orders),
  lst AS (SELECT 'c-' || o_custkey AS device_id, o_totalprice > 420000 AS readable FROM orders),
  plane AS (SELECT d.device_id, coalesce(i.interfaces, 0) AS interfaces, coalesce(i.management, 0) AS management, coalesce(i.unclassified, 0) AS unclassified, coalesce(reachable, 0) AS reachable, coalesce(l.lists, 0) AS lists,
    CASE WHEN coalesce(management, 0) > 0 THEN reachable::DOUBLE / management ELSE 0.0 END AS reachability FROM dev d
    LEFT JOIN (SELECT device_id, count(*) AS interfaces, count(*) FILTER (is_management) AS management, count(*) FILTER (is_management IS NULL) AS unclassified,
      count(*) FILTER (is_management AND n_addresses > 0 AND coalesce(enabled, true)) AS reachable FROM ifc GROUP BY 1) i USING (device_id) LEFT JOIN (SELECT device_id, count(*) FILTER (readable) AS lists FROM lst GROUP BY 1) l USING (device_id))"""
ASSESS_CTE = f"""{FINDINGS_CTE}, {PLANE_CTE}, assessed AS (SELECT f.device_id, f.rule_id, f.severity, f.field, p.*, CASE WHEN f.field NOT IN ({', '.join("'" + x + "'" for x in ex.RELEVANT)}) THEN 'not_exposure_relevant'
    WHEN p.interfaces = 0 THEN 'no_interface_data' WHEN management = 0 AND unclassified > 0 THEN 'indeterminate_interfaces' WHEN lists = 0 THEN 'no_acl_data' ELSE 'determined' END AS determinacy,
    round(least(1.0, reachability * CASE severity {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_WEIGHT.items())} END), 4) AS sc FROM finding f JOIN plane p USING (device_id))"""


def plane(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders")
    dev = F.concat(F.lit("c-"), "o_custkey").alias("device_id")
    pr = F.col("o_orderpriority")
    mgmt = (
        F.when(pr == "1-URGENT", F.lit(True)).when(pr == "2-HIGH", F.lit(False)).when(pr == "3-MEDIUM", F.col("o_custkey") % 2 == 0)
        .when(F.col("o_custkey") % 3 != 0, F.lit(False))
    )
    ifaces = o.select(
        dev, mgmt.alias("is_management"), F.when(F.col("o_orderstatus") == "O", F.lit(True)).when(F.col("o_orderstatus") == "F", F.lit(False)).alias("enabled"),
        F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1).alias("n_addresses"),
    )
    # Every order has a list; that of a small one could not be read.
    return ex.device_plane(devices(spark, sf), ifaces, o.select(dev, (F.col("o_totalprice") > 420000).alias("readable")))


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return ex.assess(findings(spark, sf).select("device_id", "rule_id", "severity", "field"), plane(spark, sf))


@query("e01_relevance", f"WITH {ASSESS_CTE} SELECT device_id, rule_id, determinacy <> 'not_exposure_relevant' AS relevant FROM assessed")
def e01_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("device_id", "rule_id", F.col("field").isin(*ex.RELEVANT).alias("relevant"))


@query("e02_reachability", f"WITH {OBS_CTE}, {PLANE_CTE} SELECT device_id, management, reachable, round(reachability, 6) AS reachability FROM plane")
def e02_reachability(spark: SparkSession, sf: str) -> DataFrame:
    return plane(spark, sf).select("device_id", "management", "reachable", F.round("reachability", 6).alias("reachability"))


@query("e03_determinacy", f"WITH {ASSESS_CTE} SELECT device_id, rule_id, determinacy FROM assessed")
def e03_determinacy(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("device_id", "rule_id", "determinacy")


@query("e04_score", f"WITH {ASSESS_CTE} SELECT device_id, rule_id, CASE WHEN determinacy = 'determined' THEN sc END AS exposure_score FROM assessed")
def e04_score(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("device_id", "rule_id", "exposure_score")


@query(
    "e05_rank",
    f"WITH {ASSESS_CTE} SELECT a.device_id, a.rule_id, r.n AS priority_rank FROM assessed a LEFT JOIN (SELECT device_id, rule_id, row_number() OVER (PARTITION BY device_id ORDER BY sc DESC, rule_id) AS n FROM assessed "
    "WHERE determinacy = 'determined') r USING (device_id, rule_id)",
)
def e05_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ex.rank(assessed(spark, sf)).select("device_id", "rule_id", "priority_rank")


@query("e06_blockers", f"WITH {ASSESS_CTE} SELECT determinacy, count(*) AS findings FROM assessed WHERE determinacy <> 'determined' GROUP BY 1")
def e06_blockers(spark: SparkSession, sf: str) -> DataFrame:
    return ex.blockers(assessed(spark, sf))


@query(
    "e07_ordering",
    f"WITH {ASSESS_CTE} SELECT device_id, bool_or(determinacy = 'determined') AS ranked, count(*) FILTER (determinacy = 'determined') AS determined, count(*) FILTER (determinacy <> 'determined') AS undetermined FROM assessed GROUP BY 1",
)
def e07_ordering(spark: SparkSession, sf: str) -> DataFrame:
    return ex.ordering(assessed(spark, sf))


# ---- baselines ---------------------------------------------------------------------------

COHORT_CTE = f"""{OBS_CTE}, mem AS (SELECT device_id, CASE WHEN n % 6 <> 0 THEN 'host-' || n END AS hostname, CASE WHEN n % 40 = 0 THEN 'tiny-' || (n % 700) WHEN n % 3 = 0 THEN seg || '/' || (n % 5)
      ELSE coalesce(vendor, 'unknown-vendor') || '/' || coalesce(os_family, 'unknown-os') END AS cohort FROM dev),
  st AS (SELECT m.cohort, m.device_id, o.field, CASE WHEN o.field = 'ntp_servers' AND o.n % 9 = 0 THEN o.state WHEN o.field = 'ntp_servers' AND o.state <> 'unknown' THEN 'present' ELSE o.state END AS state FROM obs o JOIN mem m USING (device_id)),
  sz AS (SELECT cohort, count(*) AS cohort_size FROM mem GROUP BY 1),
  cnt AS (SELECT cohort, field, count(*) FILTER (state <> 'unknown') AS determinable, count(*) FILTER (state = 'present') AS n_present, count(*) FILTER (state = 'absent_default') AS n_absent_default,
    count(*) FILTER (state = 'absent_unsupported') AS n_absent_unsupported FROM st GROUP BY ALL),
  base0 AS (SELECT cnt.*, cohort_size, cohort_size - determinable AS indeterminate, greatest(n_present, n_absent_default, n_absent_unsupported) AS top FROM cnt JOIN sz USING (cohort)),
  bline AS (SELECT *, CASE WHEN cohort_size < 5 THEN 'cohort_too_small' WHEN determinable = 0 THEN 'no_determinable_states' WHEN top::DOUBLE / determinable < 0.75 THEN 'no_majority' ELSE 'compared' END AS outcome,
    CASE WHEN n_present = top THEN 'present' WHEN n_absent_unsupported = top THEN 'absent_unsupported' ELSE 'absent_default' END AS maj FROM base0),
  outl AS (SELECT s.cohort, s.device_id, s.field, s.state, b.maj AS majority_state, coalesce(m.hostname, left(s.device_id, 12)) AS label FROM st s JOIN bline b USING (cohort, field) JOIN mem m ON m.device_id = s.device_id
    WHERE b.outcome = 'compared' AND s.state <> 'unknown' AND s.state <> b.maj)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    peer = F.when(n % 40 == 0, F.concat(F.lit("tiny-"), n % 700)).when(n % 3 == 0, F.concat("seg", F.lit("/"), n % 5))
    rows = devices(spark, sf).withColumn("peer_group", peer).withColumn("hostname", F.when(n % 6 != 0, F.concat(F.lit("host-"), n)))
    return rows.select("device_id", "hostname", bl.cohort().alias("cohort"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    ntp = F.col("field") == "ntp_servers"
    state = F.when(ntp & (F.col("n") % 9 != 0) & (F.col("state") != "unknown"), "present").otherwise(F.col("state"))
    return o.select("device_id", "field", state.alias("state")).join(members(spark, sf).select("device_id", "cohort"), "device_id")


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return members(spark, sf), states(spark, sf)


@query("b01_cohort", f"WITH {COHORT_CTE} SELECT device_id, cohort FROM mem")
def b01_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).select("device_id", "cohort")


@query(
    "b02_dense_grid",
    f"WITH {COHORT_CTE} SELECT m.cohort, m.device_id, f.field, coalesce(s.state, 'unknown') AS state FROM mem m JOIN (SELECT DISTINCT cohort, field FROM st) f USING (cohort) LEFT JOIN st s ON s.device_id = m.device_id AND s.field = f.field",
)
def b02_dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    return bl.dense_grid(*_both(spark, sf)).select("cohort", "device_id", "field", "state")


@query("b03_field_baseline", f"WITH {COHORT_CTE} SELECT cohort, field, cohort_size, determinable, indeterminate, n_present, n_absent_default, n_absent_unsupported FROM bline")
def b03_field_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return bl.field_baselines(*_both(spark, sf)).select(
        "cohort", "field", "cohort_size", "determinable", "indeterminate", "n_present", "n_absent_default", "n_absent_unsupported"
    )


@query("b04_baseline_outcome", f"WITH {COHORT_CTE} SELECT cohort, field, outcome, CASE WHEN outcome = 'compared' THEN maj END AS majority_state, CASE WHEN outcome = 'compared' THEN top ELSE 0 END AS majority_count FROM bline")
def b04_baseline_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return bl.field_baselines(*_both(spark, sf)).select("cohort", "field", "outcome", "majority_state", "majority_count")


@query("b05_outliers", f"WITH {COHORT_CTE} SELECT cohort, device_id, field, state, majority_state, label FROM outl")
def b05_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return bl.outliers(*_both(spark, sf)).select("cohort", "device_id", "field", "state", "majority_state", "label")


@query("b06_device_label", f"WITH {COHORT_CTE} SELECT device_id, coalesce(hostname, left(device_id, 12)) AS label FROM mem")
def b06_device_label(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).select("device_id", bl.device_label().alias("label"))


@query(
    "b07_fleet_summary",
    f"WITH {COHORT_CTE} SELECT s.cohort, s.cohort_size AS devices, (SELECT min(device_id) FROM mem m WHERE m.cohort = s.cohort) AS first_device, coalesce(b.n, 0) AS baselines, coalesce(b.c, 0) AS comparable, coalesce(o.n, 0) AS deviations "
    "FROM sz s LEFT JOIN (SELECT cohort, count(*) AS n, count(*) FILTER (outcome = 'compared') AS c FROM bline GROUP BY 1) b USING (cohort) LEFT JOIN (SELECT cohort, count(*) AS n FROM outl GROUP BY 1) o USING (cohort)",
)
def b07_fleet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return bl.fleet_summary(*_both(spark, sf))
