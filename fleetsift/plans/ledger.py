"""Queries of the ledger, reads, quality checks, remediation and corpus tables (L, Q, DQ, R, S18-S24)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.functions import text as tx
from fleetsift.operators import detect, ledger as lg, packstore, quality as dq, reads, remediation as rm
from fleetsift.operators.ingest import line_cache
from fleetsift.operators.scan import dense_sequence
from fleetsift.plans.comply import FINDINGS_CTE, devices, findings
from fleetsift.plans.detect import CFG, HITS_CTE, PACK_CTE, RANKED_CTE, SCORES_CTE, configs, quote
from fleetsift.plans.fleet import KIND_CTE, entries
from fleetsift.plans.registry import query
from fleetsift.session import checkpoint_dir
from fleetsift.operators import acl
from fleetsift.sources import derived as d, sinks
from fleetsift.sources.literals import Literal
from fleetsift.sources.rules import SEVERITY_RANK, VERDICT_RANK

# ---- ledger ----------------------------------------------------------------------------

_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
CHAIN_CTE = f"""rec AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, ts, props AS payload_json, sha256(props) AS payload_hash, event_type AS action,
    CASE WHEN event_type = 'error' THEN 'model' ELSE 'human' END AS actor_type FROM events),
  part AS (SELECT *, '{{"action":"' || action || '","actor":{{"id":"u' || chain_id || '","role":null,"type":"' || actor_type || '"}},"payload_hash":"' AS a, '","seq":' || seq || ',"subject":{{"id":"e' || event_id || '","kind":"event"}},"timestamp":"' || {_TS} || '"}}' AS z FROM rec),
  chain AS (SELECT chain_id, seq, repeat('0', 64) AS prev_hash, sha256(a || payload_hash || '","prev_hash":"' || repeat('0', 64) || z) AS entry_hash FROM part WHERE seq = 0
    UNION ALL SELECT p.chain_id, p.seq, c.entry_hash, sha256(p.a || p.payload_hash || '","prev_hash":"' || c.entry_hash || p.z) FROM chain c JOIN part p ON p.chain_id = c.chain_id AND p.seq = c.seq + 1),
  log AS (SELECT p.*, c.prev_hash, c.entry_hash FROM part p JOIN chain c USING (chain_id, seq))"""
TAMPER_CTE = f"""{CHAIN_CTE}, bad AS (SELECT chain_id, seq, event_id, CASE WHEN event_id % 97 = 0 THEN 'changed' ELSE payload_json END AS payload_json, payload_hash, prev_hash, CASE WHEN event_id % 83 = 0 THEN repeat('f', 64) ELSE entry_hash END AS entry_hash, entry_hash AS true_hash,
    CASE WHEN event_id % 101 = 0 THEN 'md5' ELSE 'sha256' END AS hash_algo FROM log WHERE event_id % 89 <> 0),
  nb AS (SELECT *, lag(seq) OVER w AS ps, lag(entry_hash) OVER w AS pe FROM bad WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
  fail AS (SELECT chain_id, seq, 'deleted_record' AS kind FROM nb WHERE seq <> ps + 1 UNION ALL SELECT chain_id, seq, 'algo_mismatch' FROM nb WHERE hash_algo <> 'sha256' UNION ALL SELECT chain_id, seq, 'modified_payload' FROM nb WHERE sha256(payload_json) <> payload_hash
    UNION ALL SELECT chain_id, seq, 'broken_link' FROM nb WHERE pe IS NOT NULL AND prev_hash <> pe UNION ALL SELECT chain_id, seq, 'modified_record' FROM nb WHERE entry_hash <> true_hash)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    numbered = dense_sequence(e, "user_id", F.to_date("ts"), ["ts", "event_id"])
    return numbered.select(
        F.col("user_id").alias("chain_id"), "seq", "event_id", "ts", F.col("props").alias("payload_json"), F.col("event_type").alias("action"),
        F.concat(F.lit("u"), "user_id").alias("actor_id"), F.lit(None).cast("string").alias("actor_role"),
        F.when(F.col("event_type") == "error", "model").otherwise("human").alias("actor_type"), F.concat(F.lit("e"), "event_id").alias("subject_id"), F.lit("event").alias("subject_kind"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    return lg.append(records(spark, sf))


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return log(spark, sf).where(e % 89 != 0).withColumns({
        "payload_json": F.when(e % 97 == 0, "changed").otherwise(F.col("payload_json")),
        "entry_hash": F.when(e % 83 == 0, "f" * 64).otherwise(F.col("entry_hash")),
        "hash_algo": F.when(e % 101 == 0, "md5").otherwise(F.col("hash_algo")),
    })


@query("l01_canonical_timestamp", f"SELECT event_id, {_TS} AS canonical FROM events")
def l01_canonical_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "events").select("event_id", lg.canonical_ts(F.col("ts")).alias("canonical"))


@query("l02_payload_hash", "SELECT event_id, sha256(props) AS payload_hash FROM events")
def l02_payload_hash(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "events").withColumnRenamed("props", "payload_json").select("event_id", lg.payload_hash().alias("payload_hash"))


@query(
    "l02_canonical_json",
    """SELECT event_id, '{"a":{"b":"é' || user_id || '","y":null},"k":[' || user_id || ',"2",true],"z":' || event_id || '}' AS canonical,
    sha256('{"a":{"b":"é' || user_id || '","y":null},"k":[' || user_id || ',"2",true],"z":' || event_id || '}') AS payload_hash FROM events""",
)
def l02_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads written with their keys in any order and with white space."""
    e = d.table(spark, sf, "events")
    raw = F.concat(F.lit('{ "z": '), "event_id", F.lit(', "k" : ['), "user_id", F.lit(', "2", true],\n "a": {"y": null, "b": "é'), "user_id", F.lit('"} }'))
    rows = e.select("event_id", lg.canonical_json(raw).alias("payload_json"))
    return rows.select("event_id", F.col("payload_json").alias("canonical"), lg.payload_hash().alias("payload_hash"))


@query("l03_entry_hash", f"WITH RECURSIVE {CHAIN_CTE} SELECT event_id, sha256(a || payload_hash || '\",\"prev_hash\":\"' || repeat('0', 64) || z) AS entry_hash FROM part")
def l03_entry_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).withColumn("payload_hash", lg.payload_hash()).withColumn("prev_hash", F.lit(lg.GENESIS))
    return rows.select("event_id", lg.entry_hash().alias("entry_hash"))


@query("l04_chain_append", f"WITH RECURSIVE {CHAIN_CTE} SELECT chain_id, seq, prev_hash, entry_hash FROM chain")
def l04_chain_append(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("chain_id", "seq", "prev_hash", "entry_hash")


@query("l05_chain_verify", f"WITH RECURSIVE {TAMPER_CTE} SELECT * FROM fail")
def l05_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    return lg.verify(tampered(spark, sf))


@query(
    "l06_head_state",
    f"WITH RECURSIVE {CHAIN_CTE}, h AS (SELECT chain_id, max(seq) AS top, count(*) AS n FROM log GROUP BY 1) SELECT chain_id, CASE chain_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'truncated' WHEN 2 THEN 'lagging' WHEN 3 THEN 'hash_mismatch' WHEN 4 THEN 'count_mismatch' ELSE 'consistent' END AS state FROM h "
    "UNION ALL SELECT -1 - s_suppkey, 'truncated' FROM supplier",
)
def l06_head_state(spark: SparkSession, sf: str) -> DataFrame:
    whole = log(spark, sf)
    r = F.col("chain_id") % 7
    heads = lg.heads_of(whole).where(r != 0).select(
        "chain_id", (F.col("last_seq") + F.when(r == 1, 2).when(r == 2, -1).otherwise(0)).alias("last_seq"), F.when(r == 3, "x").otherwise(F.col("last_hash")).alias("last_hash"),
        (F.col("record_count") + F.when(r == 4, 1).otherwise(0)).alias("record_count"),
    )
    lone = d.table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("chain_id"), F.lit(3).cast("bigint").alias("last_seq"), F.lit("x").alias("last_hash"), F.lit(4).cast("bigint").alias("record_count"))
    return lg.head_state(whole, heads.unionByName(lone))


@query(
    "l07_range_verify",
    f"WITH RECURSIVE {TAMPER_CTE}, r AS (SELECT *, CASE WHEN ps >= 10 OR ps = 9 THEN ps END AS rps, CASE WHEN ps >= 9 THEN pe END AS rpe FROM nb WHERE seq BETWEEN 10 AND 40) SELECT chain_id, seq, 'deleted_record' AS kind FROM r WHERE seq <> rps + 1 "
    "UNION ALL SELECT chain_id, seq, 'algo_mismatch' FROM r WHERE hash_algo <> 'sha256' UNION ALL SELECT chain_id, seq, 'modified_payload' FROM r WHERE sha256(payload_json) <> payload_hash UNION ALL SELECT chain_id, seq, 'broken_link' FROM r WHERE rpe IS NOT NULL AND prev_hash <> rpe "
    "UNION ALL SELECT chain_id, seq, 'modified_record' FROM r WHERE entry_hash <> true_hash",
)
def l07_range_verify(spark: SparkSession, sf: str) -> DataFrame:
    return lg.verify(tampered(spark, sf), start=10, end=40)


@query("l07_unanchored", f"WITH RECURSIVE {TAMPER_CTE} SELECT chain_id, bool_or(seq = 9) AS anchored FROM bad GROUP BY 1")
def l07_unanchored(spark: SparkSession, sf: str) -> DataFrame:
    return lg.anchors(tampered(spark, sf), 10)


@query("l08_log_query", f"WITH RECURSIVE {CHAIN_CTE} SELECT chain_id, seq, action FROM log WHERE action = 'click' AND actor_type = 'human' AND ts >= TIMESTAMP '2024-01-02'")
def l08_log_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).where((F.col("action") == "click") & (F.col("actor_type") == "human") & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")))
    return reads.listing(rows, ("chain_id", "seq")).select("chain_id", "seq", "action")


@query("l09_model_actor", "SELECT event_id FROM events WHERE event_type = 'error'")
def l09_model_actor(spark: SparkSession, sf: str) -> DataFrame:
    return lg.model_actor_violations(records(spark, sf)).select("event_id")


@query(
    "l10_chain_report",
    f"WITH RECURSIVE {TAMPER_CTE}, f AS (SELECT chain_id, count(*) AS failures, min(seq) AS first_failure_seq, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM fail GROUP BY 1) SELECT b.chain_id, b.n AS records_checked, coalesce(failures, 0) AS failures, first_failure_seq, kinds, failures IS NULL AS ok FROM (SELECT chain_id, count(*) AS n FROM bad GROUP BY 1) b LEFT JOIN f USING (chain_id)",
)
def l10_chain_report(spark: SparkSession, sf: str) -> DataFrame:
    bad = tampered(spark, sf)
    return lg.report(bad, lg.verify(bad))


# ---- reads -----------------------------------------------------------------------------

@query("q01_files_by_owner", "SELECT doc_id, source FROM documents d WHERE source = 'src7' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def q01_files_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    owned = d.table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    found = reads.files_of_owner(d.table(spark, sf, "documents").select("doc_id", "source"), owned, "src7")
    return reads.listing(found, (F.col("doc_id").desc(),))


@query("q02_line_window", f"WITH {d.DOC_LINES_CTE}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM cfg_line) SELECT * FROM t WHERE line_number BETWEEN 3 AND 7")
def q02_line_window(spark: SparkSession, sf: str) -> DataFrame:
    lines = tx.split_lines(F.col("text"))
    docs = d.table(spark, sf, "documents").select("doc_id", F.size(lines).alias("total"), F.slice(lines, 3, 5).alias("part"))
    rows = docs.select("doc_id", "total", F.posexplode_outer("part").alias("p", "text")).where(F.col("p").isNotNull())
    return rows.select("doc_id", (F.col("p") + 3).alias("line_number"), "text", "total")


_DEVQ = f"{FINDINGS_CTE.split(', obs AS', 1)[0]}, named AS (SELECT *, CASE WHEN n % 6 <> 0 THEN 'host-' || n END AS hostname FROM dev)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return devices(spark, sf).withColumn("hostname", F.when(F.col("n") % 6 != 0, F.concat(F.lit("host-"), "n")))


@query("q03_devices_by_name", f"WITH {_DEVQ} SELECT device_id, hostname FROM named")
def q03_devices_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return reads.listing(_named(spark, sf), (F.asc_nulls_last("hostname"), "device_id")).select("device_id", "hostname")


@query("q04_first_owner", "SELECT o_custkey AS file_id, arg_min(o_orderkey % 5, o_orderkey) AS owner_id FROM orders GROUP BY 1")
def q04_first_owner(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.min_by(F.col("o_orderkey") % 5, "o_orderkey").alias("owner_id"))


@query("q05_runs_list", "SELECT o_orderkey AS audit_id, o_custkey % 5 AS owner_id FROM orders")
def q05_runs_list(spark: SparkSession, sf: str) -> DataFrame:
    runs = d.table(spark, sf, "orders").withColumn("owner_id", F.col("o_custkey") % 5)
    return reads.listing(runs, (F.col("o_orderdate").desc(), F.col("o_orderkey").desc())).select(F.col("o_orderkey").alias("audit_id"), "owner_id")


_LATEST = "latest AS (SELECT o_custkey AS n, max(o_orderkey) FILTER (o_orderdate = md) AS audit_id FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS md FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1)"


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    runs = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("device"), F.col("o_orderdate").alias("ran_at"), F.col("o_orderkey").alias("audit_id"))
    return reads.latest_runs(runs).withColumnRenamed("device", "n")


@query("q06_latest_run", f"WITH {_LATEST} SELECT n, audit_id FROM latest")
def q06_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(spark, sf)


@query("q07_latest_failing", f"WITH {_DEVQ}, {_LATEST} SELECT device_id, audit_id, audit_id % 4 AS failing FROM named JOIN latest USING (n) WHERE audit_id % 4 > 0")
def q07_latest_failing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf).join(_latest(spark, sf), "n").select("device_id", "audit_id", (F.col("audit_id") % 4).alias("failing"))
    return rows.where(F.col("failing") > 0)


@query("q08_findings_filter", f"WITH {FINDINGS_CTE} SELECT finding_id, rule_id FROM finding WHERE status = 'fail' AND severity = 'critical'")
def q08_findings_filter(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).where((F.col("status") == "fail") & (F.col("severity") == "critical")).select("finding_id", "rule_id")


@query("q09_device_search", f"WITH {_DEVQ} SELECT device_id FROM named WHERE contains(lower(coalesce(hostname, '')), 'st-12') OR contains(lower(device_id), 'st-12') OR contains(lower(coalesce(vendor, '')), 'st-12') OR contains(lower(coalesce(os_family, '')), 'st-12') OR contains(lower(coalesce(os_version, '')), 'st-12')")
def q09_device_search(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.lit(False)
    for c in ("hostname", "device_id", "vendor", "os_family", "os_version"):
        hit = hit | F.coalesce(F.lower(c).contains("ST-12".lower()), F.lit(False))
    return _named(spark, sf).where(hit).select("device_id")


@query("q10_visibility", "SELECT s_suppkey AS user_id, o_orderkey AS audit_id FROM supplier JOIN orders ON o_custkey % 50 = s_suppkey OR s_suppkey = 3")
def q10_visibility(spark: SparkSession, sf: str) -> DataFrame:
    users = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") == 3).alias("admin"))
    runs = d.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("owner_id"), F.col("o_orderkey").alias("audit_id"))
    return reads.visible_runs(users, runs)


@query("q11_batch_summary", "SELECT o_custkey AS batch_id, count(*) FILTER (o_orderstatus <> 'P') AS accepted, count(*) FILTER (o_orderstatus = 'F') AS duplicate, count(*) FILTER (o_orderstatus = 'P') AS rejected, count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 4 = 0) AS unidentified FROM orders GROUP BY 1")
def q11_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    status = F.when(s == "P", "rejected").when(s == "F", "duplicate").otherwise("ingested")
    return reads.batch_summary(d.table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), status.alias("status"), (k % 4 != 0).alias("identified")))


@query("q12_unidentified", f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE} SELECT k, outcome FROM decided WHERE outcome <> 'detected'")
def q12_unidentified(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect(configs(spark, sf)).where(F.col("outcome") != "detected").select("k", "outcome")


# ---- quality ---------------------------------------------------------------------------

_F = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber"
_K = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_DQ1 = """f AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'unknown' WHEN 2 THEN 'absent_default' WHEN 3 THEN 'absent_unsupported' ELSE 'present' END AS state, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS value, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS ev,
   CASE WHEN l_discount > 0.05 THEN 'ref' END AS ref, CASE WHEN l_tax > 0.04 THEN 'no_match' END AS why, CASE WHEN l_suppkey % 3 = 0 THEN 'uncalibrated_similarity' ELSE 'deterministic' END AS method, CASE WHEN l_partkey % 4 = 0 THEN 0.9 ELSE 1.0 END AS conf FROM lineitem)"""


@query("dq1_field_invariants", f"WITH {_DQ1} " + " UNION ALL ".join(f"{_F}, '{n}' AS rule FROM f WHERE {c}" for n, c in (
    ("present_without_evidence", "state = 'present' AND ev = 0"), ("present_without_value", "state = 'present' AND value IS NULL"), ("default_without_citation", "state = 'absent_default' AND ref IS NULL"),
    ("unknown_without_reason", "state = 'unknown' AND why IS NULL"), ("unknown_with_value", "state = 'unknown' AND value IS NOT NULL"), ("unsupported_with_value", "state = 'absent_unsupported' AND value IS NOT NULL"),
    ("exact_confidence", "state = 'present' AND method = 'deterministic' AND conf <> 1.0"), ("uncalibrated_claim", "method = 'uncalibrated_similarity' AND state <> 'unknown'"))))
def dq1_field_invariants(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = d.table(spark, sf, "lineitem").select(
        *_K, F.when(n == 1, "unknown").when(n == 2, "absent_default").when(n == 3, "absent_unsupported").otherwise("present").alias("state"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("value"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("evidence_count"), F.when(F.col("l_discount") > 0.05, "ref").alias("default_ref"), F.when(F.col("l_tax") > 0.04, "no_match").alias("unknown_reason"),
        F.when(F.col("l_suppkey") % 3 == 0, "uncalibrated_similarity").otherwise("deterministic").alias("method"), F.when(F.col("l_partkey") % 4 == 0, 0.9).otherwise(1.0).alias("confidence"),
    )
    return dq.violations(rows, _K, dq.field_rules())


@query("dq2_finding_invariants", f"WITH {FINDINGS_CTE}, x AS (SELECT finding_id, status, CASE WHEN n % 4 = 0 THEN NULL ELSE unknown_reason END AS why, CASE WHEN n % 5 = 0 THEN 0 ELSE coalesce(ev, 0) END AS e, CASE WHEN status <> 'unknown' THEN ref END AS r, CASE WHEN n % 7 = 0 THEN 's' END AS sn FROM finding) "
       + " UNION ALL ".join(f"SELECT finding_id, '{n}' AS rule FROM x WHERE {c}" for n, c in (("verdict_without_proof", "status IN ('pass', 'fail') AND e = 0 AND r IS NULL"), ("unknown_without_reason", "status = 'unknown' AND why IS NULL"),
                                                                                          ("reason_on_verdict", "status <> 'unknown' AND why IS NOT NULL"), ("unknown_with_remediation", "status = 'unknown' AND sn IS NOT NULL"))))
def dq2_finding_invariants(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("device_id", r"(\d+)$", 1).cast("bigint")
    rows = findings(spark, sf).withColumns({
        "unknown_reason": F.when(n % 4 != 0, F.col("unknown_reason")), "evidence_count": F.when(n % 5 == 0, 0).otherwise(F.col("evidence_count")), "snippet_id": F.when(n % 7 == 0, "s"),
    })
    return dq.violations(rows, ["finding_id"], dq.finding_rules())


@query("dq3_citations", f"WITH {d.DOC_LINES_CTE} SELECT doc_id, line_number, 'hash_mismatch' AS rule FROM cfg_line WHERE line_number % 50 = 0 UNION ALL SELECT doc_id, line_number, 'inverted_range' FROM cfg_line WHERE line_number % 30 = 0")
def dq3_citations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_number")
    rows = d.doc_lines(spark, sf).select(
        "doc_id", "line_number", F.col("text").alias("raw_line"), F.when(n % 50 == 0, "x").otherwise(tx.line_hash(F.col("text"))).alias("line_sha256"), n.alias("line_start"), (n - F.when(n % 30 == 0, 1).otherwise(0)).alias("line_end")
    )
    return dq.violations(rows, ["doc_id", "line_number"], dq.citation_rules())


@query("dq4_observations", f"WITH {KIND_CTE} SELECT acl_id, seq, CASE WHEN kind = 'undetermined' THEN 'undetermined_without_reason' ELSE 'reason_on_determined' END AS rule FROM seen WHERE acl_id % 3 = 0 AND kind <> 'shadowed' AND kind <> 'redundant'")
def dq4_observations(spark: SparkSession, sf: str) -> DataFrame:
    seen = acl.observations(entries(spark, sf))
    spoil = (F.col("acl_id") % 3 == 0) & ~F.col("kind").isin("shadowed", "redundant")
    why = F.when(spoil, F.when(F.col("kind") != "undetermined", "x")).otherwise(F.col("unresolved_reason"))
    return dq.violations(seen.withColumn("unresolved_reason", why).withColumn("causes", F.lit(1)), ["acl_id", "seq"], dq.observation_rules())


@query("dq5_table_checks", "SELECT o_orderkey, 'rejected_without_reason' AS rule FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'bad_hash' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'score_out_of_range' FROM orders WHERE o_totalprice / 450000 > 1")
def dq5_table_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = d.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, "empty").alias("reason"), F.when(k % 7 == 0, "ABC").otherwise(F.sha2(k.cast("string"), 256)).alias("sha"), (F.col("o_totalprice") / 450000).alias("score")
    )
    return dq.violations(rows, ["o_orderkey"], {
        "rejected_without_reason": (F.col("status") == "P") & F.col("reason").isNull(), "bad_hash": ~F.col("sha").rlike("^[0-9a-f]{64}$"), "score_out_of_range": ~F.col("score").between(0, 1),
    })


@query(
    "dq6_pack_invariants",
    "WITH v AS (SELECT p_brand AS pack_id, '1.' || p_partkey AS version, CASE WHEN p_partkey % 9 = 0 THEN 'active' ELSE 'draft' END AS status, CASE WHEN p_size > 5 THEN 'sum' END AS checksum, CASE WHEN p_partkey % 50 = 0 THEN '1.' || p_partkey ELSE '0' END AS parent_version FROM part), "
    "p AS (SELECT p_brand AS pack_id, '1.0' AS version, 'p-' || (p_partkey % 700) AS pattern_id FROM part), r AS (SELECT p_brand AS pack_id, p_name AS name_pattern FROM part), e AS (SELECT p_brand AS pack_id, p_type AS pattern_id, p_name AS text, p_size % 5 <> 0 AS expected FROM part) "
    "SELECT 'duplicate_pattern_id' AS rule, pack_id, version || ':' || pattern_id AS subject FROM p GROUP BY pack_id, version, pattern_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_role_pattern', pack_id, name_pattern FROM r GROUP BY ALL HAVING count(*) > 1 "
    "UNION ALL SELECT 'active_without_checksum', pack_id, version FROM v WHERE status = 'active' AND checksum IS NULL UNION ALL SELECT 'own_parent', pack_id, version FROM v WHERE parent_version = version UNION ALL SELECT 'example_in_both_lists', pack_id, pattern_id || ':' || text FROM e GROUP BY pack_id, pattern_id, text HAVING bool_or(expected) AND bool_or(NOT expected)",
)
def dq6_pack_invariants(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "part")
    n, pack = F.col("p_partkey"), F.col("p_brand").alias("pack_id")
    version = F.concat(F.lit("1."), n)
    versions = p.select(pack, version.alias("version"), F.when(n % 9 == 0, "active").otherwise("draft").alias("status"), F.when(F.col("p_size") > 5, "sum").alias("checksum"), F.when(n % 50 == 0, version).otherwise("0").alias("parent_version"))
    patterns = p.select(pack, F.lit("1.0").alias("version"), F.concat(F.lit("p-"), n % 700).alias("pattern_id"))
    examples = p.select(pack, F.col("p_type").alias("pattern_id"), F.col("p_name").alias("text"), (F.col("p_size") % 5 != 0).alias("expected"))
    return packstore.invariants(patterns, versions, p.select(pack, F.col("p_name").alias("name_pattern")), examples)


_SPLIT = "CASE lang WHEN 'en' THEN 'dev' WHEN 'fr' THEN 'eval' ELSE 'holdout' END"
_LAB = f"lab AS (SELECT l.doc_id, {_SPLIT} AS split, l.doc_id % 3 <> 0 AS determinable, CASE WHEN l.doc_id % 4 <> 0 THEN quality END AS expected_value, CASE WHEN l.doc_id % 5 <> 0 THEN 1 + l.doc_id % 6 END AS evidence_line, l.doc_id % 7 <> 0 AS has_text FROM labels l JOIN documents USING (doc_id))"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "eval").otherwise("holdout")
    docs = d.table(spark, sf, "documents").select("doc_id", split.alias("split"))
    n = F.col("doc_id")
    return d.table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "split", (n % 3 != 0).alias("determinable"), F.when(n % 4 != 0, F.col("quality")).alias("expected_value"), F.when(n % 5 != 0, 1 + n % 6).alias("evidence_line"), F.when(n % 7 != 0, "t").alias("evidence_text")
    )


@query("dq7_label_invariants", f"WITH {_LAB} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM lab WHERE {c}" for n, c in (
    ("value_on_undeterminable", "NOT determinable AND expected_value IS NOT NULL"), ("citation_on_undeterminable", "NOT determinable AND (evidence_line IS NOT NULL OR has_text)"), ("half_citation", "(evidence_line IS NULL) = has_text"), ("not_eval_split", "split <> 'eval'"))))
def dq7_label_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return dq.violations(_labels(spark, sf), ["doc_id"], dq.label_rules())


# ---- corpus tables ---------------------------------------------------------------------

@query("s18_manifest_load", f"SELECT doc_id, {_SPLIT} AS split, sha256(text) AS sha FROM documents WHERE {_SPLIT} <> 'holdout'")
def s18_manifest_load(spark: SparkSession, sf: str) -> DataFrame:
    """The sealed split is filtered before any content is read."""
    split = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "eval").otherwise("holdout")
    opened = d.table(spark, sf, "documents").withColumn("split", split).where(F.col("split") != "holdout")
    return opened.select("doc_id", "split", tx.line_hash(F.col("text")).alias("sha"))


_S19 = f"{d.DOC_LINES_CTE}, {_LAB}, cnt AS (SELECT doc_id, count(*) AS n FROM cfg_line GROUP BY 1)"


@query(
    "s19_label_integrity",
    f"WITH {_S19} SELECT l.doc_id, CASE WHEN l.doc_id % 11 = 0 THEN 'file_changed' WHEN evidence_line > n THEN 'line_out_of_range' WHEN l.doc_id % 13 = 0 THEN 'citation_drifted' END AS problem FROM lab l JOIN cnt USING (doc_id) WHERE l.doc_id % 11 = 0 OR evidence_line > n OR (evidence_line IS NOT NULL AND l.doc_id % 13 = 0)",
)
def s19_label_integrity(spark: SparkSession, sf: str) -> DataFrame:
    lines = tx.split_lines(F.col("text"))
    docs = d.table(spark, sf, "documents").select("doc_id", tx.line_hash(F.col("text")).alias("actual"), lines.alias("lines"))
    n = F.col("doc_id")
    rows = _labels(spark, sf).select("doc_id", "evidence_line").join(docs, "doc_id")
    cited = F.try_element_at("lines", F.col("evidence_line").cast("int"))
    quoted = F.when(n % 13 == 0, F.concat(cited, F.lit("?"))).otherwise(cited)
    declared = F.when(n % 11 == 0, "stale").otherwise(F.col("actual"))
    problem = (
        F.when(declared != F.col("actual"), "file_changed").when(F.col("evidence_line") > F.size("lines"), "line_out_of_range").when(F.col("evidence_line").isNotNull() & (quoted != cited), "citation_drifted")
    )
    return rows.select("doc_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("device_id", r"(\d+)$", 1).cast("bigint")
    ev = F.array(F.struct((n % 1000).alias("file_id"), (1 + n % 9).cast("int").alias("line")), F.struct((n % 997).alias("file_id"), (1 + n % 4).cast("int").alias("line")))
    return findings(spark, sf).where(F.col("status") == "fail").select("finding_id", ev.alias("evidence"))


_EV_CTE = f"{FINDINGS_CTE}, evp AS (SELECT finding_id, 0 AS ordinal, n % 1000 AS file_id, 1 + n % 9 AS line_start FROM finding WHERE status = 'fail' UNION ALL SELECT finding_id, 1, n % 997, 1 + n % 4 FROM finding WHERE status = 'fail')"


@query("s21_evidence_sink", f"WITH {_EV_CTE} SELECT finding_id, ordinal, file_id, line_start, line_start AS line_end FROM evp")
def s21_evidence_sink(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.evidence_pointers(_cited(spark, sf))


@query("s22_evidence_rehydrate", f"WITH {_EV_CTE}, {d.DOC_LINES_CTE} SELECT e.finding_id, e.ordinal, c.text FROM evp e JOIN cfg_line c ON c.doc_id = e.file_id AND c.line_number = e.line_start")
def s22_evidence_rehydrate(spark: SparkSession, sf: str) -> DataFrame:
    lines = d.doc_lines(spark, sf)
    hashed = lines.select(F.col("doc_id").alias("file_id"), "line_number", tx.line_hash(F.col("text")).alias("line_sha256"))
    return sinks.rehydrate(sinks.evidence_pointers(_cited(spark, sf)), hashed, line_cache(lines)).select("finding_id", "ordinal", "text")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s20_run_sink", f"WITH {FINDINGS_CTE} SELECT finding_id, rule_id, status, o_orderkey AS audit_id, o_orderdate AS run_date FROM finding JOIN orders ON o_orderkey = n")
def s20_run_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and their findings, written by date and read back."""
    runs = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_orderdate").alias("run_date"), F.col("o_custkey").alias("started_by"))
    found = findings(spark, sf).withColumn("audit_id", F.regexp_extract("device_id", r"(\d+)$", 1).cast("bigint"))
    path = _folder(spark, "runs")
    month = F.date_trunc("month", "run_date").cast("date")
    rows = found.select("finding_id", "rule_id", "status", "audit_id").join(runs.select("audit_id", month.alias("run_date")), "audit_id")
    for _ in range(2):  # as a job does that is repeated after it has written all
        sinks.save_run(runs.withColumn("run_date", month), rows, path)
    dates = runs.select("audit_id", F.col("run_date").alias("day"))
    return sinks.read_runs(spark, path, "finding").join(dates, "audit_id").select("finding_id", "rule_id", "status", "audit_id", F.col("day").alias("run_date"))


@query(
    "s23_residue_sink",
    f"WITH {d.DOC_LINES_CTE} SELECT doc_id AS file_id, line_number, text FROM cfg_line WHERE CASE WHEN doc_id % 2 = 1 THEN line_number % 3 = 0 ELSE doc_id % 4 = 0 AND line_number % 5 = 0 END",
)
def s23_residue_sink(spark: SparkSession, sf: str) -> DataFrame:
    """All files parsed once, every second one again: some then have other unknown lines, some have none."""
    lines = d.doc_lines(spark, sf).withColumnRenamed("doc_id", "file_id")
    files = d.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    path, n, line = _folder(spark, "residue"), F.col("file_id"), F.col("line_number")
    sinks.replace_residue(lines.where(line % 3 == 0), files, path, 1)
    for _ in range(2):
        sinks.replace_residue(lines.where((n % 4 == 0) & (line % 5 == 0)), files.where(n % 2 == 0), path, 2)
    return sinks.current_residue(spark, path).select("file_id", "line_number", "text")


@query("s24_training_examples", "SELECT conv_id, turn, text, conv_id % 3 <> 0 AS confirmed FROM conversations WHERE role = 'user'")
def s24_training_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn as an example, whether its decision was confirmed or not; the batch is written twice and read once."""
    c = d.table(spark, sf, "conversations").where(F.col("role") == "user")
    path, day = _folder(spark, "examples"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 7).cast("int"))
    for _ in range(2):
        sinks.append_examples(c.select("conv_id", "turn", "text", (F.col("conv_id") % 3 != 0).alias("confirmed"), day.alias("decided_on")), path, "first")
    return reads.listing(sinks.read_examples(spark, path), ("conv_id", "turn")).select("conv_id", "turn", "text", "confirmed")


# ---- remediation and report ------------------------------------------------------------

SNIPPETS = Literal("snippet", "vendor string, os_family string, rule_id string, snippet_id string", [
    ("cisco", "ios", "R-SSH", "ios-ssh"), ("cisco", "ios", "R-TELNET", "ios-telnet"), ("cisco", "nxos", "R-SSH", "nxos-ssh"), ("arista", "eos", "R-NTP", "eos-ntp"), ("cisco", "ios", "R-NTP", "ios-ntp")])
RES_CTE = f"""{FINDINGS_CTE}, {SNIPPETS.cte()}, res AS (SELECT f.*, s.snippet_id AS sid, CASE WHEN status <> 'fail' THEN 'not_actionable' WHEN f.vendor IS NULL OR f.os_family IS NULL THEN 'platform_unknown' WHEN s.snippet_id IS NOT NULL THEN 'resolved' ELSE 'no_snippet' END AS outcome2
   FROM finding f LEFT JOIN snippet s ON s.vendor = f.vendor AND s.os_family = f.os_family AND s.rule_id = f.rule_id)"""


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    platform = devices(spark, sf).select("device_id", "vendor", "os_family")
    return rm.resolve(findings(spark, sf).join(platform, "device_id"), SNIPPETS.frame(spark))


@query("r01_resolve", f"WITH {RES_CTE} SELECT finding_id, outcome2 AS outcome, CASE WHEN outcome2 = 'resolved' THEN sid END AS snippet_id FROM res")
def r01_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("finding_id", "outcome", "snippet_id")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of a device from its order's lines: 3 needs 1, 4 needs 3, 2 needs 4."""
    n = F.col("l_linenumber")
    need = F.when(n == 3, 1).when(n == 4, 3).when(n == 2, 4)
    return d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("device_id"), F.concat(F.lit("s"), n).alias("snippet_id"), F.when(n == 1, "high").when(n < 5, "low").otherwise("none").alias("lockout"), (10 - n).alias("order_hint"),
        F.when(need.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), need))).alias("depends_on"),
    )


@query(
    "r02_apply_order",
    # Fixed order of the seven snippets: free ones by (lockout, hint), then the chain 1, 3, 4, 2 by what is present.
    "WITH p AS (SELECT DISTINCT l_orderkey AS device_id, l_linenumber AS n FROM lineitem), h AS (SELECT device_id, bool_or(n = 1) AS h1, bool_or(n = 3) AS h3, bool_or(n = 4) AS h4 FROM p GROUP BY 1), "
    "k AS (SELECT device_id, n, CASE WHEN n >= 5 THEN 10 - n WHEN n = 4 THEN CASE WHEN NOT h3 THEN 20 WHEN NOT h1 THEN 33 ELSE 53 END WHEN n = 3 THEN CASE WHEN NOT h1 THEN 32 ELSE 52 END "
    "WHEN n = 2 THEN CASE WHEN NOT h4 THEN CASE WHEN h3 AND NOT h1 THEN 34 ELSE 24 END WHEN NOT h3 THEN 25 WHEN NOT h1 THEN 35 ELSE 55 END WHEN n = 1 THEN 50 END AS o FROM p JOIN h USING (device_id)) "
    "SELECT device_id, 's' || n AS snippet_id, row_number() OVER (PARTITION BY device_id ORDER BY o) AS position FROM k",
)
def r02_apply_order(spark: SparkSession, sf: str) -> DataFrame:
    return rm.apply_order(_plan(spark, sf))


def _library(spark: SparkSession, sf: str) -> DataFrame:
    """One snippet per part: chains of four, every tenth chain closed to a cycle, some dangling."""
    n = F.col("p_partkey")
    dep = F.when(n % 97 == 0, "missing").when(n % 4 != 0, F.concat(F.lit("n"), F.lpad((n - 1).cast("string"), 9, "0"))).when(n % 40 == 0, F.concat(F.lit("n"), F.lpad((n + 3).cast("string"), 9, "0")))
    return d.table(spark, sf, "part").select(
        F.concat(F.lit("n"), F.lpad(n.cast("string"), 9, "0")).alias("snippet_id"), F.when(dep.isNull(), F.array().cast("array<string>")).otherwise(F.array(dep)).alias("depends_on")
    )


_N = "'n' || lpad(({0})::VARCHAR, 9, '0')"


@query(
    "r03_cycles",
    f"SELECT {_N.format('a')} || ' -> ' || {_N.format('a + 3')} || ' -> ' || {_N.format('a + 2')} || ' -> ' || {_N.format('a + 1')} || ' -> ' || {_N.format('a')} AS cycle FROM (SELECT p_partkey AS a FROM part) WHERE a % 40 = 0 AND a % 97 <> 0 AND (a + 1) % 97 <> 0 AND (a + 2) % 97 <> 0 AND (a + 3) % 97 <> 0 AND a + 3 <= (SELECT max(p_partkey) FROM part)",
)
def r03_cycles(spark: SparkSession, sf: str) -> DataFrame:
    edges = _library(spark, sf).select(F.col("snippet_id").alias("src"), F.explode("depends_on").alias("dst"))
    return rm.cycles(edges)


_SKIP = "CASE WHEN n % 12 = 0 THEN n - 11 ELSE n + 1 END"


@query(
    "r03_components",
    f"""WITH RECURSIVE e AS (SELECT n AS a, {_SKIP} AS b FROM (SELECT p_partkey AS n FROM part) WHERE n % 5 <> 0 UNION SELECT p_partkey, p_partkey - p_partkey % 3 FROM part WHERE p_partkey % 3 <> 0 AND p_size % 2 = 0),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""",
)
def r03_components(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of twelve parts with gaps, and links back inside them: components of several cycles."""
    n = F.col("p_partkey")
    ring = F.when(n % 5 != 0, F.when(n % 12 == 0, n - 11).otherwise(n + 1))
    back = F.when((n % 3 != 0) & (F.col("p_size") % 2 == 0), n - n % 3)
    edges = d.table(spark, sf, "part").select(n.alias("src"), F.explode(F.array_compact(F.array(ring, back))).alias("dst"))
    return rm.cyclic_components(edges)


@query("r04_library_consistency", f"SELECT 'dangling_dependency' AS problem, {_N.format('p_partkey')} AS snippet_id, 'missing' AS dependency FROM part WHERE p_partkey % 97 = 0")
def r04_library_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rm.consistency(_library(spark, sf))


_SEV = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " END"
_VER = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VERDICT_RANK.items()) + " END"


@query(
    "r05_remediation_plan",
    f"WITH {RES_CTE} SELECT device_id, rule_id, outcome2 AS outcome, CASE WHEN outcome2 = 'resolved' THEN row_number() OVER (PARTITION BY device_id, outcome2 ORDER BY sid) END AS apply_order FROM res WHERE status = 'fail'",
)
def r05_remediation_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved steps in apply order, then the failures nobody has vetted, without a position."""
    fails = resolved(spark, sf).where(F.col("status") == "fail")
    plan = fails.where(F.col("outcome") == "resolved").select(
        "device_id", "snippet_id", F.lit("none").alias("lockout"), F.lit(0).alias("order_hint"), F.array().cast("array<string>").alias("depends_on")
    )
    placed = rm.apply_order(plan).withColumnRenamed("position", "apply_order")
    return fails.join(placed, ["device_id", "snippet_id"], "left").select("device_id", "rule_id", "outcome", "apply_order")


@query("r06_report_order", f"WITH {FINDINGS_CTE} SELECT device_id, rule_id, row_number() OVER (PARTITION BY device_id ORDER BY {_VER}, {_SEV}, rule_id) AS position FROM finding")
def r06_report_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    # A device has one finding per rule, so the window is bounded by the rule pack.
    return findings(spark, sf).select("device_id", "rule_id", F.row_number().over(W.partitionBy("device_id").orderBy(*rm.report_key())).alias("position"))


@query("r07_report_table", f"WITH {RES_CTE} SELECT finding_id, status, severity, outcome2 AS outcome, CASE WHEN outcome2 = 'resolved' THEN sid END AS snippet_id, coalesce(vendor || ' / ' || os_family, 'not identified') AS platform, os_version, expected FROM res")
def r07_report_table(spark: SparkSession, sf: str) -> DataFrame:
    version = devices(spark, sf).select("device_id", "os_version")
    platform = F.coalesce(F.concat("vendor", F.lit(" / "), "os_family"), F.lit("not identified"))
    return resolved(spark, sf).join(version, "device_id").select("finding_id", "status", "severity", "outcome", "snippet_id", platform.alias("platform"), "os_version", "expected")


@query(
    "r08_disclosures",
    f"WITH {FINDINGS_CTE}, a AS (SELECT device_id, count(*) FILTER (rule_id NOT IN ('R-BANNER-TYPE', 'R-AAA')) AS mapped, count(*) FILTER (unknown_reason = 'capability_unknown') AS und FROM finding GROUP BY 1) "
    "SELECT device_id, CASE WHEN mapped = 0 THEN 'no_framework_mapping' ELSE 'mappings_are_asserted' END || ',no_exposure_scoring' || CASE WHEN und > 0 THEN ',capability_unknown:' || und ELSE '' END || ',subject_is_a_file' AS disclosures FROM a",
)
def r08_disclosures(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings(spark, sf).withColumn("refs", F.when(F.col("rule_id").isin("R-BANNER-TYPE", "R-AAA"), "").otherwise("x")).withColumn("exposure_score", F.lit(None).cast("double"))
    return rm.disclosures(rows, {}, len(SNIPPETS.rows))


@query("r09_report_counts", f"WITH {RES_CTE} SELECT device_id, count(*) FILTER (status = 'fail') AS failures, count(*) FILTER (status = 'unknown') AS abstentions, count(*) FILTER (outcome2 = 'resolved') AS resolved FROM res GROUP BY 1")
def r09_report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).groupBy("device_id").agg(
        F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "unknown").alias("abstentions"), F.count_if(F.col("outcome") == "resolved").alias("resolved")
    )
