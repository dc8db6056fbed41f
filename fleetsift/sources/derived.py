"""Inputs derived from the given tables.

``device_config`` renders one configuration file per order, in five syntaxes, from the
order's own columns.  The five columns are dealt out by order, then rendering is a narrow projection: no grouping, so a
hot customer or date does not matter.  The rendering expression is plain SQL, which lets
another engine state the facts a file must contain from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsift.functions import text as tx
from fleetsift.sources.tables import deal_out, spread, table

BASE_SQL = (
    "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS pr, "
    "o_orderdate AS d FROM orders"
)

# (condition or None, text expression); the line is left out when the condition is false.
Line = tuple[str | None, str]

IOS: list[Line] = [
    ("s <> 'P'", "'version 17.' || (k % 10)"),
    (None, "'service timestamps debug datetime'"),
    ("k % 6 <> 0", "'hostname edge-' || k"),
    (None, "'!'"),
    ("k % 7 = 0", "'enable secret 5 abc' || k"),
    (None, "'ip domain name site' || (c % 50) || '.example'"),
    ("k % 5 <> 0", "'ip ssh version ' || (1 + k % 2)"),
    (None, "CASE WHEN k % 3 = 0 THEN 'ip http server' ELSE 'no ip http server' END"),
    (None, "'interface GigabitEthernet0/0'"),
    (None, "' description uplink ' || c"),
    (None, "' ip address 10.' || (c % 200) || '.' || (k % 250) || '.1 255.255.255.0'"),
    ("k % 2 = 0", "' ip access-group EDGE-IN in'"),
    (None, "' no shutdown'"),
    (None, "'interface Vlan' || (1 + k % 90)"),
    ("k % 4 <> 0", "' ip address 192.168.' || (k % 256) || '.1 255.255.255.0'"),
    ("k % 3 = 1", "' shutdown'"),
    (None, "'ip access-list extended EDGE-IN'"),
    (None, "' remark generated ' || k"),
    (None, "' 10 permit tcp 10.' || (k % 200) || '.0.0 0.0.255.255 any eq 443'"),
    (None, "' deny udp any host 192.0.2.' || (k % 250) || ' eq ' || CASE WHEN k % 13 = 0 THEN 'bogusport' ELSE 'snmp' END"),
    (None, "' permit tcp any any established'"),
    (None, "' permit tcp 10.' || (k % 200) || '.' || (c % 200) || '.0 0.0.0.255 any eq https log'"),
    ("k % 11 = 0", "' permit ip object-group SRV any'"),
    (None, "' deny ip any any log'"),
    (None, "'banner motd #'"),
    (None, "'Authorised use only, site ' || c"),
    (None, "'#'"),
    (None, "'line con 0'"),
    (None, "' exec-timeout ' || (k % 30) || ' 0'"),
    (None, "'line vty 0 4'"),
    (None, "' exec-timeout ' || (5 + k % 10) || ' 30'"),
    (None, "' transport input ' || CASE WHEN k % 8 = 0 THEN 'telnet ssh' ELSE 'ssh' END"),
    (None, "'line vty 5 15'"),
    ("k % 9 = 1", "' exec-timeout ' || (20 + k % 3) || ' 0'"),
    (None, "' transport input ' || CASE WHEN k % 9 = 0 THEN 'telnet' ELSE 'ssh' END"),
    (None, "'logging host 10.9.' || (k % 256) || '.1'"),
    ("k % 10 = 0", "'logging host 10.9.' || (k % 256) || '.2'"),
    ("k % 12 <> 0", "'ntp server 10.8.' || (k % 256) || '.1'"),
    (None, "'snmp-server community public RO'"),
    (None, "'! end of file'"),
]

NXOS: list[Line] = [
    ("s <> 'P'", "'version 9.3(' || (k % 8) || ') Bios:version 05.33'"),
    ("k % 6 <> 0", "'hostname leaf-' || k"),
    (None, "'feature bgp'"),
    (None, "CASE WHEN k % 8 = 0 THEN 'feature telnet' ELSE 'no feature telnet' END"),
    ("k % 3 = 0", "'no ip http server'"),
    (None, "'vrf context management'"),
    (None, "'ip access-list MGMT-IN'"),
    (None, "' 10 permit tcp 198.51.100.0/24 any eq 22'"),
    (None, "' 20 permit tcp 198.51.100.' || (k % 250) || '/32 any eq ssh'"),
    ("k % 7 = 0", "' 25 permit udp addrgroup MON any'"),
    (None, "' 30 deny ip any any log'"),
    (None, "'interface mgmt0'"),
    (None, "' description oob ' || c"),
    (None, "' ip address 10.1.' || (k % 250) || '.2/24'"),
    (None, "' ip access-group MGMT-IN in'"),
    (None, "' no shutdown'"),
    (None, "'interface Ethernet1/' || (1 + k % 48)"),
    (None, "' description to spine ' || (c % 8)"),
    ("k % 4 <> 0", "' ip address 10.10.' || (k % 250) || '.1/30'"),
    ("k % 5 = 0", "' shutdown'"),
    (None, "'line vty'"),
    (None, "' exec-timeout ' || (k % 30)"),
    (None, "'logging server 198.51.100.' || (k % 200) || ' 6 use-vrf management'"),
    (None, "'ntp server 192.0.2.' || (k % 200) || ' use-vrf management'"),
    (None, "'banner motd #keep out#'"),
    ("k % 2 = 0", "'aaa authentication login default group CORP local'"),
]

EOS: list[Line] = [
    ("s <> 'P'", "'! device: sw-' || k || ' (DCS-7050SX3, EOS-4.29.' || (k % 9) || 'F)'"),
    (None, "'!'"),
    (None, "'transceiver qsfp default-mode 4x10G'"),
    ("k % 6 <> 0", "'hostname sw-' || k"),
    (None, "'interface Ethernet' || (1 + k % 48)"),
    (None, "'   description to leaf ' || c"),
    (None, "'   ip address 10.20.' || (k % 250) || '.1/31'"),
    ("k % 4 <> 0", "'management api http-commands'"),
    ("k % 4 <> 0", "'   no shutdown'"),
]

JUNOS_SET: list[Line] = [
    ("s <> 'P'", "'set version 21.4R' || (k % 9)"),
    ("k % 6 <> 0", "'set system host-name srx-' || k"),
    (None, "'set interfaces ge-0/0/0 unit 0 family inet address 10.30.' || (k % 250) || '.1/24'"),
    (None, "'set policy-options prefix-list MGMT 198.51.100.0/24'"),
    (None, "'set policy-options prefix-list MGMT 192.0.2.' || (k % 250) || '/32'"),
    ("k % 10 = 0", "'set policy-options prefix-list MGMT not-a-net'"),
    (None, "'set firewall family inet filter PROTECT term ssh from source-prefix-list MGMT'"),
    (None, "'set firewall family inet filter PROTECT term ssh from protocol tcp'"),
    (None, "'set firewall family inet filter PROTECT term ssh from destination-port [ ssh https ]'"),
    (None, "'set firewall family inet filter PROTECT term ssh then accept'"),
    (None, "'set firewall family inet filter PROTECT term mon from source-address 10.' || (k % 200) || '.0.0/16'"),
    (None, "'set firewall family inet filter PROTECT term mon from protocol udp'"),
    (None, "'set firewall family inet filter PROTECT term mon from destination-port ' || CASE WHEN k % 13 = 0 THEN 'weird' ELSE 'snmp' END"),
    (None, "'set firewall family inet filter PROTECT term mon then log'"),
    (None, "'set firewall family inet filter PROTECT term mon then accept'"),
    (None, "'set firewall family inet filter PROTECT term last then discard'"),
    (None, "'set security zones trust'"),
]

JUNOS_BRACE: list[Line] = [
    (None, "'## Last changed: run ' || k"),
    ("s <> 'P'", "'version 21.4R' || (k % 9) || '.15;'"),
    (None, "'system {'"),
    ("k % 6 <> 0", "'    host-name core-' || k || ';'"),
    (None, "'}'"),
    ("k % 3 = 0", "'/* interfaces below'"),
    ("k % 3 = 0", "'   generated */'"),
    (None, "'interfaces {'"),
    (None, "'    ge-0/0/1 {'"),
    (None, "'        unit 0 {'"),
    (None, "'            family inet {'"),
    (None, "'                address 10.40.' || (k % 250) || '.1/24;'"),
    (None, "'            }'"),
    (None, "'        }'"),
    (None, "'    }'"),
    (None, "'}'"),
    (None, "'policy-options {'"),
    (None, "'    prefix-list MGMT {'"),
    (None, "'        198.51.100.0/24;'"),
    (None, "'        192.0.2.' || (k % 250) || '/32;'"),
    (None, "'    }'"),
    (None, "'}'"),
    (None, "'firewall {'"),
    (None, "'    family inet {'"),
    (None, "'        filter PROTECT {'"),
    (None, "'            term ssh {'"),
    (None, "'                from {'"),
    (None, "'                    source-prefix-list {'"),
    (None, "'                        MGMT;'"),
    (None, "'                    }'"),
    (None, "'                    protocol tcp;'"),
    (None, "'                    destination-port [ ssh https ];'"),
    (None, "'                }'"),
    (None, "'                then accept;'"),
    (None, "'            }'"),
    (None, "'            term mon {'"),
    (None, "'                from {'"),
    (None, "'                    source-address {'"),
    (None, "'                        10.' || (k % 200) || '.0.0/16;'"),
    (None, "'                    }'"),
    (None, "'                    protocol udp;'"),
    (None, "'                    destination-port ' || CASE WHEN k % 13 = 0 THEN 'weird' ELSE 'snmp' END || ';'"),
    (None, "'                }'"),
    (None, "'                then {'"),
    (None, "'                    log;'"),
    (None, "'                    accept;'"),
    (None, "'                }'"),
    (None, "'            }'"),
    (None, "'            term last {'"),
    (None, "'                then discard;'"),
    (None, "'            }'"),
    (None, "'        }'"),
    (None, "'    }'"),
    (None, "'}'"),
    ("k % 17 = 0", "'}'"),
]

# Order priority decides the syntax; every value of the column is used.
PLATFORMS: dict[str, tuple[str, str, str, list[Line]]] = {
    "1-URGENT": ("cisco", "ios", "indent", IOS),
    "2-HIGH": ("cisco", "nxos", "indent", NXOS),
    "3-MEDIUM": ("arista", "eos", "indent", EOS),
    "4-NOT SPECIFIED": ("juniper", "junos", "set_path", JUNOS_SET),
    "5-LOW": ("juniper", "junos", "brace", JUNOS_BRACE),
}


def _render(lines: list[Line]) -> str:
    cells = [text if cond is None else f"CASE WHEN {cond} THEN {text} END" for cond, text in lines]
    return f"concat_ws(chr(10), {', '.join(cells)})"


def _platform_case(index: int) -> str:
    arms = " ".join(f"WHEN '{pr}' THEN '{spec[index]}'" for pr, spec in PLATFORMS.items())
    return f"CASE pr {arms} END"


CONFIG_COLUMNS_SQL = (
    "SELECT k, c, s, pr, d, 'dev-' || k AS device_id, 'dev-' || k || '.cfg' AS file_path, "
    f"{_platform_case(0)} AS vendor, {_platform_case(1)} AS os_family, {_platform_case(2)} AS syntax_mode, "
    "CASE pr " + " ".join(f"WHEN '{pr}' THEN {_render(spec[3])}" for pr, spec in PLATFORMS.items()) + " END AS text "
    f"FROM ({BASE_SQL})"
)

# The same projection as a named relation for the SQL side.
CONFIG_CTE = f"device_config AS ({CONFIG_COLUMNS_SQL})"
BASE_CTE = f"base AS ({BASE_SQL})"


def config_lines_cte(numbered: str = "cfgl") -> str:
    """Rendered lines with their numbers, built from the templates rather than by splitting text."""
    arms = []
    for pr, (_, _, _, lines) in PLATFORMS.items():
        cells = ", ".join(text if cond is None else f"CASE WHEN {cond} THEN {text} END" for cond, text in lines)
        idx = ", ".join(str(i) if cond is None else f"CASE WHEN {cond} THEN {i} END" for i, (cond, _) in enumerate(lines))
        arms.append(
            f"SELECT k, c, s, pr, [x FOR x IN [{cells}] IF x IS NOT NULL] AS ls, "
            f"[x FOR x IN [{idx}] IF x IS NOT NULL] AS ix FROM base WHERE pr = '{pr}'"
        )
    return (
        f"{BASE_CTE}, {numbered} AS (SELECT k, c, s, pr, unnest(ls) AS raw_line, unnest(ix) AS tpl, "
        f"unnest(generate_series(1, len(ls))) AS line_number FROM ({' UNION ALL '.join(arms)}))"
    )


def device_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered configuration per order: ``k, c, s, pr, d, device_id, file_path, …, text``."""
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("s"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_orderdate").alias("d"),
    )
    base = deal_out(base, "k")

    def by_platform(pick) -> Column:
        whole: Column | None = None
        for pr, spec in PLATFORMS.items():
            value = pick(spec)
            cond = F.col("pr") == pr
            whole = F.when(cond, value) if whole is None else whole.when(cond, value)
        return whole

    return base.select(
        "*",
        F.concat(F.lit("dev-"), F.col("k")).alias("device_id"),
        F.concat(F.lit("dev-"), F.col("k"), F.lit(".cfg")).alias("file_path"),
        by_platform(lambda p: F.lit(p[0])).alias("vendor"),
        by_platform(lambda p: F.lit(p[1])).alias("os_family"),
        by_platform(lambda p: F.lit(p[2])).alias("syntax_mode"),
        by_platform(lambda p: F.expr(_render(p[3]))).alias("text"),
    )


def cfg_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: content, platform tags, batch."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id"),
        F.encode("text", "UTF-8").alias("content"),
        F.col("text"),
        F.col("source").alias("vendor"),
        F.col("lang").alias("os_family"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of three kinds: prose, JSON (cut short for error events) and web pages wrapped as XML (cut short for every third)."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("upload_id"),
        F.concat(F.lit("batch-"), F.col("source")).alias("batch_id"),
        F.col("text"),
    )
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("upload_id"),
        F.when(F.col("event_type") == "purchase", "bulk-load").otherwise(F.concat(F.lit("user-"), F.col("user_id"))).alias("batch_id"),
        cut.alias("text"),
    )
    # Every third page lacks its closing tag; the others are well-formed whatever they hold.
    body = F.regexp_replace(F.regexp_replace("html", _NOT_XML, ""), "]]>", "")
    closing = F.when(F.col("page_id") % 3 == 0, "").otherwise("</page>")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("upload_id"),
        F.lit("batch-pages").alias("batch_id"),
        F.concat(F.lit("<page><![CDATA["), body, F.lit("]]>"), closing).alias("text"),
    )
    return docs.unionByName(events).unionByName(pages)


_NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
UPLOADS_CTE = f"""uploads AS (
  SELECT 'doc-' || doc_id AS upload_id, 'batch-' || source AS batch_id, text, false AS broken FROM documents
  UNION ALL SELECT 'evt-' || event_id, CASE WHEN event_type = 'purchase' THEN 'bulk-load' ELSE 'user-' || user_id END,
    CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END, false FROM events
  UNION ALL SELECT 'page-' || page_id, 'batch-pages', '<page><![CDATA[' || replace(regexp_replace(html, '{_NOT_XML}', '', 'g'), ']]>', '') || ']]>' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '</page>' END,
    page_id % 3 = 0 FROM pages)"""


def doc_lines(spark: SparkSession, sf_dir: str, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the documents for which ``where`` holds: ``doc_id, line_number, text`` and the columns ``keep`` of their document."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if where is None else docs.where(where)
    return (
        spread(docs.select("doc_id", "text", *keep), "doc_id")
        .select("doc_id", *keep, F.posexplode_outer(tx.split_lines(F.col("text"))).alias("p", "text"))
        .where(F.col("p").isNotNull())
        .select("doc_id", (F.col("p") + 1).alias("line_number"), "text", *keep)
    )


_NL = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
DOC_LINES_CTE = f"""cfg_line AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_number, unnest(ls) AS text
  FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls
        FROM (SELECT doc_id, string_split({_NL}, chr(10)) AS ls FROM documents)))"""


# Secrets variant: every document line gets the keyword lines appended by its own number.
def doc_lines_secret(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    n, d = F.col("line_number"), F.col("doc_id")
    tail = (
        F.when((d + n) % 7 == 0, F.concat(F.lit(" secret 5 abc"), n))
        .when((d + n) % 7 == 1, F.concat(F.lit(" snmp-server community pub"), n, F.lit(" RO")))
        .when((d + n) % 7 == 2, F.concat(F.lit(" $6$salt$hash"), n))
        .when((d + n) % 7 == 3, F.concat(F.lit(" host 10.0."), n % 256, F.lit(".9 via 8.8."), d % 256, F.lit(".8")))
        .when((d + n) % 7 == 4, F.concat(F.lit(" domain-name site"), n, F.when(d % 2 == 0, ".example").otherwise(".corp")))
        .otherwise("")
    )
    return doc_lines(spark, sf_dir, where).select("doc_id", "line_number", F.concat("text", tail).alias("text"))


SECRET_LINES_CTE = f"""{DOC_LINES_CTE}, sec_line AS (SELECT doc_id, line_number, text || CASE (doc_id + line_number) % 7
    WHEN 0 THEN ' secret 5 abc' || line_number
    WHEN 1 THEN ' snmp-server community pub' || line_number || ' RO'
    WHEN 2 THEN ' $6$salt$hash' || line_number
    WHEN 3 THEN ' host 10.0.' || (line_number % 256) || '.9 via 8.8.' || (doc_id % 256) || '.8'
    WHEN 4 THEN ' domain-name site' || line_number || CASE WHEN doc_id % 2 = 0 THEN '.example' ELSE '.corp' END
    ELSE '' END AS text FROM cfg_line)"""
