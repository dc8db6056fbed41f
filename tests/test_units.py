"""Hand-made cases for operators whose edge values the given tables do not hold."""

from __future__ import annotations

import io
import ipaddress
import random
import zipfile

import pytest
from pyspark.sql import Row, functions as F

from fleetsift.functions import conditions as cond, netaddr, secrets, shape
from fleetsift.functions import text as tx
from fleetsift.operators import acl, baseline, detect, evaluate, frameworks, ingest, learn, ledger, reads, remediation, scan, structures, tree
from fleetsift.plans import load_all
from fleetsift.plans.registry import QUERIES
from fleetsift.sources import catalogs, files, packs, sinks, tables
from fleetsift.streaming import landing
from tests.conftest import SF


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_decode_every_encoding(spark):
    text = "hostname é\nend"
    blobs = [text.encode("utf-8"), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"),
             b"\xff\xfe\x00\x00" + text.encode("utf-32-le"), b"\x00\x00\xfe\xff" + text.encode("utf-32-be"), text.encode("cp1252"), b"abc\x81\xff"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    rows = ingest.decode(df).orderBy("i").collect()
    assert [r.encoding for r in rows] == ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "cp1252", None]
    assert [r.text for r in rows[:7]] == [text] * 7 and rows[7].text is None


def test_lines_keep_form_feed_and_drop_final_terminator(spark):
    got = column(spark, ["a\r\nb\rc\n", "", "a\x0bb\x0c", "x\n\n"], tx.split_lines)
    assert got == [["a", "b", "c"], [], ["a\x0bb\x0c"], ["x", ""]]


def test_printable_and_sniff(spark):
    assert column(spark, ["abc\t\n", "\x00\x01ab", "a\u00a0"], tx.printable_ratio) == [1.0, 0.5, 0.5]
    assert column(spark, ["  <a/>", "[1]", "{", "hostname", ""], tx.sniff_format) == ["xml", "json", "json", "cli", "cli"]


def test_cidr_matches_the_standard_library(spark):
    cases = ["10.1.2.3/8", "10.1.2.3", "0.0.0.0/0", "::/0", "2001:db8::1/33", "2001:db8:0:0:1:0:0:1/128", "fe80::1", "1:2:3:4:5:6:7:8/61", "::1/128", "1::/16",
             "10.0.0.0/33", "not", "1::2::3/64", "10.0.0/8", "300.1.1.1", "12345::/16"]
    def want(c):
        try:
            return str(ipaddress.ip_network(c, strict=False))
        except ValueError:
            return None
    assert column(spark, cases, netaddr.cidr_text) == [want(c) for c in cases]


def test_wildcards_and_ports(spark):
    df = spark.createDataFrame([("10.1.2.3", "0.0.0.255"), ("10.1.2.3", "0.0.0.254"), ("10.1.2.3", "255.255.255.255"), ("x", "0.0.0.0")], "a string, w string")
    assert [r[0] for r in df.select(netaddr.wildcard_to_cidr(F.col("a"), F.col("w"))).collect()] == ["10.1.2.0/24", None, "0.0.0.0/0", None]
    assert column(spark, ["443", "HTTPS", "70000", "weird", "0"], netaddr.port_number) == [443, 443, None, None, 0]
    ops = spark.createDataFrame([("lt", 0, 0), ("gt", 65535, 0), ("neq", 22, 0), ("range", 5, 4), ("range", 4, 5)], "op string, lo int, hi int")
    got = [r[0] for r in ops.select(netaddr.port_interval(F.col("op"), F.col("lo"), F.col("hi"))).collect()]
    assert [g and tuple(g) for g in got] == [(0, 0), (65535, 65535), (22, 22), None, (4, 5)]


def test_scrub_is_idempotent(spark):
    cases = ["enable secret 5 abc", "username a password 7 0822", "snmp-server community public RO", "x $6$salt$hash y", "no secrets here", "key <redacted>"]
    once = column(spark, cases, secrets.scrub_line)
    assert once == ["enable secret 5 <redacted>", "username a password 7 <redacted>", "snmp-server community <redacted> RO", "x <redacted> y", "no secrets here", "key <redacted>"]
    assert column(spark, once, secrets.scrub_line) == once


@pytest.mark.parametrize(("line", "flagged"), [
    ("snmp-server community S3cret RO", True), ("snmp-server community public ro", False), ("set snmp community S3cret authorization", True),
    ("    community S3cret {", True), ("    community S3cret;", True), ("    community public {", False), ("! prose about community", False), ("snmp community-string S3cret", True),
])
def test_community_gate(spark, line, flagged):
    assert bool(column(spark, [line], secrets.community_problems)[0]) is flagged


def test_signature_and_generic(spark):
    got = column(spark, ["ip address 10.0.0.1 255.0.0.0", "version 17.9", "interface Gi0/1", "10 20", " ".join("abcdefghijklmnopqrstuvwxyz")], shape.signature)
    assert got[:4] == ["ip address <IP> <IP>", "version <VER>", "interface <IF>", "<N> <N>"] and got[4].endswith(" x ...")
    assert column(spark, got, shape.is_generic) == [False, False, False, True, False]


def test_conditions_on_mixed_shapes(spark):
    df = spark.sql("select 'bool' value_type, true v_bool, cast(null as double) v_num, cast(null as string) v_str, cast(null as array<string>) v_list")
    conds = [("equals", True), ("equals", 1), ("in", [1, 2]), ("in", ["a"]), ("gt", 0), ("contains", "a"), ("is_false",)]
    got = df.select(cond.outcomes(F.array(*[cond.condition(*c) for c in conds]))).first()[0]
    assert got == [True, None, True, False, None, None, False]


def test_literal_block_and_nested_indent(spark):
    text = "interface a\n ip x\n  deep y\n back z\nbanner motd #\nfree text\n#\nend"
    df = detect.with_lines(spark.createDataFrame([(1, "ios", "indent", text)], "k int, os_family string, syntax_mode string, text string"))
    rows = tree.build_tree(df, ["k"]).orderBy("line_number").collect()
    assert [r.depth for r in rows] == [0, 1, 2, 1, 0, None, None, 0]
    assert rows[2].block_path == ["interface a", "ip x"] and rows[2].path_lines == [1, 2] and rows[5].reason == "literal block body"


def test_brace_and_flat_lines(spark):
    brace = "a {\n  b x;\n  c {\n    d;\n  }\n  /* e\n f */\n}\n}\n## g\n"
    df = detect.with_lines(spark.createDataFrame([(1, "junos", "brace", brace), (2, "junos", "set_path", "set a\n\n set b"), (3, "junos", "brace", "")], "k int, os_family string, syntax_mode string, text string"))
    rows = {(r.k, r.line_number): r for r in tree.build_tree(df, ["k"]).collect()}
    assert [(rows[1, n].text, rows[1, n].depth, rows[1, n].parent_line) for n in (1, 2, 3, 4)] == [("a", 0, None), ("b x", 1, 1), ("c", 1, 1), ("d", 2, 3)]
    assert [rows[1, n].reason for n in range(5, 11)] == ["block terminator", "block comment", "block comment", "block terminator", "unmatched closing brace", "blank line"]
    assert [(rows[2, n].text, rows[2, n].depth) for n in (1, 3)] == [("set a", 0), ("set b", 0)] and rows[2, 2].reason == "blank line"
    assert len(rows) == 13 and [r.k for r in tree.walk_files(df, ["k"]).where("size(nodes) = 0").collect()] == [3]


MODEL_FILES = {
    "ios": ("cisco", "ios", "indent", """hostname r1
interface Gi0
 description  up link
 ip address 10.0.0.1 255.0.0.0
 no shutdown
 shutdown
 speed auto
 ip access-group IN in
interface Lo9
ip access-list extended IN
 remark why
 permit tcp any host 10.0.0.9 eq 443
ip access-list extended BAD
 permit tcp any any eq 70000
 deny ip any any
banner motd #"""),
    "set": ("juniper", "junos", "set_path", """set firewall family inet filter F term a from source-prefix-list MG
set firewall family inet filter F term a then accept
set firewall family inet filter F term b then discard
set firewall family inet filter G term a from hop-limit 3
set firewall family inet filter G term a then accept
set policy-options prefix-list MG 10.0.0.0/8
set policy-options prefix-list MG nonsense
set policy-options prefix-list UNUSED 10.1.0.0/16"""),
    "brace": ("juniper", "junos", "brace", """policy-options {
 prefix-list P {
  10.2.0.0/16;
 }
}
firewall {
 family inet {
  filter F {
   term t {
    from {
     source-address {
      10.0.0.0/8;
      10.3.0.0/16;
     }
     destination-port [ 22 443 ];
    }
    then accept;
   }
  }
  filter H {
   term u {
    from { protocol tcp; }
   }
  }
 }
}"""),
    "none": ("cisco", "ios", "indent", ""),
    "remarks": ("cisco", "ios", "indent", "! only\n!"),
}


def test_file_model(spark):
    """Interfaces, lists, filters, prefix lists and what is left, of all syntaxes in one pass."""
    df = detect.with_lines(spark.createDataFrame([(k, *v) for k, v in MODEL_FILES.items()], "k string, vendor string, os_family string, syntax_mode string, text string"))
    model = {r.k: r for r in structures.file_model(df, ["k", "vendor", "os_family"], packs.PATTERNS).collect()}
    assert set(model) == set(MODEL_FILES) and all(not model[k][c] for k in ("none", "remarks") for c in ("interfaces", "lists", "prefix_lists", "facts", "residue"))
    gi, lo = model["ios"].interfaces
    assert (gi.name, gi.description, gi.addresses, gi.enabled, [tuple(a) for a in gi.applied], gi.block_line) == ("Gi0", "up link", ["10.0.0.1"], False, [("IN", "in")], 2)
    assert (lo.name, lo.enabled, lo.addresses, lo.evidence_lines) == ("Lo9", None, [], 1)
    ok, bad = model["ios"].lists
    assert (ok.acl_name, ok.failure, [(i.e.action, i.e.dst.cidrs, tuple(i.e.dst_port)) for i in ok["items"]]) == ("IN", None, [("permit", ["10.0.0.9/32"], (443, 443))])
    assert tuple(bad.failure) == (14, "permit tcp any any eq 70000", "unknown_port")
    assert [r.line_number for r in model["ios"].residue] == [1, 7, 13, 14, 15] and [f.hit.field for f in model["ios"].facts] == ["banner_present"]
    f, g = model["set"].lists
    assert [(i.e.action, i.e.src.kind, i.e.src.cidrs) for i in f["items"]] == [("permit", "object", ["10.0.0.0/8"]), ("deny", "any", [])] and f.failure is None
    assert tuple(g.failure) == (4, "term a", "unread_clause") and [r.line_number for r in model["set"].residue] == [4, 5, 8]
    f, h = model["brace"].lists
    assert [(i.e.src.cidrs, i.e.dst_port.lo) for i in f["items"]] == [(["10.0.0.0/8", "10.3.0.0/16"], 22), (["10.0.0.0/8", "10.3.0.0/16"], 443)]
    assert h.failure is not None and {x.name: x.members for x in model["brace"].prefix_lists} == {"P": ["10.2.0.0/16"]}
    assert [(b.acl_name, [tuple(x)[1:3] for x in b.applied_to]) for b in structures.bindings(structures.file_model(df.where("k = 'ios'"), ["k", "vendor", "os_family"]), ["k"]).collect()] == [("IN", [("Gi0", "in")])]


@pytest.mark.parametrize("name", ["p21_residue", "n06_unknown_lines", "n07_device_document", "x02_ios_entries", "x10_all_or_nothing", "x11_bindings"])
def test_structures_take_one_pass(spark, name):
    load_all()
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Relation ["), plan.count("Join ")) == (1, 1, 0)


def test_hundred_thousand_rules_are_a_table(spark):
    """Every applicable pair and its verdict, from a hundred thousand rules over thirty platforms and any."""
    n = 100_000
    ids = spark.range(n).select(F.col("id"), F.concat(F.lit("r"), "id").alias("rule_id"))
    rules = ids.select(
        F.col("id").alias("rule_ord"), "rule_id", F.lit("low").alias("severity"), F.lit("f").alias("field"),
        F.when(F.col("id") % 100 == 0, F.array(F.lit("*"), F.lit("v1"))).otherwise(F.array(F.concat(F.lit("v"), F.col("id") % 30))).alias("vendors"), F.array(F.lit("*")).alias("os_families"),
        F.lit("evaluate").alias("on_absent_default"), F.lit("fail").alias("on_absent_unsupported"), F.lit("unknown").alias("on_capability_unknown"),
    )
    null = lambda t: F.lit(None).cast(t)
    conds = ids.select("rule_id", F.lit(1).alias("ordinal"), F.lit("gt").alias("op"), F.lit("num").alias("kind"), null("boolean").alias("b"), (F.col("id") % 7).cast("double").alias("n"), null("string").alias("s"), null("array<string>").alias("l"), null("array<double>").alias("ln"))
    refs, gaps = ids.where("id % 2 = 0").select("rule_id", F.lit("nist").alias("framework"), F.lit("X").alias("control_id")), ids.limit(0).select("rule_id", F.lit("").alias("framework"), F.lit("").alias("reason"))
    book = evaluate.Rulebook(rules, conds, refs, gaps)
    devices = spark.createDataFrame([(f"d{i}", f"v{i}" if i < 30 else None, "o") for i in range(32)], "device_id string, vendor string, os_family string")
    shape_ = "device_id string, field string, state string, unknown_reason string, value_type string, v_bool boolean, v_num double, v_str string, v_list array<string>, evidence_count int, default_ref string"
    obs = spark.createDataFrame([(f"d{i}", "f", "present", None, "num", None, float(i % 7), None, None, 1, None) for i in range(32) if i != 5], shape_)
    got = {(r.device_id, r.status): r.n for r in evaluate.evaluate_fleet(devices, obs, book).groupBy("device_id", "status").agg(F.count("*").alias("n")).collect()}
    want = {}
    for i in range(32):
        for r in range(n):
            if r % 100 == 0 or (i < 30 and r % 30 == i):
                status = "unknown" if i == 5 else "pass" if i % 7 > r % 7 else "fail"
                want[f"d{i}", status] = want.get((f"d{i}", status), 0) + 1
    assert got == want
    chosen = evaluate.applicable_rules(devices.where("device_id = 'd3'"), book, ["nist"])
    assert chosen.count() == sum((r % 100 == 0 or r % 30 == 3) and r % 2 == 0 for r in range(n)) and evaluate.applicable_rules(devices, book, ["iso"]).isEmpty()


def test_catalog_files(spark, tmp_path):
    texts = {
        "a.yaml": "# c\nframework: nist\ndocument: \"Doc: one\"\nedition: 5.2.0\nnote: x\n  document: folded\ncovers:\n  vendor: cisco\n  os_version: ^17\\.\ncontrols:\n- AC-01\n- AC-02(01)\nwithdrawn:\n- AC-13\n",
        "b.yaml": "framework: cis\nedition: 1\ncontrols:\n- 1.1\n", "c.yaml": "document: d\nedition: 1\ncontrols:\n- 1.1\n",
        "d.yaml": "framework: cis\ndocument: d\nedition: 1\ncontrols: []\n", "e.yaml": "framework: cis\r\ndocument: d\r\nedition: 2\r\ncontrols:\r\n  - 1.1\r\n  - 1.1\r\n", "f.yaml": "x",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = catalogs.read_catalogs(spark, f"file://{tmp_path}")
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in found.collect()} == {"a.yaml": None, "b.yaml": "no_document", "c.yaml": "no_framework", "d.yaml": "no_controls", "e.yaml": "repeated_control", "f.yaml": "no_framework"}
    assert sorted(map(tuple, catalogs.controls(found).collect())) == [("nist", "AC-01", "live"), ("nist", "AC-02(01)", "live"), ("nist", "AC-13", "withdrawn")]
    assert [tuple(r) for r in catalogs.editions(found).collect()] == [("nist", "5.2.0", "Doc: one", "cisco", None, "^17\\.")]
    asked = spark.createDataFrame([("nist", "AC-02(01)"), ("nist", "AC-13"), ("cis", "1.1")], "framework string, control_id string")
    looked = {(r.framework, r.control_id): (r.status, r.citation) for r in frameworks.control_lookup(asked, catalogs.controls(found), catalogs.editions(found)).collect()}
    assert looked == {("nist", "AC-02(01)"): ("live", "Doc: one, edition 5.2.0, control AC-02(01)"), ("nist", "AC-13"): ("withdrawn", "Doc: one, edition 5.2.0, control AC-13"), ("cis", "1.1"): ("unknown", None)}


def brute_kinds(entries):
    def covers(o, i):
        if o["est"] and not i["est"]:
            return False
        parts = [o["proto"] == "ip" or o["proto"] == i["proto"], None, None, o["lo"] <= i["lo"] and i["hi"] <= o["hi"]]
        for at, side in ((1, "src"), (2, "dst")):
            if o[side] is not None and i[side] is not None:
                parts[at] = all(any(n.subnet_of(m) for m in o[side]) for n in i[side])
        return False if False in parts else None if None in parts else True

    out = {}
    for n, e in enumerate(entries):
        if e["src"] is None or e["dst"] is None:
            out[e["seq"]] = "undetermined"
            continue
        results = [(covers(o, e), o["action"] == e["action"]) for o in entries[:n]]
        kind = "shadowed" if (True, False) in results else "redundant" if (True, True) in results else None
        out[e["seq"]] = kind or ("undetermined" if any(r is None for r, _ in results) else None)
    return out


def test_acl_kinds_match_brute_force(spark):
    rng = random.Random(7)
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.1.0/24", "10.2.0.0/16", "10.1.1.5/32", "192.168.0.0/16"]
    rows, model = [], []
    for seq in range(120):
        pick = lambda: rng.choice([None, ["0.0.0.0/0"], rng.sample(nets, 1), rng.sample(nets, 2)])
        src, dst, lo = pick(), pick(), rng.choice([0, 22, 80])
        e = {"seq": seq, "action": rng.choice(["permit", "deny"]), "proto": rng.choice(["ip", "tcp", "udp"]), "lo": lo, "hi": 65535 if lo == 0 else lo + rng.choice([0, 10]), "est": rng.random() < 0.1}
        model.append({**e, **{s: None if v is None else [ipaddress.ip_network(x) for x in v] for s, v in (("src", src), ("dst", dst))}})
        rows.append((1, seq, e["action"], e["proto"], None, "cidr", "cidr", src or [], dst or [], 0, 65535, e["lo"], e["hi"], e["est"], False))
    df = spark.createDataFrame(rows, "acl_id int, seq int, action string, proto string, proto_num int, src_kind string, dst_kind string, sc array<string>, dc array<string>, sp_lo int, sp_hi int, dp_lo int, dp_hi int, established boolean, disabled boolean")
    ready = df.withColumn("src", acl.networks(F.col("src_kind"), F.col("sc"))).withColumn("dst", acl.networks(F.col("dst_kind"), F.col("dc")))
    got = {r.seq: r.kind for r in acl.classify(ready).collect()}
    assert got == brute_kinds(model)


def test_any_to_any_entries_are_told_apart_by_port(spark):
    """Fifty thousand entries that differ by port only: pairs would be 1.25 billion."""
    df = spark.range(50_000).select(
        F.lit(1).alias("acl_id"), F.col("id").cast("int").alias("seq"), F.lit("permit").alias("action"), F.lit("tcp").alias("proto"), F.lit(6).alias("proto_num"), F.lit("any").alias("src_kind"), F.lit("any").alias("dst_kind"),
        F.array().cast("array<string>").alias("none"), F.lit(0).alias("sp_lo"), F.lit(65535).alias("sp_hi"), F.col("id").cast("int").alias("dp_lo"), F.when(F.col("id") == 7, 9).otherwise(F.col("id")).cast("int").alias("dp_hi"),
        F.lit(False).alias("established"), F.lit(False).alias("disabled"),
    )
    ready = df.withColumn("src", acl.networks(F.col("src_kind"), F.col("none"))).withColumn("dst", acl.networks(F.col("dst_kind"), F.col("none")))
    assert sorted((r.seq, r.kind) for r in acl.classify(ready).where("kind is not null").collect()) == [(8, "redundant"), (9, "redundant")]


def test_isotonic_fit_equals_serial_pooling(spark):
    rng = random.Random(3)
    data = sorted((round(rng.random(), 4) + i * 1e-7, rng.random() < 0.5, i) for i in range(400))
    blocks = learn._pool([], [(s, 1.0, float(c)) for s, c, _ in data])
    df = spark.createDataFrame([(s, c, i) for s, c, i in data], "score double, was_correct boolean, id int").repartition(7)
    steps = [(r.threshold, round(r.probability, 9)) for r in learn.fit_steps(df).collect()]
    assert steps == [(s, round(t / w, 9)) for s, w, t in blocks]
    lookups = learn.calibrated(spark.createDataFrame([(-1.0,), (2.0,)], "score double"), learn.fit_steps(df)).collect()
    assert [round(r.probability, 9) for r in lookups] == [steps[0][1], steps[-1][1]]


def test_lookup_takes_the_last_step_below(spark):
    rng = random.Random(4)
    steps = sorted({round(rng.uniform(-0.9, 0.9), 3) for _ in range(30)})
    table = spark.createDataFrame([(t, i / 100, 1.0) for i, t in enumerate(steps)], "threshold double, probability double, weight double")
    asked = [-2.0, -1.0, 1.0, 2.0, *steps, *(rng.uniform(-1, 1) for _ in range(300))]
    got = {r.score: r.probability for r in learn.calibrated(spark.createDataFrame([(x,) for x in asked], "score double"), table, cells=16).collect()}
    assert got == {x: max([0.0, *(i / 100 for i, t in enumerate(steps) if t <= x)]) for x in asked}


def test_fit_and_lookup_plans_spread(spark):
    df = spark.createDataFrame([(i / 400, i % 3 == 0, i) for i in range(400)], "score double, was_correct boolean, id int")
    plan = learn.calibrated(df, learn.fit_steps(df))._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_fit_merges_ranges_pairwise(spark):
    """A million separable rows are one step below and one above; falling scores merge range by range into one; no task ever gets all."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1_000_000).select((F.col("id") / 1_000_000).alias("score"), (F.col("id") >= 400_000).alias("was_correct"))
        assert [(r.threshold, r.probability, r.weight) for r in learn.fit_steps(rows).collect()] == [(0.0, 0.0, 400_000.0), (0.4, 1.0, 600_000.0)]
        falling = spark.range(100_000).select((F.col("id") / 100_000).alias("score"), (F.col("id") < 30_000).alias("was_correct"))
        assert [(r.threshold, r.probability, r.weight) for r in learn.fit_steps(falling).collect()] == [(0.0, 0.3, 100_000.0)]
        rng = random.Random(9)
        data = [(round(rng.random() ** 2, 3), rng.random()) for _ in range(20_000)]
        mixed = spark.createDataFrame([(s, r < s * (1 - s) * 3) for s, r in data], "score double, was_correct boolean")
        serial = learn._pool([], [(s, float(n), float(c)) for s, n, c in sorted((r.score, r.n, r.c) for r in mixed.groupBy("score").agg(F.count("*").alias("n"), F.count_if("was_correct").alias("c")).collect())])
        assert [(r.threshold, r.weight) for r in learn.fit_steps(mixed).collect()] == [(s, w) for s, w, _ in serial]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lookup_spreads_a_common_score(spark):
    steps = spark.createDataFrame([(0.0, 0.1, 1.0), (0.5, 0.7, 1.0)], "threshold double, probability double, weight double")
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0.5).when(F.col("id") == 0, F.lit(None)).otherwise(F.col("id") / 3000).cast("double").alias("score"))
    got = learn.calibrated(rows, steps)
    assert {(r.id, r.probability) for r in got.collect()} == {(i, None if i == 0 else 0.7 if i % 3 or i >= 1500 else 0.1) for i in range(3000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be merged again
    try:
        assert got.where("score = 0.5").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert learn.calibrated(rows.limit(0), steps).collect() == []


def test_spread_keeps_its_number_of_tasks(spark):
    wide = tables.spread(spark.range(100).withColumn("k", F.col("id") % 50), "k")
    assert wide.mapInArrow(lambda batches: batches, wide.schema).groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.fleetsift.spread")) == 4


def test_equal_text_ranks_first_unless_it_is_named(spark):
    index = spark.createDataFrame([("ntp_servers", "ntp server x", [1.0, 0.0]), ("ssh_version", "ip ssh", [0.0, 1.0])], "field string, text string, vector array<float>")
    asked = spark.createDataFrame([("ntp server x", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [(r.field, r.score) for r in learn.top_candidates(asked, index).orderBy("rank").collect()] == [("ntp_servers", 1.0), ("ssh_version", 0.0)]
    named = asked.withColumn("skip", F.lit("ntp server x"))
    assert [r.field for r in learn.top_candidates(named, index).collect()] == ["ssh_version"]


def test_admins_see_every_run(spark):
    users = spark.createDataFrame([(1, False), (2, False), (9, True)], "user_id int, admin boolean")
    runs = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c"), (9, "d")], "owner_id int, audit_id string")
    got = sorted(map(tuple, reads.visible_runs(users, runs).collect()))
    assert got == [(1, "a"), (1, "b"), (9, "a"), (9, "b"), (9, "c"), (9, "d")]
    assert reads.visible_runs(users.where("not admin"), runs).count() == 2


def test_xml_and_batch_limit(spark):
    bodies = [b"<a><b/></a>", b"<a><b></a>", b"plain text"]
    df = spark.createDataFrame([(str(i), bytearray(b), "x" if i < 2 else "y") for i, b in enumerate(bodies)], "file_path string, content binary, batch_id string")
    assert [r.reason for r in files.ingest_files(df).orderBy("file_path").collect()] == [None, "malformed_xml", None]
    assert [r.reason for r in files.ingest_files(df, batch_limit=1).orderBy("file_path").collect()] == ["batch_limit_exceeded", "batch_limit_exceeded", None]


def test_fit_refuses_small_samples(spark):
    df = spark.createDataFrame([(0.1, True, i) for i in range(10)], "score double, was_correct boolean, id int")
    with pytest.raises(ValueError, match="refusing"):
        learn.fit_steps(df)


def test_bucketed_scans_cross_gaps(spark):
    rows = [("a", s) for s in (0, 1, 5, 25, 26, 90)] + [("b", 3)]
    df = spark.createDataFrame(rows, "k string, seq int")
    got = {(r.k, r.seq): r.prev_seq for r in scan.bucketed_lag(df, "k", "seq", ["seq"], size=10).collect()}
    assert got == {("a", 0): None, ("a", 1): 0, ("a", 5): 1, ("a", 25): 5, ("a", 26): 25, ("a", 90): 26, ("b", 3): None}


def test_components_of_dense_and_random_graphs(spark):
    full = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}") for i in range(30) for j in range(30)], "src string, dst string")
    assert {r.component for r in remediation.cyclic_components(full).collect()} == {"n00"} and [r.cycle for r in remediation.cycles(full).collect()] == ["n00 -> n01 -> n00"]
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    reach = {n: {n} for n in range(40)}
    for _ in range(40):
        for a, b in edges:
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    want = {(n, min(m for m in range(40) if m in reach[n] and n in reach[m])) for n in range(40) if any(m != n and m in reach[n] and n in reach[m] for m in range(40))}
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {(r.node, r.component) for r in remediation.cyclic_components(df).collect()} == want
    for cycle in (r.cycle.split(" -> ") for r in remediation.cycles(df).collect()):
        assert cycle[0] == cycle[-1] and all((int(a), int(b)) in edges for a, b in zip(cycle, cycle[1:], strict=False)) and (int(cycle[0]), int(cycle[0])) in want
    assert remediation.cycles(df.limit(0)).collect() == []


def test_cycles_and_order(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "e")], "src string, dst string")
    assert sorted(r.cycle for r in remediation.cycles(edges).collect()) == ["a -> b -> c -> a", "e -> f -> e"]
    plan = spark.createDataFrame([(1, "x", "high", 1, []), (1, "y", "none", 1, ["x"]), (1, "z", "low", 1, []), (2, "p", "none", 1, ["q"]), (2, "q", "none", 1, ["p"])],
                                 "device_id int, snippet_id string, lockout string, order_hint int, depends_on array<string>")
    got = {(r.device_id, r.snippet_id): r.position for r in remediation.apply_order(plan).collect()}
    assert got == {(1, "z"): 1, (1, "x"): 2, (1, "y"): 3, (2, "p"): None, (2, "q"): None}


def test_archive_guards(spark):
    def pack(names, body=b"x"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, body)
        return out.getvalue()

    cases = {"ok": pack(["a", "d/b"]), "escape": pack(["../a"]), "drive": pack(["C:\\a"]), "bomb": pack(["a"], b"0" * 4_000_000), "many": pack([str(i) for i in range(501)]), "broken": b"PK\x03\x04nothing", "plain": b"hostname a"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "file_path string, content binary")
    got = {}
    for r in files.expand_archives(df).collect():
        got.setdefault(r.file_path, []).append(r.reason or r.member or "plain")
    assert got["ok"] == ["a", "d/b"] and got["plain"] == ["plain"]
    assert [got[k] for k in ("escape", "drive", "bomb", "many", "broken")] == [["archive_unsafe_path"], ["archive_unsafe_path"], ["archive_compression_bomb"], ["archive_too_many_entries"], ["undecodable"]]


def test_sinks_replace_and_refuse(spark, tmp_path):
    path = str(tmp_path / "residue")
    rows = lambda pairs: spark.createDataFrame(pairs, "file_id string, line_number int, text string")
    files_ = lambda *ids: spark.createDataFrame([(i,) for i in ids], "file_id string")
    sinks.replace_residue(rows([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 4, "w")]), files_("a", "b", "c"), path, 1)
    sinks.replace_residue(rows([("a", 9, "new")]), files_("a", "c"), path, 2)
    got = sorted((r.file_id, r.line_number) for r in sinks.current_residue(spark, path).collect())
    assert got == [("a", 9), ("b", 1)]  # c has no unknown line left
    header = spark.createDataFrame([Row(audit_id="r1", run_date="2024-01-01", n=1)])
    with pytest.raises(ValueError, match="no findings"):
        sinks.save_run(header, header.where("false"), str(tmp_path / "runs"))
    sinks.save_run(header, header, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs/finding")).count() == 1


def test_repeated_and_broken_writes_change_nothing(spark, tmp_path, monkeypatch):
    runs, path = spark.createDataFrame([("r1", "2024-01-01", 1), ("r2", "2024-01-02", 2)], "audit_id string, run_date string, n int"), str(tmp_path / "runs")
    found = runs.select("audit_id", "run_date", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("finding_id"))
    read = lambda table: sorted(tuple(r) for r in sinks.read_runs(spark, path, table).select("audit_id", "run_date").collect())
    whole = sinks._commit
    monkeypatch.setattr(sinks, "_commit", lambda keys, where, attempt: whole(keys.limit(0), where, attempt))  # breaks off before the manifest
    sinks.save_run(runs, found, path)
    assert read("audit_run") == read("finding") == []
    monkeypatch.setattr(sinks, "_commit", whole)
    for some in (runs.where("n = 1"), runs, runs):
        sinks.save_run(some, found.join(some.select("audit_id"), "audit_id"), path)
        n = 1 if some is not runs else 2
        assert len(read("audit_run")) == n and len(read("finding")) == 2 * n
    path = str(tmp_path / "residue")
    rows, one = spark.createDataFrame([("a", 1, "x")], "file_id string, line_number int, text string"), spark.createDataFrame([("a",)], "file_id string")
    for version in (1, 2, 2):
        sinks.replace_residue(rows, one, path, version)
    assert sinks.current_residue(spark, path).count() == 1
    path = str(tmp_path / "examples")
    for batch in ("b1", "b2", "b1"):
        sinks.append_examples(runs.withColumnRenamed("run_date", "decided_on"), path, batch)
    assert sinks.read_examples(spark, path).count() == 4


def test_landing_stream_stores_each_file_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.cfg").write_text("version 17.1\nservice timestamps x\nline vty 0 4\n")
    (folder / "b.cfg").write_text("version 17.1\nservice timestamps x\nline vty 0 4\n")
    landing.start(spark, str(folder), target, str(tmp_path / "ck")).awaitTermination()
    (folder / "c.cfg").write_text("hostname other\n")
    landing.start(spark, str(folder), target, str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert sorted(r.outcome for r in rows) == ["detected", "no_signature_matched"]


def test_same_result_on_one_and_many_partitions(spark):
    members = spark.createDataFrame([(f"d{i}", f"h{i}", "c") for i in range(20)], "device_id string, hostname string, cohort string")
    states = spark.createDataFrame([(f"d{i}", "f", "present" if i < 17 else "absent_default", "c") for i in range(20)], "device_id string, field string, state string, cohort string")
    one = {tuple(r) for r in baseline.outliers(members.coalesce(1), states.coalesce(1)).select("device_id", "state").collect()}
    many = {tuple(r) for r in baseline.outliers(members.repartition(8), states.repartition(8)).select("device_id", "state").collect()}
    assert one == many and len(one) == 3


def test_head_state_order(spark):
    log = spark.createDataFrame([(1, 0, "h0"), (1, 1, "h1")], "chain_id int, seq int, entry_hash string")
    head = lambda seq, h, n: spark.createDataFrame([(1, seq, h, n)], "chain_id int, last_seq int, last_hash string, record_count int")
    state = lambda h: ledger.head_state(log, h).first().state
    assert [state(head(*x)) for x in ((2, "h1", 2), (0, "h0", 1), (1, "x", 2), (1, "h1", 3), (1, "h1", 2))] == ["truncated", "lagging", "hash_mismatch", "count_mismatch", "consistent"]


def test_combined_patterns_keep_back_references(spark):
    patterns = [r"^(a)b", r"^(x)(y)\2$"]
    assert column(spark, ["ab", "xyy", "xyx", "zz"], lambda c: tx.matches_any(c, patterns)) == [True, True, False, False]
    assert column(spark, ["zb", "a", "za"], lambda c: tx.matches_any(c, [r"^a|b", r"^q"])) == [True, True, False]
