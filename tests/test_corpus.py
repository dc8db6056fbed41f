"""Files of records, label and manifest contracts, and scoring."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetsift.operators import ingest, scan, scoring
from fleetsift.sources import labels, records, sinks

CONFIG = "hostname a\nip ssh version 2\nno ip http server\n"
SHA = hashlib.sha256(CONFIG.encode()).hexdigest()
LABEL = f"""# by hand
corpus_path: x/a.cfg
split: eval
vendor: cisco
os_family: ios   # the family
file_sha256: {SHA}

provenance:
  labelled_by: someone
  labelled_at: 2024-01-02T00:00:00Z
  authored_from: x/a.cfg
  reviewed_by: null
  pattern_author_conflict: true
  conflict_note: >-
    one
    # author

fields:
  - field: ssh_version
    determinability: determinable
    expected_value: 2
    evidence_line: 2
    evidence_text: "ip ssh version 2"
    rationale: 'it''s stated: here'
  - field: ntp_servers
    determinability: determinable
    expected_value: ["10.0.0.1", '10.0.0.2']
    rationale: r
  - field: aaa_enabled
    determinability: not_determinable
    rationale: plain text
      that goes on

verdicts:
  - rule_id: SSH-001
    expected_verdict: pass
    rationale: r
"""


def plain(value):
    return value["items"] if value["kind"] == "list" else value["text"]


def test_records_of_a_file():
    got = records.parse(LABEL.replace("\n", "\r\n"))
    assert got["problem"] is None and plain(got["head"]["os_family"]) == "ios"
    assert plain(got["sections"]["provenance"][0]["conflict_note"]) == "one # author" and got["sections"]["provenance"][0]["reviewed_by"]["kind"] == "null"
    ssh, ntp, aaa = got["sections"]["fields"]
    assert (ssh["expected_value"]["kind"], plain(ssh["evidence_text"]), plain(ssh["rationale"])) == ("int", "ip ssh version 2", "it's stated: here")
    assert plain(ntp["expected_value"]) == ["10.0.0.1", "10.0.0.2"] and plain(aaa["rationale"]) == "plain text that goes on"
    nested = records.parse("snippets:\n  - id: a\n    depends_on:\n      - b\n      - c\n    text: |\n      x\n      y\nplain:\n- one\n- two\n")
    assert plain(nested["sections"]["snippets"][0]["depends_on"]) == ["b", "c"] and plain(nested["sections"]["snippets"][0]["text"]) == "x\ny"
    assert [plain(m[""]) for m in nested["sections"]["plain"]] == ["one", "two"]
    assert records.parse(None) == records.parse("\n# c\n") == {"head": {}, "sections": {}, "problem": None}


@pytest.mark.parametrize("text, line", [("a: 1\na: 2\n", 2), ("  a: 1\n", 1), ("a: [1\n", 1), ("x\n", 1), ("a:\n  - b: 1\n    b: 2\n", 3), ("a: {b: 1}\n", 1), ("a:\n  - b: 1\n - c: 1\n", 3), ("a:\n  b:\n    c: 1\n", 3)])
def test_other_files_are_refused(text, line):
    assert records.parse(text)["problem"] == f"unreadable_line_{line}"


def read(spark, *texts):
    return labels.read_labels(spark.createDataFrame([(f"f{i}", t, 7) for i, t in enumerate(texts)], "file string, text string, split_of int"))


def test_label_contract(spark):
    cases = {
        (): LABEL, (f"unreadable_line_{LABEL.count(chr(10)) + 1}",): LABEL + "  x", ("unknown_key",): LABEL.replace("    evidence_line: 2", "    evidence_line: 2\n    parser_said: 3"),
        ("bad_checksum",): LABEL.replace(SHA, "abc"), ("bad_provenance",): LABEL.replace("labelled_by: someone", "labelled_by: ''"), ("review_not_marked",): LABEL.replace("reviewed_by: null", "reviewed_by: b"),
        ("reviewer_missing",): LABEL.replace("  reviewed_by: null", "  review_status: reviewed"), ("conflict_unexplained",): LABEL.replace("  conflict_note: >-\n    one\n    # author\n", ""),
        ("repeated_field",): LABEL.replace("ntp_servers", "ssh_version"), ("bad_determinability",): LABEL.replace("not_determinable", "perhaps"), ("half_citation",): LABEL.replace("    evidence_line: 2\n", ""),
        ("value_on_undeterminable", "citation_on_undeterminable"): LABEL.replace("    determinability: determinable\n    expected_value: 2", "    determinability: not_determinable\n    expected_value: 2"),
        ("bad_line",): LABEL.replace("evidence_line: 2", "evidence_line: 0"), ("half_citation", "bad_line"): LABEL.replace("evidence_line: 2", "evidence_line: two"),
        ("bad_rationale",): LABEL.replace("rationale: r\nverdicts", "x").replace("'it''s stated: here'", "x" * 601), ("bad_verdict",): LABEL.replace("expected_verdict: pass", "expected_verdict: good"),
        ("not_eval_split",): LABEL.replace("split: eval", "split: dev"),
    }
    found = {r.file: tuple(r.problems) for r in read(spark, *cases.values()).collect()}
    assert [found[f"f{i}"] for i in range(len(cases))] == list(cases)
    empty = read(spark, None, "").select("problems", "fields", "split_of").collect()
    assert all({"no_corpus_path", "no_fields", "bad_provenance"} <= set(r.problems) and r.fields == [] and r.split_of == 7 for r in empty)


def test_label_files_from_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yaml").write_text(LABEL)
    (tmp_path / "deep" / "b.yaml").write_text(LABEL.replace("a.cfg", "b.cfg"))
    (tmp_path / "README.md").write_text("none")
    got = labels.read_labels(records.read_files(spark, f"file://{tmp_path}"))
    assert sorted(r.corpus_path for r in got.where(F.size("problems") == 0).collect()) == ["x/a.cfg", "x/b.cfg"]


def manifest(spark, *entries):
    text = "held_out_vendor: z\nfiles:\n" + "".join(
        f"  - path: {p}\n    split: {s}\n    source_type: synthetic\n    authored_by: t\n    sha256: {SHA}\n    labelled: {'true' if s == 'eval' else 'false'}\n" for p, s in entries
    )
    return labels.read_manifest(spark.createDataFrame([("m", text)], "file string, text string"))


def test_manifest_contract(spark):
    got = manifest(spark, ("a", "eval"), ("b", "other"), ("c", "dev"), ("c", "dev"))
    assert sorted((r.path, tuple(r.problems), r.labelled) for r in got.collect()) == [("a", (), True), ("b", ("bad_split",), False), ("c", ("listed_twice",), False), ("c", ("listed_twice",), False)]
    assert [r.problems for r in labels.read_manifest(spark.createDataFrame([("m", "- x")], "file string, text string")).collect()] == [["unreadable_line_1"]]
    assert labels.read_manifest(spark.createDataFrame([("m", "")], "file string, text string")).count() == 0


def test_labels_are_held_to_their_files(spark):
    named = lambda name, text=LABEL: text.replace("a.cfg", name)
    texts = [
        LABEL, named("dev.cfg"), named("none.cfg"), named("gone.cfg"), named("sealed.cfg"), named("new.cfg"), named("far.cfg").replace("evidence_line: 2", "evidence_line: 4"),
        named("drift.cfg").replace('"ip ssh version 2"', '"ip ssh version 1"'), named("two.cfg"), named("two.cfg"), named("bad.cfg").replace("split: eval", "split: dev"),
    ]
    listed = manifest(spark, *[(f"x/{n}.cfg", "eval") for n in ("a", "gone", "new", "far", "drift", "two", "bad")], ("x/dev.cfg", "dev"), ("x/sealed.cfg", "holdout"))
    lines = CONFIG.splitlines()
    files = spark.createDataFrame([(f"x/{n}.cfg", "0" * 64 if n == "new" else SHA, lines) for n in ("a", "dev", "sealed", "new", "far", "drift", "two", "bad")], "path string, sha256 string, lines array<string>")
    done = scoring.verify(read(spark, *texts), listed, files)
    assert sorted((r.corpus_path[2:-4], r.problem) for r in done.select("corpus_path", "problem").collect() if r.corpus_path != "x/a.cfg") == [
        ("bad", "not_eval_split"), ("dev", "split_mismatch"), ("drift", "citation_drifted"), ("far", "line_out_of_range"), ("gone", "file_missing"), ("new", "file_changed"),
        ("none", "not_listed"), ("sealed", "split_mismatch"), ("two", "labelled_twice"), ("two", "labelled_twice"),
    ]
    assert [r.corpus_path for r in done.where("problem is null").collect()] == ["x/a.cfg"]
    parsed = spark.createDataFrame(
        [("x/a.cfg", "ssh_version", "present", None, 2, None, None, [(2, "")]), ("x/a.cfg", "ntp_servers", "present", None, None, None, ["10.0.0.2", "10.0.0.1"], [(3, "")]), ("x/a.cfg", "aaa_enabled", "unknown", None, None, None, None, [])],
        "path string, field string, state string, v_bool boolean, v_long bigint, v_str string, v_list array<string>, evidence array<struct<line:int,raw_line:string>>",
    )
    got = {r.field: (r.outcome, r.evidence, r.author_conflict) for r in scoring.field_observations(done, parsed).collect()}
    assert got == {"ssh_version": ("correct", "correct", True), "ntp_servers": ("wrong_confident", "not_scored", True), "aaa_enabled": ("correct_abstention", "not_scored", True)}
    none = {r.field: r.outcome for r in scoring.field_observations(done, parsed.limit(0)).collect()}
    assert none == {"ssh_version": "miss", "ntp_servers": "miss", "aaa_enabled": "correct_abstention"}
    found = spark.createDataFrame([], "path string, rule_id string, status string")
    assert [(r.expected, r.actual) for r in scoring.verdict_observations(done, found).collect()] == [("pass", "not_applicable")]


def test_values_are_of_one_kind(spark):
    kind = "struct<kind:string,text:string,items:array<string>>"
    cases = [(("int", "2", None), ("int", "2", None), True), (("str", "2", None), ("int", "2", None), False), (("list", "a,b", ["a", "b"]), ("list", "a,b", ["a,b"]), False),
             (("list", "a", ["a"]), ("list", "a", ["a"]), True), (None, ("int", "2", None), False), (("bool", "true", None), None, False)]
    rows = spark.createDataFrame([(i, e, s) for i, (e, s, _) in enumerate(cases)], f"i int, e {kind}, s {kind}")
    assert [r.same for r in rows.orderBy("i").select(scoring.same_value(F.col("e"), F.col("s")).alias("same")).collect()] == [c[2] for c in cases]


def test_a_line_in_half_the_rows_is_dealt_out(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_number"), F.when(F.col("id") % 2 == 0, "!").otherwise(F.concat(F.lit("l"), "id")).alias("text"))
    lines = rows.select("doc_id", "line_number", F.sha2("text", 256).alias("line_sha256"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "8"), strict=True):
            spark.conf.set(k, v)
        got = ingest.read_back(lines, ingest.line_cache(rows))
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 40_000 and len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
        assert got.join(rows, ["doc_id", "line_number", "text"]).count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_salted_join_is_the_plain_join(spark):
    many = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 50 + ["b", "c", None, None, "d", "d"])], "i int, k string")
    one = spark.createDataFrame([("a", 1), ("b", 2), ("d", None), (None, 9)], "k string, v int")
    frequent = scan.most_frequent(many.groupBy("k").count(), "k", "count", 2)
    assert sorted(r.k for r in frequent.collect()) == ["a", "d"]
    for how in ("inner", "left"):
        want = sorted((r.i, r.k, r.v) for r in many.join(one, "k", how).collect())
        assert sorted((r.i, r.k, r.v) for r in scan.salted_join(many, one, "k", frequent, 4, how).collect()) == want
        assert sorted((r.i, r.k, r.v) for r in scan.salted_join(many, one, "k", frequent.limit(0), 4, how).collect()) == want


def test_pointers_meet_their_text(spark):
    lines = spark.createDataFrame([(1, 1, "x"), (1, 2, "!"), (2, 1, "!")], "doc_id int, line_number int, text string")
    hashed = lines.select(F.col("doc_id").alias("file_id"), "line_number", F.sha2("text", 256).alias("line_sha256"))
    pointers = spark.createDataFrame([("f1", 0, 1, 2, 2), ("f2", 0, 1, 2, 2), ("f2", 1, 2, 1, 1), ("f3", 0, 9, 1, 1), ("f4", 0, 1, 5, 5)], "finding_id string, ordinal int, file_id int, line_start int, line_end int")
    got = sinks.rehydrate(pointers, hashed, ingest.line_cache(lines.where("text = '!'")))
    assert sorted((r.finding_id, r.ordinal, r.text) for r in got.collect()) == [("f1", 0, "!"), ("f2", 0, "!"), ("f2", 1, "!")]
