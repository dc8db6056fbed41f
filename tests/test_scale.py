"""Work is dealt out and stays bounded: tests on rows of their own."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from fleetsift.operators import acl, evaluate as ev, frameworks as fw
from fleetsift.operators.ingest import line_cache
from fleetsift.sources import derived as d, records, sinks


def test_files_of_one_row_group_are_rendered_by_as_many_tasks_as_there_are_cores(spark, tmp_path):
    rows = [(n, n % 7, "O", "1-URGENT", datetime.date(2024, 1, 1)) for n in range(1, 200)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate date")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    was = spark.conf.get("spark.fleetsift.spread")
    spark.conf.unset("spark.fleetsift.spread")  # as on a cluster
    try:
        files = d.device_config(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
        assert sorted(r.k for r in files.select("k").collect()) == list(range(1, 200))
    finally:
        spark.conf.set("spark.fleetsift.spread", was)


def test_records_of_a_batch_are_told_apart_in_slices():
    texts = ["x" * 400, None, "", "y" * 900, "z" * 300, "w"]
    cut = list(records.slices(texts, 500))
    assert [t for some in cut for t in some] == texts
    assert [len(some) for some in cut] == [4, 2]
    assert list(records.slices([], 500)) == []


def test_files_keep_their_own_records_whatever_the_slices(spark):
    pad = "x" * 300_000
    files = spark.range(12).coalesce(1).select("id", F.when(F.col("id") == 5, None).otherwise(F.concat(F.lit("name: n"), "id", F.lit(f"\npad: {pad}\n"))).alias("text"))
    read = files.select("id", records.text_of(records.records(F.col("text"))["head"], "name").alias("name")).collect()
    assert {r.id: r.name for r in read} == {i: None if i == 5 else f"n{i}" for i in range(12)}


ENTRY = (
    "acl_id int, seq int, action string, proto string, proto_num int, src_kind string, dst_kind string, sc array<string>, dc array<string>, "
    "sp_lo int, sp_hi int, dp_lo int, dp_hi int, established boolean, disabled boolean"
)


def _entries(spark):
    """Lists of many lengths with repeated, null and unresolved entries."""
    rng, rows = random.Random(11), []
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.1.0/24", "10.1.1.5/32", "2001:db8::/32"]
    for acl_id in (None, *range(1, 13)):
        for seq in range(1 if acl_id is None else acl_id * 4):
            any_of = lambda: rng.choice([*[("any", [])] * 6, ("object", []), ("cidr", rng.sample(nets, 1)), ("cidr", rng.sample(nets, 2))])
            (sk, sc), (dk, dc), lo = any_of(), any_of(), rng.choice([0, 22, 80])
            row = (acl_id, rng.choice([None, seq, seq, seq]), rng.choice(["permit", "deny", "permit", "deny", None]), rng.choice(["ip", "ip", "tcp", "TCP", "six"]), rng.choice([None, 6]), sk, dk, sc, dc,
                   0, rng.choice([1023, 65535]), lo, 65535 if lo == 0 else lo + 10, rng.choice([False, False, True, None]), False)
            rows += [row] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, ENTRY)
    return df.withColumn("src", acl.networks(F.col("src_kind"), F.col("sc"))).withColumn("dst", acl.networks(F.col("dst_kind"), F.col("dc"))).drop("sc", "dc")


def test_short_and_long_access_lists_are_judged_alike(spark):
    rows = _entries(spark).cache()
    plain = lambda df: sorted(map(str, df.collect()))
    for run in (lambda n: acl.classify(rows, n).drop("src", "dst"), lambda n: acl.causes(rows, "shadowed", n), lambda n: acl.causes(rows, "redundant", n), lambda n: acl.covering_counts(rows, n)):
        in_rows, by_shape, both = (plain(run(n)) for n in (1000, 0, 20))
        assert in_rows and in_rows == by_shape == both


def test_entries_dealt_out_by_list_do_not_move_again(spark):
    rows = _entries(spark).where("acl_id is not null").repartition(7, "acl_id")
    for df in (acl.classify(rows), acl.causes(rows, "shadowed"), acl.causes(rows, "redundant"), acl.covering_counts(rows)):
        plan = df.where("acl_id is not null")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2, plan  # the dealing out itself, and that of entries of no list


def test_cited_text_is_looked_up_from_what_was_kept_of_the_pointers(spark):
    """The broadcasts of frequent keys may time out: nothing that the pointers are made of may stand below them."""
    pointers = spark.range(40).select(F.concat(F.lit("f"), "id").alias("finding_id"), F.lit(0).alias("ordinal"), (F.col("id") % 3).alias("file_id"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    lines = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 1, None), (3, 1, "b")], "file_id bigint, line_number int, text string")
    hashed = lines.select("file_id", "line_number", F.sha2("text", 256).alias("line_sha256"))
    cache = line_cache(lines.where("text is not null").withColumnRenamed("file_id", "doc_id")).withColumn("line_sha256", F.sha2("text", 256))
    read = sinks.rehydrate(pointers, hashed, cache)
    assert "Range (" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.finding_id, r.text) for r in read.collect()) == sorted((f"f{i}", "a") for i in range(40) if i % 3 < 2)


def _rulebook(spark):
    """Three rules for any platform; the second has two gaps, one of them twice, the third no condition."""
    null = "CAST(NULL AS {})".format
    rules = spark.range(1, 4).selectExpr("id AS rule_ord", "concat('R', id) AS rule_id", "'low' AS severity", "'f' AS field", "array('*') AS vendors", "array('*') AS os_families",
                                         "'pass' AS on_absent_default", "'pass' AS on_absent_unsupported", "'unknown' AS on_capability_unknown")
    conditions = spark.range(1, 3).selectExpr("concat('R', id) AS rule_id", "1 AS ordinal", "'is_true' AS op", "'none' AS kind", f"{null('boolean')} AS b", f"{null('double')} AS n",
                                              f"{null('string')} AS s", "CAST(array() AS array<string>) AS l", "CAST(array() AS array<double>) AS ln")
    refs = spark.createDataFrame([("R1", "nist", "AC-1")], "rule_id string, framework string, control_id string")
    gaps = spark.createDataFrame([("R2", "nist", "a"), ("R2", "nist", "a"), ("R2", "none", "b"), ("R3", "nist", "c"), (None, "nist", "d")], "rule_id string, framework string, reason string")
    return ev.Rulebook(rules, conditions, refs, gaps)


def test_rule_tables_are_not_broadcast(spark):
    devices = spark.createDataFrame([("d1", "cisco", "ios", "17.1"), ("d2", None, None, None)], "device_id string, vendor string, os_family string, os_version string")
    found = fw.gap_reasons(devices, _rulebook(spark))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    nist = {r.device_id for r in fw.coverage(devices).where("framework = 'nist' AND coverage = 'covered'").collect()}
    assert nist and sorted(map(tuple, found.collect())) == sorted((d, "R2", "nist", "a") for d in nist for _ in range(2))


def test_findings_of_rule_tables_are_made_without_broadcasting_the_rules(spark):
    devices = spark.range(3).select(F.concat(F.lit("d"), "id").alias("device_id"), F.lit("cisco").alias("vendor"), F.lit("ios").alias("os_family"))
    pairs = ev.applicable_rules(devices, _rulebook(spark))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.device_id, r.rule_id) for r in pairs.select("device_id", "rule_id").collect()) == sorted((f"d{i}", f"R{k}") for i in range(3) for k in (1, 2))
