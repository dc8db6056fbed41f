"""Exact dedup, SimHash near-dedup, repeated passages, embeddings: against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsift.llm import components as components_module, exact, graph, simhash, substring
from fleetsift.llm.components import components
from tests.llm.helpers import awkward, awkward_rows, brute_components, brute_exact, brute_near, brute_repeats, nothing


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact_groups(spark):
    rows = awkward_rows()
    assert rows_of(exact.exact_groups(awkward(spark, rows))) == brute_exact(rows)
    assert exact.exact_groups(nothing(spark)).count() == 0


def test_exact_levels_part_late_and_carry(spark):
    long = "ab" * 5000
    rows = [(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long[:-1] + "zz"), (None, long + "x "), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gid", F.lit("mine"))
    got = {(r.doc_id, r.group_size): (r.keep_id, r.kept, r._gid) for r in exact.exact_groups(df, carry=["_gid"]).collect()}
    assert got[(None, 3)] == (None, True, "mine") and got[(1, 3)][1:] == (False, "mine") and got[(2, 1)][:2] == (2, True)
    assert got[(None, 1)] == (None, True, "mine")


def test_simhash(spark):
    rows = awkward_rows()
    got = simhash.near_duplicates(awkward(spark, rows)).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == brute_near(rows)
    assert simhash.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_golay_keys_lose_no_link(spark, distance):
    rnd = random.Random(distance)
    prints = {0, -1, 1 << 62}
    for _ in range(150):
        base = rnd.getrandbits(64)
        for _ in range(4):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    want = sorted((a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance)
    got = rows_of(simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance))
    assert got == want and (want or distance == 0)


def test_lists_of_keys_are_never_broadcast(spark, tmp_path, capsys):
    """What Spark takes for small has 85 keys a fingerprint."""
    spark.range(100).select(F.xxhash64("id").alias("fp"), F.col("id").alias("least")).write.parquet(f"{tmp_path}/classes")
    simhash.fingerprint_links(spark.read.parquet(f"{tmp_path}/classes")).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_copies_stage_broadcasts_no_key_lists(spark, monkeypatch, capsys):
    plans, write = {}, simhash.shared_table

    def seen(df, name):
        df.explain()
        plans[name] = capsys.readouterr().out
        return write(df, name)

    monkeypatch.setattr(simhash, "shared_table", seen)
    rows = awkward_rows()
    kept = corpus_pipeline.simhash_near_dedup(spark, awkward(spark, rows), "")
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({i for i, _, c in brute_near(rows) if i == c})
    assert "SortMergeJoin" in plans["simhash-links"] and "Broadcast" not in plans["simhash-links"]


def test_near_copies_stage_passes_no_table_through_the_driver(spark, monkeypatch, capsys):
    """Each of its tables has a row per document, fingerprint or link; Spark would broadcast those under its threshold."""
    plans, write = [], simhash.shared_table

    def seen(df, name):
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df, name)

    monkeypatch.setattr(simhash, "shared_table", seen)
    monkeypatch.setattr(components_module, "shared_table", seen)
    kept = corpus_pipeline.simhash_near_dedup(spark, awkward(spark), "")
    kept.explain()
    kept.collect()
    kept.explain()  # as it ran
    plans.append(capsys.readouterr().out)
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)]
    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    near = np.zeros((len(nodes), len(nodes)), bool)
    for a, b in links:
        if a != b:
            near[nodes.index(a), nodes.index(b)] = near[nodes.index(b), nodes.index(a)] = True
    got = dict(rows_of(components(spark.createDataFrame(links, "u long, v long"))))
    assert got == dict(zip(nodes, brute_components(nodes, near), strict=True))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("first", "group_rows"), [(10, 64), (5, 1000), (20, 7)])
def test_repeated_passages(spark, first, group_rows):
    rows = awkward_rows()
    assert rows_of(substring.remove_repeats(awkward(spark, rows), first=first, group_rows=group_rows)) == brute_repeats(rows)


def test_repeated_passages_edges(spark):
    assert substring.remove_repeats(nothing(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(None, text), (4, text + " tail"), (4, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in substring.remove_repeats(df, with_text=True).collect()}
    assert got == {(None, 25): (0, text), (4, 26): (25, "tail"), (4, 1): (0, "short")}
    with pytest.raises(ValueError):
        substring.remove_repeats(df, words=30)


def vectors(seed: int = 0) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = rnd.normal(size=16)
            for _ in range(int(rnd.integers(1, 5))):
                rows.append((n, [float(x) for x in (base + rnd.normal(size=16) * rnd.choice([0, 0.02, 0.08])).astype(np.float32)], label))
                n += 1
        ball = rnd.normal(size=16)
        for _ in range(80):
            rows.append((n, [float(x) for x in (ball + rnd.normal(size=16) * 0.05).astype(np.float32)], label))
            n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [float("inf")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0] * 4, 0), rows[0], (n + 7, [3 * x for x in rows[5][1]], rows[5][2])]
    return rows


@pytest.mark.parametrize("shard", [120, 8192])
def test_embedding_links(spark, shard):
    rows = vectors()
    ok = lambda v, y: v is not None and y is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    near = np.zeros((len(rows), len(rows)), bool)
    for i, (_, v, y) in enumerate(rows):
        for j, (_, w, z) in enumerate(rows):
            if i != j and ok(v, y) and ok(w, z) and y == z and len(v) == len(w):
                near[i, j] = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98
    component = brute_components([r[0] for r in rows], near)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x")).withColumn("shard", F.lit(1))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in graph.near_vectors(df, graph.Settings(shard=shard, overlap=3)).collect())
    want = sorted((r[0], int(n.sum()), c, r[0] == c) for r, n, c in zip(rows, near, component, strict=True))
    assert len(got) == len(want) and all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= (0.9 if shard == 120 else 0.999) * sum(w[1] for w in want)
    if shard == 8192:
        assert got == want
    assert graph.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("shard", "rows"), [(20, 400), (64, 500)])
def test_embedding_links_of_a_split_label_are_whole(spark, shard, rows):
    """Overlap by default: a near-equal group many times a shard, groups across cells, isolated pairs and one direction in many lengths."""
    rng = np.random.default_rng(shard)
    ball = rng.normal(size=8) + rng.normal(size=(rows // 2, 8)) * 0.06
    base = rng.normal(size=(rows // 4, 8))
    line = rng.normal(size=8) * np.arange(1, rows // 8 + 1)[:, None]
    x = np.concatenate([ball, base, base + rng.normal(size=base.shape) * 0.05, line])
    x = np.concatenate([x, x[:3]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    ids = [int(i) for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    classes = graph.near_vectors(df, graph.Settings(shard=shard))
    want = sorted(zip(ids, near.sum(axis=1).tolist(), brute_components(ids, near), strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in classes.collect()) == want


def test_a_dense_label_larger_than_a_shard_at_the_default_settings(spark):
    """Links of some vectors of a near-equal group that is cut into cells, counted by brute force; no pair is listed."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=32) + rng.normal(size=(4500, 32)) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r for r in graph.near_vectors(spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")).collect()}
    assert len(got) == len(x) and {r.component_id for r in got.values()} == {0}
    for i in range(0, len(x), 45):
        assert got[i].n_links == (unit @ unit[i] >= 0.98).sum() - 1


def test_pruning_keeps_what_a_plain_loop_keeps():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centre, found = np.arange(40), rng.integers(-1, 60, size=(40, 24))
    got = graph.prune(x, centre, found, 6, 1.2)
    for c, candidates, kept in zip(centre, found, got, strict=True):
        want, far = [], lambda a, b: 2 - 2 * float(x[a] @ x[b])
        for v in sorted({int(v) for v in candidates} - {-1, int(c)}, key=lambda v: far(c, v)):
            if len(want) < 6 and all(1.44 * far(w, v) > far(c, v) for w in want):
                want.append(v)
        assert kept.tolist() == want + [-1] * (6 - len(want))


def test_building_a_graph_compares_few_empty_places(monkeypatch):
    """Most nodes get few edges back from a batch; the room for many is not paid for by each of them."""
    x = np.random.default_rng(8).normal(size=(1500, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    places, prune = [], graph.prune

    def counted(x, centre, found, degree, alpha):
        places.append((found.size, (found >= 0).sum()))
        return prune(x, centre, found, degree, alpha)

    monkeypatch.setattr(graph, "prune", counted)
    graph.build(x, graph.Settings())
    size, filled = np.array(places).sum(axis=0)
    assert filled > 0.75 * size
