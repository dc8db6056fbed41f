"""Quality classifier, source divergence and conversation trie: against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from fleetsift.llm import divergence, quality, trie
from fleetsift.llm.transducer import Vocabulary, build, spans, text_bytes
from tests.llm.helpers import WORDS, awkward, awkward_rows, nothing, sha

# --- quality -----------------------------------------------------------------------------------------------------------------------------


def plain_score(learnt: list[tuple[int, list[float]]], x: list[float], to_pooled: float, to_identity: float, temperature: float) -> float:
    """The discriminant written out with numpy's own covariance, inverse and determinant."""
    a = np.array([v for _, v in learnt])
    y = np.array([k for k, _ in learnt])
    pooled = sum(np.cov(a[y == k].T) * ((y == k).sum() - 1) for k in (0, 1)) / (len(a) - 2)
    scale = np.where(np.sqrt(np.diag(pooled)) > 1e-6, np.sqrt(np.diag(pooled)), 1.0)
    z, logs = np.array(x) / scale, []
    for k in (0, 1):
        cov = ((1 - to_pooled) * np.cov(a[y == k].T) + to_pooled * pooled) / np.outer(scale, scale)
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        gap = z - a[y == k].mean(axis=0) / scale
        logs.append(-0.5 * (gap @ np.linalg.inv(cov) @ gap + np.linalg.slogdet(cov)[1]) + math.log((y == k).sum() + 1))
    return 1 / (1 + math.exp(-max(-500, min(500, (logs[1] - logs[0]) / temperature))))


def labelled(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    """Prose, and shouted, marked or repeated words; one label in thirty is null, one document in five has none."""
    rnd = random.Random(seed)
    say = lambda k: " ".join("".join(rnd.choices("aeioulmnrst", k=rnd.randint(1, 9))) for _ in range(k)) + "."
    spoil = [str.upper, lambda t: t.replace(" ", "*** "), lambda t: " ".join(w for x in t.split() for w in [x] * 5), lambda t: t.replace(" ", " | ")]
    docs, labels = [], []
    for i in range(n):
        text, bad = say(rnd.randint(3, 60)), rnd.random() < 0.3
        docs.append((i, rnd.choice(spoil)(text) if bad else text))
        if i % 5:
            labels.append((i, None if i % 30 == 1 else int(not bad), "x"))
    return docs, labels


def test_quality_is_the_discriminant_of_all_labelled_rows(spark, monkeypatch):
    docs, labels = labelled(1, 400)
    monkeypatch.setattr(quality, "GRID", ((0.3, 0.01),))
    monkeypatch.setattr(quality, "TEMPERATURES", (4.0,))
    got = quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, statistics string")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = {i: q for i, q, _ in labels if q is not None}
    learnt = [(known[i], quality.statistics(t)) for i, t in docs if i in known and not held(i)]
    assert len(got) == len(docs)
    for r in got:
        want = plain_score(learnt, quality.statistics(docs[r.doc_id][1]), 0.3, 0.01, 4.0)
        assert r.held_out == held(r.doc_id) and abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_quality_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = labelled(2, 1500)
    truth = {i: q for i, q, _ in labels if q is not None}
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "w " * 50_000), (None, "a word"), (3, docs[3][1])]
    rows = quality.score_quality(spark.createDataFrame(docs + odd, "doc_id long, text string"), spark.createDataFrame(labels + [(3, 1, "y")], "doc_id long, quality int, score string")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs + odd) and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(test) > 150 and sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    empty = {r.doc_id: r.score for r in rows if r.doc_id in (9001, 9002)}
    assert empty[9001] == empty[9002] and [r.held_out for r in rows if r.doc_id is None] == [False]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (4, None)], "doc_id long, quality int")
    docs = awkward(spark)
    assert quality.score_quality(nothing(spark), none).collect() == []
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    sure = {r.score for r in quality.score_quality(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string"), one).collect()}
    assert len(sure) == 1 and sure.pop() > 0.5


# --- transducer and divergence ------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abéü中", min_size=1, max_size=9), min_size=1, max_size=60), st.integers(1, 20))
def test_transducer_gives_lexicographic_ordinals_and_is_minimal(words, per_shard):
    terms = sorted(w.encode() for w in words)
    blob = build(terms)
    # As many states as there are different sets of rests.
    rests = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in [t[:k] for k in range(len(t) + 1)]}
    assert np.frombuffer(blob, "<i4", 4)[1] == len(rests)
    shards, at = [], 0
    while at < len(terms):  # stretches, cut only where the first eight bytes change
        end = min(len(terms), at + per_shard)
        while end < len(terms) and terms[end][:8] == terms[end - 1][:8]:
            end += 1
        shards.append(("x", terms[at], at, build(terms[at:end])))
        at = end
    vocab = Vocabulary(shards)
    asked = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms] + [b"zz"]
    asked = [t for t in asked if t]
    raw = np.frombuffer(b" ".join(asked), np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in asked[:-1]])
    got = vocab.ordinals(raw, starts, starts + [len(t) for t in asked], "x")
    assert got.tolist() == [terms.index(t) if t in terms else -1 for t in asked]


def test_terms_end_with_their_text():
    texts = ["Ab", "cD é", None, "", "x\x7fY中z9", "tail"]
    raw, bounds = text_bytes(pa.array(["skipped", *texts])[1:])
    starts, ends = spans(raw, bounds)
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "é", "x", "y中z", "tail"]


def plain_divergence(rows: list[tuple], least: int, top: int) -> set[tuple]:
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts = Counter(), defaultdict(Counter)
    for text, lang, source in ((r[1] or "", r[2] or "", r[3] or "") for r in rows):
        found = term.findall(text.translate(lower))
        df.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for (k, t), n in df.items() if k == lang and n >= least]
        total = {s: {t: counts[k, s][t] for t in kept} for k, s in counts if k == lang}
        whole = {t: sum(c[t] for c in total.values()) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in total.items()}, share(whole)
        for s in total:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in total if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if total[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("shard_terms,round_bytes,tile", [(1 << 16, 64 << 20, 64), (7, 400, 2)])
def test_divergence(spark, monkeypatch, shard_terms, round_bytes, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", 4096 if tile == 64 else 5)
    rows = awkward_rows(3) + [(7000 + i, "Same Same tie Tie " + "qa"[i % 2], None, f"z{i % 3}", 1, "b", 1, "g", 2, 3, 4) for i in range(9)]
    got = divergence.source_divergence(awkward(spark, rows), least=4, top=5, shard_terms=shard_terms, round_bytes=round_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == plain_divergence(rows, 4, 5) and len(set(got)) == len(got)


def test_divergence_without_terms(spark):
    rows = [(i, None, "en", f"s{i % 3}", 0, "b", 1, "g", 2, 3, 4) for i in range(6)] + [(9, "alone", "fr", "s0", 0, "b", 1, "g", 2, 3, 4)]
    got = {tuple(r) for r in divergence.source_divergence(awkward(spark, rows)).collect()}
    assert got == plain_divergence(rows, 30, 50) and len(got) == 6 and {r[4] for r in got} == {0}
    assert divergence.source_divergence(nothing(spark)).collect() == []


# --- conversations -----------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string, key string, depth int, keys string, n_convs int"


def plain_trie(turns: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, steps in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - int(math.fmod(c, 20)), [])[:h] + steps[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = {x[: len(y)] for x in below for y in [x] if len(x) > len(k) and len(x) == len(k) + 1}
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in below if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), len(childless), saved, sha(",".join(map(str, sorted(ends[k]))))))
    return sorted(out, key=str)


def some_turns(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    lines = ["", None, "a b  c", "hello\tthere", "yes", "x" * 3000]
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(lines), "k", 1, "s", 2) for c in range(-3, n) for t in range(rnd.randint(1, 5)) if c % 9 != 4]
    rows += [(200, t, "user", f"deep {t}" if t > 6 else "yes", "k", 1, "s", 2) for t in range(60)] + [(201, t, "user", f"deep {t}" if t > 6 else "yes", "k", 1, "s", 2) for t in range(45)]
    rows += [(c, t, "user", "same", "k", 1, "s", 2) for c in range(300, 340) for t in range(4)]
    rows += [(0, None, "system", "first", "k", 1, "s", 2), (0, None, "system", "also", "k", 1, "s", 2), rows[0], rows[0], (None, 1, "user", "nobody", "k", 1, "s", 2)]
    return rows


@pytest.mark.parametrize("most", [1, 64, 1 << 13])
def test_trie(spark, most):
    turns = some_turns(5, 80)
    got = trie.conversation_trie(spark.createDataFrame(turns, TURNS), most)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes[:7]} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(turns)


def test_trie_of_turnless_and_of_nothing(spark):
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its only turn makes way for the absent base's
    got = [tuple(r) for r in trie.conversation_trie(spark.createDataFrame([(c, 1, "user", "gone", "k", 1, "s", 2)], TURNS)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_bands():
    assert trie.bands({}) == [] and trie.bands({0: 5}) == []
    assert trie.bands({1: 100, 2: 50, 3: 2, 9: 1}, 20) == [(2, 9), (1, 2), (0, 1)]
    found = trie.bands({k: 10_000 // k for k in range(1, 400)}, 1 << 13)
    assert found[-1][0] == 0 and all(a[0] == b[1] for a, b in zip(found, found[1:], strict=False))
