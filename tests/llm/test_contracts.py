"""Language features and scores, loose personal-data spans, the language stage: against plain versions."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fleetsift.llm import langid, pii


def test_letters_are_category_l():
    for c in ["½", "²", "①", "Ⅷ", "٣", "_", "7", "́", "é", "中", "ʰ", "ß", "ª", "𝒳", "ǅ", "א"]:
        assert langid.has_letter(f"1 {c} 2") == unicodedata.category(c).startswith("L"), c
    assert not langid.has_letter("½ 12") and not langid.has_letter(None) and not langid.has_letter("")


def plain_buckets(text: str, dims: int) -> Counter:
    """Every 1- to 3-gram of the lower-cased text by itself, hashed one by one."""
    codes, shift, found = [ord(c) for c in text.lower()], 32 - (dims.bit_length() - 1), Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for k, c in enumerate(codes[i : i + n], 1):
                h = (h + c + k) * 2654435769 & 0xFFFFFFFF
                h ^= h >> 15
            found[(h * 2246822519 & 0xFFFFFFFF) >> shift] += 1
    return found


def test_language_scores_are_those_of_plain_counts(spark):
    rnd, dims = random.Random(3), 1 << 10
    texts = ["".join(rnd.choices("abcé üß中ñ1.", k=rnd.randint(0, 60))) for _ in range(80)] + ["", "a", "ab", None, "É" * 500]
    df, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text", dims)
    said = [t for t in texts if langid.has_letter(t)]
    want = Counter(b for t in said for b in plain_buckets(t, dims))
    assert n == len(said) and df.tolist() == [want[b] for b in range(dims)]
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y", "z"], rng.normal(size=(dims, 3)).astype(np.float32), rng.normal(size=3), 1.7)
    rows = {r.text: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(t,) for t in said], "text string"), model).collect()}
    for t in said:
        counts = plain_buckets(t, dims)
        z = (sum(model.weights[b].astype(float) * c for b, c in counts.items()) / sum(counts.values()) + model.bias) / 1.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[t][0] == model.languages[int(p.argmax())] and abs(rows[t][1] - p.max()) < 1e-6


def test_language_is_predicted_once_under_filters(spark):
    """A second prediction takes a second Python worker per task, with all that it keeps."""
    dims = 1 << 10
    model = langid.Model(["x", "y"], np.random.default_rng(5).normal(size=(dims, 2)).astype(np.float32), np.zeros(2), 1.0)
    texts = ["one two three", "un deux trois", "123", "", None, "eins zwei"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = langid.predict(docs, model)
    for rows in (found, found.filter("lang_pred <> 'und'"), found.filter("lang_pred <> 'und' AND score >= 0.5").select("doc_id", "lang_pred", "score")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    said = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert len(said) == len(texts) and {i for i, (k, _) in said.items() if k == "und"} == {2, 3, 4}
    assert {r.doc_id: (r.lang_pred, r.score) for r in found.filter("lang_pred <> 'und'").collect()} == {i: x for i, x in said.items() if x[0] != "und"}


def test_language_stage_rejects_unlearned_languages(spark):
    """A language that no label names, and symbols, go; documents of the learned ones stay."""
    rnd = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("_lang", F.lit("mine"))
    say = lambda parts: " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(60))
    odd = [(100_000 + i, say(["жив", "ущи", "ник"]), None) for i in range(20)] + [(200_000 + i, "".join(rnd.choices("½→≠¤✓ 7", k=200)), "en") for i in range(5)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"), allowMissingColumns=True)
    stage = corpus_pipeline.language_id(spark, both, "")
    left = {r.doc_id for r in stage.collect()}
    clean = {r.doc_id for r in docs.filter("text RLIKE '[a-zA-Z]' AND lang IS NOT NULL").collect()}
    assert stage.columns == both.columns and not left & {i for i, *_ in odd}
    assert len(left & clean) >= 0.99 * len(clean)
    model = langid.learn(both)
    bound = langid.least_score(both, model)
    assert 1 / len(model.languages) < bound < 1 and langid.least_score(both.limit(0), model) == 0
    assert corpus_pipeline.language_id(spark, both.filter("lang IS NULL"), "").count() == 0


def plain_loose(text: str) -> list[tuple[str, int, int]]:
    """Loose candidates in their order, each kept if it overlaps none of the base spans and none kept before."""
    found = []
    for m in pii._AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in pii._LOCAL:
            start -= 1
        d = pii._DOTS.match(text, m.end())
        if start < m.start() and d:
            found.append(("email", start, d.end()))
    for kind, rx in (("ip", pii._IP6), ("phone", pii._NATIONAL), ("name", pii._NAME)):
        found += [(kind, m.start(), m.end()) for m in rx.finditer(text)]
    kept: list[tuple[str, int, int]] = []
    for k, s, e in found:
        if all(b <= s or e <= a for _, a, b in [*pii.strict_spans(text), *kept]):
            kept.append((k, s, e))
    return kept


def test_loose_spans_touch_nothing():
    rnd = random.Random(4)
    parts = ["Mr Smith", " [at] ", "example", " [dot] ", "com", " ", "555-123-4567", "(555) 123-4567", "a@b.cc", "10.0.0.1", "1:2:3:4:5", ", ", "(at)", "Dr. Anna Müller", "+49 30 901820"]
    for _ in range(4000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 14)))
        assert pii.loose_spans(text, pii.strict_spans(text)) == plain_loose(text)
    crowded = "555-123-4567 555-123-4568 555-123-4569 555-123-4560 Mr Smith [at] example [dot] com"
    spans = sorted((s, e) for _, s, e in pii.loose_spans(crowded, []))
    assert len(spans) == 5 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert pii.loose_spans("a" * 100 + " [at] x [dot] com", []) == [("email", 0, 117)]


def test_all_spans_are_those_the_classifier_keeps(spark):
    """The likelihoods written into the plan are those of the trained classifier, for base and added spans."""
    rnd = random.Random(6)
    parts = ["call 555-123-4567", "version 555-123-4568.", "Dr. Anna Müller", "dear Mr Smith", "jo [at] mail [dot] com", "x [at] y [dot] zz", "a@b.com", "10.0.0.1", "page 1:2:3:4:5", "host 1:2:3:4:5:6", "words", "+49 30 901820", "\n"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(0, 8))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shape = lambda t, k, s, e, strict: (pii.votes(t, k, s, e, strict), pii.KINDS.index(k), pii.traits(t, s, e))
    spans = {i: [(k, s, e, f) for f, found in ((True, pii.strict_spans(t)), (False, pii.loose_spans(t, pii.strict_spans(t)))) for k, s, e in found] for i, t in enumerate(texts) if t}
    tally = Counter(shape(texts[i], *x) for i, found in spans.items() for x in found)
    codes = np.array(list(tally))
    judged = pii.train(codes[:, 0], codes[:, 1], codes[:, 2], np.array(list(tally.values()), float))
    likely = dict(zip(tally, judged.likelihood(codes[:, 0], codes[:, 1], codes[:, 2]), strict=True))
    got = {r.doc_id: r.found for r in pii.find_personal_data(df).collect()}
    assert len(got) == len(texts)
    added = 0
    for i, t in enumerate(texts):
        want = sorted((pii.KINDS.index(k), s, e) for k, s, e, f in spans.get(i, []) if f or likely[shape(t, k, s, e, f)] >= 0.5)
        assert [(x.kind, x.start, x.end) for x in got[i]] == want
        assert all(abs(x.likelihood - likely[shape(t, pii.KINDS[x.kind], x.start, x.end, x.strict)]) < 1e-6 for x in got[i])
        added += sum(not x.strict for x in got[i])
    assert added
