"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams (``trigrams.py``).  The index holds the postings of the trigrams that
the rules ask for.  A posting list is intersected by counting, per document and alternative, how many of its trigrams occur; documents with all
of them are candidates and are verified with the expression on the whole text.  A rule without mandatory trigrams reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.llm.common import empty_if_null, shared_table
from fleetsift.llm.trigrams import NOTHING, trigram_query
from fleetsift.session import pin


@dataclass(frozen=True)
class Rule:
    """``pattern``: what to look for; a match counts if group ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0


#: Forms of the three base kinds, then forms published by the issuers of keys.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans (start, end) of a rule's matches, leftmost and not overlapping, in code points, end exclusive; short ones fall away after matching."""
    pattern = F.lit(rule.pattern)
    full = F.regexp_extract_all(text, pattern, F.lit(0))
    group = full if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(full)), full, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("hit")))
    steps = F.zip_with(steps, group, lambda s, g: s.withField("long", F.char_length(g) >= rule.least))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(done: Column, s: Column) -> Column:
        at = done["at"] + s["gap"]
        span = F.struct(at.alias("start"), (at + s["hit"]).alias("end"))
        return F.struct((at + s["hit"]).alias("at"), F.when(s["long"], F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, add, lambda done: done["out"])).otherwise(start["out"])


def postings(docs: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """Inverted index (trigram, key) over the lower-cased texts, for the trigrams that rules ask for."""
    low = pin(docs.select(key, text), "_low", F.lower(F.col(text)))  # once per text, not once per trigram
    there = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select(F.col(key), F.explode(there).alias("trigram")).distinct()


def candidates(index: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rules): for every document that has all trigrams of an alternative of a rule, the rules to verify."""
    rows = [(r.name, f"{r.name}-{i}", t, len(alt)) for r in rules for i, alt in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for t in sorted(alt)]
    wanted = index.sparkSession.createDataFrame(rows, "rule string, alternative string, trigram string, needed int")
    # One row per trigram of a rule: a few dozen, whatever the corpus.
    met = index.join(F.broadcast(wanted), "trigram").groupBy(key, "rule", "alternative", "needed").count()
    return met.filter("count = needed").groupBy(key).agg(F.collect_set("rule").alias("_rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) for every row: ``found`` maps each rule's name to its spans.

    Null text counts as empty, rows with a null id are scanned like all others, repeated rows come out once each, and texts are read whole.
    """
    indexed = [r for r in rules if NOTHING != trigram_query(r.pattern) and frozenset() not in trigram_query(r.pattern)]
    wanted = sorted({t for r in indexed for alt in trigram_query(r.pattern) for t in alt})
    texts = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text)).alias("_text"))
    if indexed:
        hits = shared_table(postings(texts, "doc_id", "_text", wanted), "trigram-postings")
        met = candidates(hits, "doc_id", indexed).withColumnRenamed("doc_id", "_key")
        texts = texts.join(met.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    spans = [F.when(F.array_contains("_rules", r.name), rule_spans(F.col("_text"), r)).otherwise(no_spans) if r in indexed else rule_spans(F.col("_text"), r) for r in rules]
    return texts.select("doc_id", F.struct(*[s.alias(r.name) for s, r in zip(spans, rules, strict=True)]).alias("found"))


def joined(found: str, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of all spans, by start, then kind as listed, comma-joined."""

    def named(i: int, name: str) -> Column:
        return F.transform(F.col(f"{found}.{name}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(name), s["start"], s["end"]).alias("text")))

    parts = [named(i, r.name) for i, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(reduce(F.concat, parts)), lambda s: s["text"]), ",")
