"""Audit of how far the sources of a language differ, on a vocabulary held as minimal acyclic transducers.

Terms in enough documents of their language are kept, sorted, cut into stretches and built into transducers, whose path sums are the terms' ordinals.  All text then
streams through them and is counted again by ordinal.  From there on terms are numbers: blocks of ordinals for the pairs of sources, ordinals for ties.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsift.llm.common import empty_if_null, shared_table
from fleetsift.llm.transducer import Vocabulary, build, spans, stretches, text_bytes

_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms a task remembers before it emits their counts, and bytes of text it looks at together.
REMEMBERED, SLICE_BYTES = 1 << 18, 1 << 21
#: Terms of a shard, about, and bytes of transducers that are sent to the tasks at a time.  A larger vocabulary takes more readings of the text, not more memory.
SHARD_TERMS, ROUND_BYTES = 1 << 16, 64 << 20
#: Ordinals of a block and sources of a tile: pairs are compared in (block, tile, tile).
BLOCK, TILE = 4096, 64
UNIT = 1_000_000_000


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text) -> (lang, term, n), partly added up: in how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):  # one text at a time as Python bytes
                seen.setdefault(lang, Counter()).update(set(_TERM.findall(text.as_buffer().to_pybytes().lower())))
                if sum(map(len, seen.values())) >= REMEMBERED:
                    yield from _emit(seen)
        yield from _emit(seen)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _emit(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in seen.items():
        terms, n = pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, n], names=["lang", "term", "n"])
    seen.clear()


def vocabulary(docs: DataFrame, least: int, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Kept terms and their transducers, a table of both kinds of row: (lang, first, place, term) and (lang, first, place = number of terms, blob).

    Terms are dealt out in order; a task holds a stretch of some ``shard_terms`` of them, and all those that share their first eight bytes.
    """
    kept = shared_table(document_frequencies(docs).filter(F.col("n") >= least).select("lang", "term"), "divergence-kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []
        for b in batches:
            for k, term in zip(b.column("lang").to_pylist(), b.column("term").to_pylist(), strict=True):
                if k != lang and terms:
                    yield from _shard(lang, terms)
                    terms = []
                lang = k
                terms.append(term)
        if terms:
            yield from _shard(lang, terms)

    n = max(1, -(-kept.count() // shard_terms))
    dealt = kept.repartitionByRange(n, "lang", F.substring(F.col("term").cast("binary"), 1, 8)).sortWithinPartitions("lang", "term")
    return shared_table(dealt.mapInArrow(run, "lang string, first binary, place long, term string, blob binary"), "divergence-vocabulary")


def _shard(lang: str, terms: list[str]) -> Iterator[pa.RecordBatch]:
    raw = [t.encode() for t in terms]
    n = len(terms)
    columns = [pa.array([lang] * (n + 1)), pa.array([raw[0]] * (n + 1), pa.binary()), pa.array(range(n + 1), pa.int64()), pa.array([*terms, None], pa.string()), pa.array([None] * n + [build(raw)], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "first", "place", "term", "blob"])


def recount(docs: DataFrame, vocab: DataFrame, round_bytes: int = ROUND_BYTES) -> tuple[DataFrame, DataFrame]:
    """All text through the transducers: (lang, source, ordinal, n), and the stretches (lang, first, terms, offset).

    Transducers travel in rounds of at most ``round_bytes`` (or one shard): a round reads the documents of its languages once.
    """
    spark = docs.sparkSession
    shards = vocab.filter("blob IS NOT NULL").select("lang", "first", F.col("place").alias("terms"), F.octet_length("blob").alias("bytes"), "blob")
    order = W.partitionBy("lang").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    places = shards.select("lang", "first", "terms", "bytes", F.coalesce(F.sum("terms").over(order), F.lit(0)).alias("offset"))
    listed = places.orderBy("lang", "first").collect()  # one row for each shard
    rounds: list[list] = []
    filled = 0
    for s in listed:
        if not rounds or filled + s.bytes > round_bytes:
            rounds.append([])
            filled = 0
        rounds[-1].append(s)
        filled += s.bytes
    counted = []
    for part in rounds:
        langs = sorted({s.lang for s in part})
        low, high = (part[0].lang, bytes(part[0].first)), (part[-1].lang, bytes(part[-1].first))
        here = shards.filter(F.col("lang").isin(langs) & (F.struct("lang", "first") >= F.struct(F.lit(low[0]), F.lit(low[1]))) & (F.struct("lang", "first") <= F.struct(F.lit(high[0]), F.lit(high[1]))))
        offsets = {(s.lang, bytes(s.first)): s.offset for s in part}
        shipped = spark.sparkContext.broadcast([(r.lang, bytes(r.first), offsets[r.lang, bytes(r.first)], bytes(r.blob)) for r in here.select("lang", "first", "blob").collect()])  # round_bytes at most
        counted.append(_count(docs.filter(F.col("lang").isin(langs)), shipped))
    if not counted:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long"), places
    found = counted[0]
    for more in counted[1:]:
        found = found.unionByName(more)
    return shared_table(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "divergence-counts"), places


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of some ``SLICE_BYTES`` of text at a time; a longer text is a slice of its own."""
    ends = np.cumsum([t.as_buffer().size for t in batch.column("text")])
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _count(docs: DataFrame, shipped) -> DataFrame:
    """Counts by ordinal, added up in the tasks as far as ``REMEMBERED`` of them go."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at, where = np.unique(np.concatenate(keys), return_inverse=True)
        return [at], [np.bincount(where, np.concatenate(counts), len(at)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(shipped.value)
        groups: dict[tuple[str, str], int] = {}
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b in (part for batch in batches for part in _slices(batch)):
            pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
            of_text = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            langs = np.array([p[0] for p in pairs], object)
            raw, bounds = text_bytes(b.column("text"))
            starts, ends = spans(raw, bounds)
            text = np.minimum(np.searchsorted(bounds, starts, "right") - 1, len(pairs) - 1)
            for lang in set(langs):
                mine = np.flatnonzero((langs == lang)[text])
                for cut in stretches(len(mine)):
                    at = mine[cut]
                    ordinal = words.ordinals(raw, starts[at], ends[at], lang)
                    known = ordinal >= 0
                    more, n = np.unique(of_text[text[at[known]]] << 40 | ordinal[known], return_counts=True)
                    keys.append(more)
                    counts.append(n)
                    held += len(more)
            if held >= 2 * REMEMBERED:
                keys, counts = merged(keys, counts)
                held = len(keys[0])
                if held >= REMEMBERED:
                    yield _counts(keys, counts, list(groups))
                    keys, counts, held = [keys[0][:0]], [counts[0][:0]], 0
        yield _counts(*merged(keys, counts), list(groups))

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long")


def _counts(found: list[np.ndarray], n: list[np.ndarray], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    keys, counts = found[0], n[0]
    of = keys >> 40
    columns = [pa.array([groups[g][i] for g in of.tolist()], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(keys & ((1 << 40) - 1)), pa.array(counts)], names=["lang", "source", "ordinal", "n"])


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * terms)), exact: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(UNIT).cast("decimal(10,0)") * wide(n + 5), wide(total + 5 * terms)
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``groups`` (lang, number, base, terms, tiles) and ``cells`` (lang, number, ordinal, p, tiles) -> (lang, a, b, value) of every two sources of a language.

    A group is one block of ordinals and two tiles of sources; each source of the tiles comes with its share of terms it lacks, as ordinal -1.
    """
    lacks = groups.select("lang", "number", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(terms - 1, 0) div " + str(BLOCK)))).alias("block"), F.lit(-1).cast("long").alias("ordinal"), F.col("base").alias("p"), "terms", "tiles")
    rows = lacks.unionByName(cells.select("lang", "number", F.expr(f"ordinal div {BLOCK}").alias("block"), "ordinal", "p", "terms", "tiles"))
    tile = F.expr(f"cast(number div {TILE} as int)")
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("tile", "other", "tiles")

    def run(t: pa.Table) -> pa.Table:
        number, ordinal, p = (t.column(c).to_numpy() for c in ("number", "ordinal", "p"))
        block, i, j = (t.column(c)[0].as_py() for c in ("block", "i", "j"))
        width = max(0, min(BLOCK, t.column("terms")[0].as_py() - block * BLOCK))
        lack = ordinal < 0
        sources, first = np.unique(number[lack], return_index=True)
        shares = np.repeat(p[lack][first][:, None], width, axis=1)
        shares[np.searchsorted(sources, number[~lack]), ordinal[~lack] - block * BLOCK] = p[~lack]
        rows_of = [np.flatnonzero(sources // TILE == k) for k in (i, j)]
        a, b, v = [], [], []
        for x in rows_of[0]:
            a.append(np.full(len(rows_of[1]), sources[x]))
            b.append(sources[rows_of[1]])
            v.append(np.abs(shares[rows_of[1]] - shares[x]).sum(axis=1))
        a, b, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, v))
        if i != j:
            a, b, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
        apart = a != b
        lang = pa.array([t.column("lang")[0].as_py()] * int(apart.sum()), pa.string())
        return pa.table({"lang": lang, "a": a[apart].astype(np.int64), "b": b[apart].astype(np.int64), "value": v[apart].astype(np.int64)})

    return rows.groupBy("lang", "block", "i", "j").applyInArrow(run, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, shard_terms: int = SHARD_TERMS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``docs`` (text, lang, source) -> (lang, source, part, item, value, rank).

    ``pair``: item is each other source of the language, value the sum over all kept terms of the difference of shares.  ``term``: item is each kept term that the source has and uses more
    than the language does, value the difference, ``top`` ranks.  Ranks go by value, descending, then by the item's bytes.  Null columns count as empty strings; a language without kept
    terms has pairs of value 0; one source alone has no pair; repeated rows count as often as they occur; an empty table gives no row.  Other columns play no part.
    """
    docs = docs.select(*[empty_if_null(F.col(c)).alias(c) for c in ("lang", "source", "text")])
    vocab = vocabulary(docs, least, shard_terms)
    counts, places = recount(docs, vocab, round_bytes)
    sizes = places.groupBy("lang").agg(F.sum("terms").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumns({"terms": F.coalesce("terms", zero), "total": F.coalesce("total", zero)})
    groups = groups.withColumn("base", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero))
    by_lang = W.partitionBy("lang")
    groups = groups.withColumns({"number": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long"), "whole": F.sum("total").over(by_lang), "tiles": F.expr(f"cast((count(*) over (partition by lang) + {TILE - 1}) div {TILE} as int)")})
    groups = shared_table(groups, "divergence-groups")
    cells = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    named = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = _pairs(groups, cells).join(named, ["lang", "b"]).join(groups.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"])
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))

    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("of_lang"))
    above = cells.join(of_lang, ["lang", "ordinal"]).withColumn("value", F.col("p") - share(F.col("of_lang"), F.col("whole"), F.col("terms"))).filter("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    best = above.select("lang", "source", "ordinal", "value", rank.alias("rank")).filter(F.col("rank") <= top)
    terms = vocab.filter("term IS NOT NULL").join(places.select("lang", "first", "offset"), ["lang", "first"]).select("lang", (F.col("offset") + F.col("place")).alias("ordinal"), F.col("term").alias("item"))
    return pairs.unionByName(best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
