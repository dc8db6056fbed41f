"""Residue clusters, example index, ranked suggestions, calibration and training decisions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsift.functions import shape
from fleetsift.session import cut_lineage

TOP_K = 3
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
MIN_SAMPLES, MIN_POSITIVES = 200, 20


def clusters(lines: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """Lines grouped by exact signature; sizes are combined map-side, the exemplar is a minimum."""
    signed = lines.withColumn("signature", shape.signature(F.col("text"))).where(F.col("signature") != "")
    per_file = signed.groupBy("signature", file_col).agg(F.count("*").alias("n"), F.min(F.struct("line_number", "text")).alias("first"))
    return per_file.groupBy("signature").agg(
        F.sum("n").alias("size"), F.count("*").alias("file_count"), F.min(F.struct(file_col, "first")).alias("ex")
    ).select(
        shape.cluster_id(F.col("signature")).alias("cluster_id"), "signature", "size", "file_count",
        F.col(f"ex.{file_col}").alias("exemplar_file"), F.col("ex.first.line_number").alias("exemplar_line"), F.col("ex.first.text").alias("exemplar"),
        (~shape.is_generic(F.col("signature"))).alias("is_confirmable"),
    )


def cluster_order() -> list[Column]:
    return [F.col("size").desc(), F.col("file_count").desc(), F.col("signature")]


def example_index(seeds: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Seed pairs and confirmed pairs as one index; blank texts and undecided rows are left out."""
    keep = lambda df, kind: df.where((F.trim("text") != "") & F.col("field").isNotNull()).select(
        F.trim("text").alias("text"), "field", "origin", F.lit(kind).alias("source")
    )
    both = keep(seeds, "seed").unionByName(keep(confirmed, "admin"))
    return both.withColumn("signature", shape.signature(F.col("text")))


def unproven_seeds(index: DataFrame, dev_lines: DataFrame) -> DataFrame:
    """Seed texts that no development file contains."""
    return index.where(F.col("source") == "seed").join(dev_lines.select("text").distinct(), "text", "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; an error when the widths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector width mismatch"))).otherwise(product)


def top_candidates(queries: DataFrame, index: DataFrame, k: int = TOP_K, salts: int | None = None) -> DataFrame:
    """Exact best ``k`` index entries of every query: ``query_id, rank, field, text, score``.

    ``queries``: query_id, vector and, if an entry is to be left out, ``skip``: the text of that entry; nothing else is.
    The index, a dimension, is dealt to blocks of bounded size by the whole entry.  Queries are packed inside their own tasks; each pack meets every
    block once, spread over ``salts`` copies of the block, and only the best ``k`` of each query leave a meeting.  The work is every
    query against every entry, as the question asks; ties go to the lower field, then text.
    """
    blocks = max(1, math.ceil(index.count() / BLOCK_ROWS))
    salts = salts or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "skip" not in queries.columns:
        queries = queries.withColumn("skip", F.lit(None).cast(dict(index.dtypes)["text"]))
    entries = index.groupBy(F.pmod(F.xxhash64("field", "text", "vector"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("field", "text", "vector")).alias("entries"))
    entries = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_ROWS):
                yield pd.DataFrame({"asked": [batch.iloc[at : at + QUERY_ROWS].to_dict("records")]})

    kinds, text_kind = dict(queries.dtypes)["query_id"], dict(index.dtypes)["text"]
    asked = queries.select("query_id", "vector", "skip").mapInPandas(pack, f"asked array<struct<query_id:{kinds},vector:{dict(queries.dtypes)['vector']},skip:{text_kind}>>")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("asked.query_id"), F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for questions, answers in zip(batch["asked"], batch["entries"], strict=True):
                scores = np.array([np.asarray(a["vector"], dtype=np.float64) for a in questions]) @ np.array([np.asarray(x["vector"], dtype=np.float64) for x in answers]).T
                fields, texts = (np.array([x[c] for x in answers]) for c in ("field", "text"))
                tie = np.argsort(np.lexsort((texts, fields)))
                rows = []
                for i, asked_one in enumerate(questions):
                    order = np.lexsort((tie, -scores[i]))
                    if not pd.isna(asked_one["skip"]):
                        order = order[texts[order] != asked_one["skip"]]
                    rows += [(asked_one["query_id"], fields[j], texts[j], scores[i, j]) for j in order[:k]]
                yield pd.DataFrame(rows, columns=["query_id", "field", "text", "score"])

    winners = asked.join(entries, ["block", "salt"]).select("asked", "entries").mapInPandas(best, f"query_id {kinds}, field string, text {text_kind}, score double")
    merged = winners.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "field", "text"))), 1, k).alias("best")
    )
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).alias("rank"), "b.field", "b.text", (-F.col("b.neg")).alias("score")
    )


def suggestions(candidates: DataFrame) -> DataFrame:
    """First candidate of each field after the top cut, ranks renumbered; at most three rows a query."""
    first = candidates.groupBy("query_id", "field").agg(F.min(F.struct("rank", "score", "text")).alias("f"))
    w = W.partitionBy("query_id").orderBy("f.rank")
    return first.select("query_id", F.row_number().over(w).alias("rank"), "field", F.col("f.score").alias("raw_score"))


def confidence_violations(suggested: DataFrame) -> DataFrame:
    """Suggestions that claim a calibrated confidence although none may."""
    return suggested.where(
        (F.col("confidence_method") == "calibrated_similarity") | F.col("calibrated_confidence").isNotNull()
    )


def queue_state(confirmable: Column, has_vector: Column, index_size: Column, ranked: Column) -> Column:
    return (
        F.when(~confirmable, "not_confirmable").when(~has_vector, "model_unavailable").when((index_size == 0) | (ranked == 0), "index_empty").otherwise("ranked")
    )


def decision_problems(decisions: DataFrame) -> DataFrame:
    """Violations of the decision rules.

    ``decisions``: example_id, outcome, accepted_rank, field, shown array<struct<rank,field>>.
    """
    ranks = F.transform("shown", lambda s: s["rank"])
    match = F.try_element_at(F.filter("shown", lambda s: s["rank"] == F.col("accepted_rank")), F.lit(1))
    rejected = F.col("outcome") == "rejected"
    problems = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct(ranks)) < F.size(ranks), "duplicate_rank"),
            F.when(F.col("accepted_rank").isNotNull() & match.isNull(), "rank_not_shown"),
            F.when(match.isNotNull() & (match["field"] != F.col("field")), "accepted_other_field"),
            F.when(rejected & F.col("field").isNotNull(), "rejected_with_field"),
            F.when(~rejected & F.col("field").isNull(), "no_field"),
        )
    )
    rows = decisions.select("example_id", F.explode_outer(problems).alias("problem"))
    return rows.where(F.col("problem").isNotNull())


def top3_hit() -> Column:
    return F.col("field").isNotNull() & F.exists("shown", lambda s: s["field"] == F.col("field"))


# ---- calibration -----------------------------------------------------------------------


def _pool(kept: list[list[float]], blocks: Iterator[tuple[float, float, float]]) -> list[list[float]]:
    """Pool neighbours whose means do not rise: ``kept`` and ``blocks`` are (first score, weight, value sum) in score order."""
    for score, weight, total in blocks:
        kept.append([score, weight, total])
        while len(kept) > 1 and kept[-2][2] * kept[-1][1] >= kept[-1][2] * kept[-2][1]:
            _, w, t = kept.pop()
            kept[-1][1] += w
            kept[-1][2] += t
    return kept


def fit_steps(observations: DataFrame) -> DataFrame:
    """Isotonic step table ``threshold, probability, weight`` of (score, was_correct) rows.

    Observations are counted by score, every range of scores is pooled in its own task, and then neighbouring ranges whose border violates the order are
    pooled two by two, round after round, until all borders rise.  A pooled step stays in the range of its first score, so a task never holds more than two
    ranges, and a range all of whose steps went to its neighbour is gone: a run of falling ranges halves each round.  Pooling is associative, so the result
    is that of one serial pass; steps of equal probability are one step.  Refusal below the sample floors is an error.
    """
    counted = observations.groupBy("score").agg(F.count("*").cast("double").alias("weight"), F.count_if("was_correct").cast("double").alias("total"))
    n, pos = counted.agg(F.sum("weight"), F.sum("total")).first()
    if (n or 0) < MIN_SAMPLES or pos < MIN_POSITIVES:
        raise ValueError(f"refusing to fit a calibrator on {n or 0:.0f} observations, {pos or 0:.0f} of them correct")

    def pool_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[float]] = []
        for b in batches:
            kept = _pool(kept, zip(b["score"], b["weight"], b["total"], strict=True))
        yield _steps_frame(kept, [TaskContext.get().partitionId()] * len(kept))

    steps = cut_lineage(counted.repartitionByRange("score").sortWithinPartitions("score").mapInPandas(pool_range, _STEPS))
    while pairs := _violating_pairs(steps):
        dealt = steps.join(steps.sparkSession.createDataFrame(pairs, "range int, pair int"), "range", "left")
        moved = dealt.where(F.col("pair").isNotNull()).repartition("pair").sortWithinPartitions("pair", "score").mapInPandas(_pool_pairs, _STEPS)
        steps = cut_lineage(dealt.where(F.col("pair").isNull()).select("range", "score", "weight", "total").unionByName(moved))
    return steps.select(F.col("score").alias("threshold"), (F.col("total") / F.col("weight")).alias("probability"), "weight").orderBy("threshold")


_STEPS = "range int, score double, weight double, total double"


def _steps_frame(kept: list[list[float]], ranges: list[int]) -> pd.DataFrame:
    return pd.DataFrame(kept, columns=["score", "weight", "total"], dtype=float).assign(range=pd.array(ranges, "int32"))[["range", "score", "weight", "total"]]


def _pool_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool the two ranges of each pair; ``range`` follows the first score of a step."""
    kept: list[list[float]] = []
    owner: dict[float, int] = {}
    pair = None
    for b in batches:
        for p, r, *step in zip(b["pair"], b["range"], b["score"], b["weight"], b["total"], strict=True):
            if p != pair and kept:
                yield _steps_frame(kept, [owner[k[0]] for k in kept])
                kept, owner = [], {}
            pair, owner[step[0]] = p, r
            kept = _pool(kept, iter([tuple(step)]))
    if kept:
        yield _steps_frame(kept, [owner[k[0]] for k in kept])


def _violating_pairs(steps: DataFrame) -> list[tuple[int, int]]:
    """(range, pair) of neighbours whose border does not rise, each range in one pair at most; a row for each range of scores reaches the driver."""
    ends = steps.groupBy("range").agg(
        F.min("score").alias("start"), F.min_by(F.struct("weight", "total"), "score").alias("first"), F.max_by(F.struct("weight", "total"), "score").alias("last")
    )
    found = sorted(ends.collect(), key=lambda r: r.start)
    pairs: list[tuple[int, int]] = []
    free = 0
    for i in range(1, len(found)):
        low, high = found[i - 1].last, found[i].first
        if i - 1 >= free and low.total * high.weight >= high.total * low.weight:
            pairs += [(found[i - 1].range, i), (found[i].range, i)]
            free = i + 1
    return pairs


def calibrated(scores: DataFrame, steps: DataFrame, cells: int = 32, salts: int = 8) -> DataFrame:
    """Step lookup: the last threshold at or below the score, the first value below all of them, null for a null score.

    Scores and steps are dealt out by ``cells`` between the scores' own quantiles and merged there in order: one shuffle, and each task hands the last step on from
    row to row.  A cell is salted, so that one score held by many rows spreads; steps, which are few, go to every salt, led by the step that reaches into the cell.
    """
    quantiles = scores.agg(F.percentile_approx("score", [i / cells for i in range(1, cells)])).first()[0] or []  # a number for each cell
    bounds = sorted({b for b in quantiles if b == b})
    cell = lambda c: sum(((c >= b).cast("int") for b in bounds), F.lit(0))
    cut = steps.select(cell(F.col("threshold")).alias("cell"), F.col("threshold").alias("at"), "probability")
    own = cut.groupBy("cell").agg(F.min_by("probability", "at").alias("low"), F.max_by("probability", "at").alias("high"))
    every = steps.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("cell")).join(own, "cell", "left")
    before = W.partitionBy(F.lit(1)).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # over the cells only
    after = W.partitionBy(F.lit(1)).orderBy("cell").rowsBetween(W.currentRow, W.unboundedFollowing)
    carried = F.coalesce(F.last("high", ignorenulls=True).over(before), F.first("low", ignorenulls=True).over(after))
    led = cut.unionByName(every.select("cell", F.lit(None).cast("double").alias("at"), carried.alias("probability")))
    none = F.lit(None).cast(scores.select(F.struct("*").alias("r")).schema["r"].dataType)
    led = led.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at", F.lit(0).alias("kind"), "probability", none.alias("row"))
    asked = scores.where(F.col("score").isNotNull()).select(
        cell(F.col("score")).alias("cell"), F.pmod(F.xxhash64(*scores.columns), F.lit(salts)).cast("int").alias("salt"), F.col("score").alias("at"),
        F.lit(1).alias("kind"), F.lit(None).cast("double").alias("probability"), F.struct(*scores.columns).alias("row"),
    )
    merged = led.unionByName(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "at", "kind")
    found = merged.mapInArrow(_hand_on, merged.schema).select("row.*", "probability")
    return found.unionByName(scores.where(F.col("score").isNull()).withColumn("probability", F.lit(None).cast("double")))


def _hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 get the probability of the last row of kind 0 before them; every cell begins with one."""
    held = np.nan
    for b in batches:
        kind, value = b.column("kind").to_numpy(zero_copy_only=False), b.column("probability").to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
        value = np.where(last >= 0, value[np.maximum(last, 0)], held)
        held = value[-1] if len(value) else held
        filled = b.set_column(b.schema.get_field_index("probability"), "probability", pa.array(value, pa.float64()))
        yield filled.filter(pa.array(kind == 1))


def reliability(observations: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability bins with float edges ``i * width``; the last is closed, others half open."""
    width = 1.0 / bins
    s = F.col("score")
    which = F.lit(None).cast("int")
    for i in range(bins):
        lower, upper = i * width, (i + 1) * width
        inside = (s >= lower) & (s < upper)
        which = F.when(inside | (s == upper) if i == bins - 1 else inside, F.lit(i)).otherwise(which)
    return (
        observations.withColumn("bin", which).where(F.col("bin").isNotNull()).groupBy("bin")
        .agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.avg(F.col("was_correct").cast("double")).alias("accuracy"))
        .withColumn("gap", F.abs(F.col("mean_score") - F.col("accuracy")))
    )


def expected_calibration_error(observations: DataFrame, bins: int = 10) -> DataFrame:
    return reliability(observations, bins).agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"))
