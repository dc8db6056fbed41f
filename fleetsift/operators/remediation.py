"""Remediation: resolving findings to snippets, ordering, library consistency, report rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.session import cut_lineage
from fleetsift.sources.rules import SEVERITY_RANK, VERDICT_RANK

LOCKOUT_RANK = {"none": 0, "low": 1, "high": 2}


def resolve(findings: DataFrame, snippets: DataFrame) -> DataFrame:
    """Outcome per finding: exact (vendor, os_family, rule) lookup for failures only."""
    key = snippets.select("vendor", "os_family", "rule_id", "snippet_id")
    rows = findings.join(key, ["vendor", "os_family", "rule_id"], "left")
    unknown = F.coalesce("vendor", F.lit("")).eqNullSafe("") | F.coalesce("os_family", F.lit("")).eqNullSafe("")
    outcome = (
        F.when(F.col("status") != "fail", "not_actionable").when(unknown, "platform_unknown").when(F.col("snippet_id").isNotNull(), "resolved").otherwise("no_snippet")
    )
    return rows.withColumn("outcome", outcome).withColumn("snippet_id", F.when(F.col("outcome") == "resolved", F.col("snippet_id")))


def apply_order(plan: DataFrame) -> DataFrame:
    """Position of each snippet of a device: dependencies first, then (lockout, hint, id).

    ``plan`` rows are ``device_id, snippet_id, lockout, order_hint, depends_on``.  Copies of a
    snippet are dropped first, so a device's group is bounded by the library, and devices run
    in parallel.  A device whose set has a cycle gets NULL positions.
    """
    distinct = plan.groupBy("device_id", "snippet_id").agg(
        F.min("lockout").alias("lockout"), F.min("order_hint").alias("order_hint"), F.first("depends_on").alias("depends_on")
    )

    packed = distinct.groupBy("device_id").agg(
        F.collect_list(F.struct("snippet_id", "lockout", "order_hint", "depends_on")).alias("items")
    )

    def positions(items: list) -> dict[str, int]:
        ids = {i["snippet_id"] for i in items}
        left = {i["snippet_id"]: {x for x in i["depends_on"] if x in ids and x != i["snippet_id"]} for i in items}
        rank = {i["snippet_id"]: (LOCKOUT_RANK[i["lockout"]], i["order_hint"], i["snippet_id"]) for i in items}
        place: dict[str, int] = {}
        while left:
            ready = [s for s, deps in left.items() if not deps - place.keys()]
            if not ready:
                return {}
            chosen = min(ready, key=rank.__getitem__)
            place[chosen] = len(place) + 1
            del left[chosen]
        return place

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for device, items in zip(b["device_id"], b["items"], strict=True):
                place = positions(items)
                rows += [(device, i["snippet_id"], place.get(i["snippet_id"])) for i in items]
            yield pd.DataFrame(rows, columns=["device_id", "snippet_id", "position"]).astype({"position": "float64"})

    kind = dict(plan.dtypes)["device_id"]
    return packed.mapInPandas(order, f"device_id {kind}, snippet_id string, position double").withColumn(
        "position", F.col("position").cast("int")
    )


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: nodes without an incoming or an outgoing edge go, round by round."""
    size = edges.count()
    while size:
        core = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = cut_lineage(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == size:
            break
        size = left
    return edges


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` (node, colour): every node takes the smallest colour that reaches it along ``edges``, until none changes."""
    state = cut_lineage(state)
    while True:
        pushed = edges.join(state.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
        grown = cut_lineage(state.unionByName(pushed).groupBy("node").agg(F.min("colour").alias("colour")))
        if grown.join(state, ["node", "colour"], "left_anti").isEmpty():
            return grown
        state = grown


def cyclic_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst) -> (node, component) of every node that lies on a cycle; a component is named by its smallest id.

    Trimming, then colouring forwards and marking backwards: nodes take the smallest id that reaches them, and what reaches that id again inside its colour is its
    component.  Components and edges between colours go, and the rest is coloured anew.  Rounds are bounded by path lengths, never by the number of paths.  A node that needs only itself is on no cycle.
    """
    live = _trimmed(cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()))
    found = live.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while not live.isEmpty():
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread(nodes.withColumn("colour", F.col("node")), live)
        ends = live.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = cut_lineage(ends.where(F.col("a") == F.col("b")).select("src", "dst"))
        # Backwards from each colour's own node; edges stay inside a colour, so the mark is the colour.
        marked = _spread(colours.where(F.col("node") == F.col("colour")), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        sizes = marked.groupBy("colour").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        found = found.unionByName(marked.join(sizes, "colour").select("node", F.col("colour").alias("component")))
        rest = inside.join(marked.select(F.col("node").alias("src")), "src", "left_anti").join(marked.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = _trimmed(cut_lineage(rest.select("src", "dst")))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """A dependency cycle for each component: the shortest through its smallest id, of several the first by its ids.

    One walk per component, in which each node is reached once; a dense component has exponentially many cycles, and mending this one is where its order can begin.
    """
    of = cut_lineage(cyclic_components(edges))
    inner = edges.join(of.select(F.col("node").alias("src"), "component"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst")
    inner = cut_lineage(inner.where((F.col("component") == F.col("_c")) & (F.col("src") != F.col("dst"))).select("component", "src", "dst").distinct())
    front = of.where(F.col("node") == F.col("component")).select("component", "node", F.array("node").alias("path"))
    reached, closed = front.select("component", "node"), None
    while True:
        grown = cut_lineage(front.join(inner.withColumnRenamed("src", "node"), ["component", "node"]).select("component", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        back = grown.where(F.col("node") == F.col("component")).groupBy("component").agg(F.min("path").alias("path"))
        closed = back if closed is None else closed.unionByName(back)
        front = cut_lineage(
            grown.join(back.select("component"), "component", "left_anti").join(reached, ["component", "node"], "left_anti").groupBy("component", "node").agg(F.min("path").alias("path"))
        )
        if front.isEmpty():
            return closed.select(F.array_join("path", " -> ").alias("cycle"))
        reached = cut_lineage(reached.unionByName(front.select("component", "node")))


def consistency(snippets: DataFrame) -> DataFrame:
    """Duplicate ids and dependencies on snippets that do not exist."""
    ids = snippets.groupBy("snippet_id").agg(F.count("*").alias("n"))
    dup = ids.where(F.col("n") > 1).select(F.lit("duplicate_id").alias("problem"), "snippet_id", F.lit(None).cast("string").alias("dependency"))
    deps = snippets.select("snippet_id", F.explode("depends_on").alias("dependency"))
    dangling = deps.join(ids.select(F.col("snippet_id").alias("dependency")), "dependency", "left_anti")
    return dup.unionByName(dangling.select(F.lit("dangling_dependency").alias("problem"), "snippet_id", "dependency"))


def _rank(column: str, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(column))


def report_key() -> list[Column]:
    return [_rank("status", VERDICT_RANK), _rank("severity", SEVERITY_RANK), F.col("rule_id")]


def disclosures(resolved: DataFrame, absence: dict[str, str], library_size: int) -> DataFrame:
    """Codes of the statements a report must carry, per device, from aggregates only."""
    agg = resolved.groupBy("device_id").agg(
        F.count_if(F.col("refs") != "").alias("mapped"), F.count_if(F.col("unknown_reason") == "capability_unknown").alias("undocumented"),
        F.count_if(F.col("exposure_score").isNull()).alias("unscored"),
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("mapped") == 0, "no_framework_mapping"), F.when(F.col("mapped") > 0, "mappings_are_asserted"),
            F.when(F.lit(library_size == 0), "library_empty"), F.when(F.col("unscored") > 0, "no_exposure_scoring"),
            F.when(F.col("undocumented") > 0, F.concat(F.lit("capability_unknown:"), "undocumented")), F.lit("subject_is_a_file"),
        )
    )
    return agg.select("device_id", F.array_join(codes, ",").alias("disclosures"))
