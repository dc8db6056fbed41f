"""Links between near-equal embeddings: a robust-pruned flat graph, built on overlapping shards and searched by range from medoids.

Equal vectors of a label are one class.  A label is cut into cells: as long as a cell has too many vectors at home, a bounded sample of them become pivots and each goes home to its nearest pivot.  The cells
overlap in two ways.  Every vector is also a member of the graphs of the next nearest cells (``overlap``).  And it asks, besides its own, every cell where one within range of it can be at home: it is then on the
cell's side of the plane between its pivot and any other, so that it is no farther than the range from that side.

1. Build.  The graph of a cell is made by inserting batches of its members: a greedy search from medoids proposes neighbours, robust pruning keeps those that no kept neighbour is much nearer to.
2. Unite.  The lists that a vector got in several cells are united, in a table of one row per vector.
3. Search.  Those at home in a cell, with their united lists, meet those that ask in blocks, by equi-joins on (cell, block).  For each that asks a greedy search runs from the medoids; what it finds and
   what its own list names is expanded, if in range, until nothing new is in range.
4. Verify.  Hits are checked in double precision.  A block yields a count per vector and links that span its components, so that a group of near-equal vectors of any size needs no list of its pairs.

A link ends in one cell only, that where its other end is at home, so that counts add up.  A label that fits a cell has one; there is no other path.  A bounded sample of classes is held against brute force,
those of few links and those of many each by themselves; if less than the required share of their links was found, the search is repeated with a wider beam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.llm.common import shared_table
from fleetsift.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``threshold``: least cosine of a link.  ``shard``: classes at home in a cell, and those that ask it in a block.  ``overlap``: cells whose graphs a vector is a member of.  ``degree`` and
    ``beam``: neighbours of a node, and candidates kept by a search; ``medoids``: where searches begin.  ``alpha``: slack of pruning.  ``slack``: how far below the threshold a node is still
    expanded.  ``audited``: classes in the audit.  ``recall``: share of their links to be found.
    """

    threshold: float = 0.98
    shard: int = 4096
    overlap: int = 2
    degree: int = 16
    beam: int = 32
    medoids: int = 8
    alpha: float = 1.2
    slack: float = 0.05
    audited: int = 256
    recall: float = 0.95


def usable(vector: Column, label: Column) -> Column:
    """Not null, of finite components that are not all zero, with a label."""
    parts = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & parts & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision; all of one dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoids(x: np.ndarray, parts: int) -> np.ndarray:
    """The most central vector of each of some parts of a shard, cut by the nearest of as many of its vectors."""
    pivots = np.random.default_rng(len(x)).permutation(len(x))[:parts]
    part = (x @ x[pivots].T).argmax(axis=1)
    out = [np.flatnonzero(part == p)[(x[part == p] @ x[part == p].mean(axis=0)).argmax()] for p in np.unique(part)]
    return np.unique(np.array(out))


def greedy(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: (nodes, similarities) with ``beam`` nodes each, -1 where there are fewer."""
    rows, n = np.arange(len(queries)), len(x)
    nodes, sims, open_ = np.full((len(queries), beam), -1), np.full((len(queries), beam), -np.inf, x.dtype), np.zeros((len(queries), beam), bool)
    seen = np.zeros((len(queries), n), bool)
    e = len(entries)
    nodes[:, :e], sims[:, :e], open_[:, :e], seen[:, entries] = entries, queries @ x[entries].T, True, True
    while len(active := rows[open_.any(axis=1)]):
        pick = np.where(open_[active], sims[active], -np.inf).argmax(axis=1)
        open_[active, pick] = False
        near = edges[nodes[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, nodes[active, pick][:, None])] = True
        # Most neighbours have been seen: only the others are compared.
        row, col = np.nonzero(fresh)
        s = np.full(near.shape, -np.inf, x.dtype)
        s[row, col] = np.einsum("ed,ed->e", queries[active[row]], x[near[row, col]])
        all_nodes = np.concatenate([nodes[active], np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims[active], s], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        nodes[active], sims[active], open_[active] = (np.take_along_axis(a, best, axis=1) for a in (all_nodes, all_sims, all_open))
    return nodes, sims


def prune(x: np.ndarray, centre: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row of candidates (-1: none): nearest first, dropping those that a kept one is ``alpha`` times nearer to."""
    v = x[found]
    far = 2 - 2 * np.einsum("md,mcd->mc", x[centre], v)
    far[(found < 0) | (found == centre[:, None])] = np.inf
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    rows, out = np.arange(len(centre)), np.full((len(centre), degree), -1)
    # ``left``: how far those are that may still be kept.
    left = far.copy()
    for k in range(degree):
        j = left.argmin(axis=1)
        some = np.isfinite(left[rows, j])
        if not some.any():
            break
        out[some, k] = found[rows, j][some]
        left[(alpha * alpha * between[rows, j] <= far) | (found == found[rows, j][:, None])] = np.inf
    return out


def build(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(edges, medoids) of the vectors of a shard."""
    n, entries = len(x), medoids(x, s.medoids)
    edges, inserted = np.full((n, s.degree + 2), -1), np.zeros(n, bool)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    at, size = 0, len(entries)
    while at < n:
        batch = order[at : at + size]
        found, _ = greedy(x, edges, entries, x[batch], s.beam)
        edges[batch, : s.degree] = prune(x, batch, found, s.degree, s.alpha)
        source, target = np.repeat(batch, s.degree), edges[batch, : s.degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        closest = np.lexsort((-np.einsum("ed,ed->e", x[source], x[target]), target))
        source, target = source[closest], target[closest]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        # Most get few edges: nodes are pruned together with others that got about as many.
        few = 0
        for most in sorted({min(2, s.beam), min(8, s.beam), s.beam}):
            some = (count > few) & ((count <= most) | (most == s.beam))
            ok, row = np.repeat(some, count) & (place < most), np.cumsum(some) - 1
            back = np.full((some.sum(), most), -1)
            back[np.repeat(row, count)[ok], place[ok]] = source[ok]
            if len(back):
                edges[hit[some], : s.degree] = prune(x, hit[some], np.concatenate([edges[hit[some], : s.degree], back], axis=1), s.degree, s.alpha)
            few = most
        inserted[batch] = True
        edges = connect(x, edges, entries, s, inserted)
        at, size = at + size, min(256, size * 2)
    return edges, entries


def connect(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, s: Settings, inserted: np.ndarray) -> np.ndarray:
    """Edges by which every inserted node can be reached: one out of reach gets an edge from the nearest node that a search finds.

    These edges stand behind the first ``degree`` ones and are never pruned.
    """
    reached = ~inserted

    def walk(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            near = np.unique(edges[front])
            near = near[near >= 0]
            front = near[~reached[near]]

    walk(entries)
    while not reached.all():
        node = int(reached.argmin())
        found, sims = greedy(x, edges, entries, x[node : node + 1], s.beam)
        nearest = int(found[0, sims[0].argmax()])
        free = np.flatnonzero(edges[nearest, s.degree :] < 0)
        if not len(free):
            free = np.array([edges.shape[1] - s.degree])
            edges = np.concatenate([edges, np.full((len(x), 2), -1)], axis=1)
        edges[nearest, s.degree + free[0]] = node
        walk(np.array([node]))
    return edges


def two_way(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions: (first place of each node, nodes)."""
    n = len(edges)
    a, b = np.repeat(np.arange(n), edges.shape[1]), edges.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.append(0, np.cumsum(np.bincount(pairs // n, minlength=n))), pairs % n


def neighbours(front: np.ndarray, both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(query, node) for the nodes next to those of ``front``, in either direction of an edge."""
    place, ends = both
    out = np.zeros_like(front)
    row, node = np.nonzero(front)
    if len(row) < front.shape[1]:
        count = place[node + 1] - place[node]
        out[np.repeat(row, count), ends[np.repeat(place[node] - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
        return out
    # Many: every node asks its neighbours, a bit per query.
    linked = np.flatnonzero(place[1:] > place[:-1])
    if len(linked):
        bits = np.packbits(front.T, axis=1)
        near = np.bitwise_or.reduceat(bits[ends], place[linked], axis=0)
        out[:, linked] = np.unpackbits(near, axis=1, count=len(front)).T.astype(bool)
    return out


def in_range(x: np.ndarray, edges: np.ndarray, both: tuple[np.ndarray, np.ndarray], entries: np.ndarray, queries: np.ndarray, known: np.ndarray, s: Settings) -> np.ndarray:
    """(query, node): what greedy search along ``edges``, and then expansion along ``both`` of everything in range, find in range; ``known``: nodes of each query's own list, looked at too (-1: none)."""
    nodes, sims = greedy(x, edges, entries, queries, s.beam)
    nodes, sims = np.concatenate([nodes, known], axis=1), np.concatenate([sims, np.where(known < 0, -np.inf, np.einsum("qd,qkd->qk", queries, x[known]))], axis=1)
    least = s.threshold - s.slack
    row, col = np.nonzero(sims >= least)
    # What the beam saw and let go of may be in range all the same: only hits count as seen.
    front = np.zeros((len(queries), len(x)), bool)
    front[row, nodes[row, col]] = True
    hits, seen = front.copy(), front.copy()
    while front.any():
        near = neighbours(front, both) & ~seen
        seen |= near
        row, node = np.nonzero(near)
        if len(row) > 65536:
            front = near & (queries @ x.T >= least)
        else:
            close = np.einsum("ed,ed->e", queries[row], x[node]) >= least
            front = np.zeros_like(near)
            front[row[close], node[close]] = True
        hits |= front
    return hits


#: What tells a cell: label, dimension, and the numbers of the cells it was cut from.
CELL = ["label", "dims", "cell"]


def cells(classes: DataFrame, s: Settings) -> DataFrame:
    """(cid, n, label, dims, cell, vector, home, member, asks): each class in the cells where it is at home, a member of the graph, or asks."""
    yes = F.lit(True)
    state = classes.select("cid", "n", "label", F.size("vector").alias("dims"), F.lit("").alias("cell"), "vector", yes.alias("home"), yes.alias("member"), yes.alias("asks"))
    done, level = [], 0
    while True:
        large = state.filter("home").groupBy(*CELL).agg(F.count("*").alias("_size")).filter(F.col("_size") > s.shard)
        if large.isEmpty():
            return _union([*done, state])
        # Pivots: 16 at most of a sample of some 64 vectors of a cell.
        count = F.least(F.lit(16), F.ceil(2 * F.col("_size") / s.shard)).cast("int")
        hashed = F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 30))
        drawn = state.filter("home").join(large, CELL).filter(hashed < F.lit(float(1 << 30)) * F.greatest(F.lit(64.0), 4.0 * count) / F.col("_size"))
        pivots = drawn.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct(hashed.alias("h"), "vector"))).alias("p"), F.max(count).alias("k"))
        pivots = shared_table(pivots.select(*CELL, F.slice("p.vector", 1, F.col("k")).alias("pivots")), f"pivots-{level}")
        parted = state.join(pivots, CELL, "left").select(*state.columns, "pivots")
        done.append(parted.filter("pivots is null").drop("pivots"))
        made = parted.filter("pivots is not null").mapInArrow(lambda it: _deal(it, s), state.schema)
        state, level = shared_table(made, f"cells-{level}"), level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _deal(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Each vector at home goes home to its nearest pivot and joins the graphs of the next ones; those that ask do so where they can have a link."""
    reach = np.sqrt(max(0.0, 2 - 2 * s.threshold) + 1e-12)
    for b in batches:
        cid, home, member, asks = (b.column(name).to_numpy(zero_copy_only=False) for name in ("cid", "home", "member", "asks"))
        of: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(b.column(name).to_pylist() for name in CELL), strict=True)):
            of.setdefault(key, []).append(i)
        for (_, _, cell), places in of.items():
            rows = np.array(places)
            p = unit(b.column("pivots")[places[0]].values)
            sims = unit(b.column("vector").take(pa.array(rows))) @ p.T
            # Equal similarities are told apart by the id, so that a cell of one direction is split too.
            sims += 1e-12 * ((cid[rows, None] * 2654435761 + np.arange(len(p)) * 40503) % 1009)
            apart = np.linalg.norm(p[:, None] - p[None], axis=2)
            # Of cell c: for every other pivot j, no farther than the range from the side of c. The last term is far above the rounding and what tells ties apart.
            enters = np.stack([(sims - sims[:, [c]] <= reach * apart[c] + 1e-8).all(axis=1) for c in range(len(p))], axis=1) & asks[rows, None]
            rank = np.argsort(np.argsort(-sims, axis=1), axis=1)
            own, joins = (rank == 0) & home[rows, None], (rank < np.where(home[rows, None], s.overlap, 1)) & member[rows, None]
            row, part = np.nonzero(enters | own | joins)
            taken = b.take(pa.array(rows[row])).drop_columns(["pivots"])
            new = {"cell": np.array([f"{cell}.{c}" for c in range(len(p))], object)[part], "home": own[row, part], "member": joins[row, part], "asks": enters[row, part]}
            yield pa.RecordBatch.from_arrays([pa.array(new[name]) if name in new else taken.column(name) for name in taken.schema.names], names=taken.schema.names)


def _dealt(rows: DataFrame, s: Settings, first: int = 0) -> DataFrame:
    """Rows (cell, home, here, ...) in blocks.

    Those that are ``here`` (at home, to be found) go to each block of their cell from ``first``, or the last; others that are at home to block 0, and the rest to one of the blocks from 1.
    """
    blocks = rows.groupBy(*CELL).agg(F.ceil(F.count(F.when(~F.col("home"), 1)) / s.shard).cast("int").alias("_blocks"))
    one = F.lit(1) + F.pmod(F.xxhash64("cid", F.lit("block")), F.col("_blocks")).cast("int")
    to = F.when(F.col("here"), F.sequence(F.least(F.lit(first), "_blocks"), F.col("_blocks"))).when(F.col("home"), F.array(F.lit(0))).otherwise(F.array(one))
    return rows.join(blocks, CELL).withColumn("block", F.explode(to)).drop("_blocks")


def _build_block(table: pa.Table, s: Settings) -> pa.Table:
    """Edges (u, v) of the graph of the members."""
    order = np.argsort(table["cid"].to_numpy())
    cid, x = table["cid"].to_numpy()[order], unit(table["vector"].combine_chunks())[order].astype(np.float32)
    edges, _ = build(x, s)
    u, place = np.nonzero(edges >= 0)
    return pa.table([pa.array(cid[u]), pa.array(cid[edges[u, place]])], names=["u", "v"])


def united(dealt: DataFrame, s: Settings) -> DataFrame:
    """(cid, near): the neighbours of each class in the graphs of all the cells it is a member of; ``degree`` a graph and few more."""
    members = _dealt(dealt.filter("member").select("cid", *CELL, "vector", "home", F.col("home").alias("here")), s, first=1)
    edges = members.groupBy(*CELL, "block").applyInArrow(lambda t: _build_block(t, s), "u long, v long")
    return edges.groupBy(F.col("u").alias("cid")).agg(F.collect_set("v").alias("near"))


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (smallest place of each component) after the links a - b."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def _lists(near: pa.Array, cid: np.ndarray) -> np.ndarray:
    """United lists as places among ``cid`` (ascending), -1 where there is none; neighbours at home elsewhere are left out.  Two columns at the end are empty."""
    count = near.value_lengths().fill_null(0).to_numpy()
    source, ends = np.repeat(np.arange(len(near)), count), near.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(cid, ends), len(cid) - 1)
    here = cid[place] == ends
    source, place = source[here], place[here]
    kept = np.bincount(source, minlength=len(near))
    out = np.full((len(near), int(kept.max(initial=0)) + 2), -1)
    out[source, np.arange(len(source)) - np.repeat(np.cumsum(kept) - kept, kept)] = place
    return out


def _search_block(table: pa.Table, s: Settings) -> pa.Table:
    """(u, v, others, k): for every class that asks, with v null, its links to classes at home here, as rows and as classes; then links (u, v) that span the components."""
    target = table["here"].to_numpy()
    here, asks = np.flatnonzero(target), np.flatnonzero(~target)
    cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
    here, asks = here[np.argsort(cid[here])], asks[np.argsort(cid[asks])]
    ids, place = np.unique(cid, return_inverse=True)
    root, others, k = np.arange(len(ids)), np.zeros(len(asks), np.int64), np.zeros(len(asks), np.int64)
    if len(here) and len(asks):
        exact = unit(table["vector"].combine_chunks())
        x = exact[here].astype(np.float32)
        near_ids = table["near"].combine_chunks()
        edges, entries, known = _lists(near_ids.take(pa.array(here)), cid[here]), medoids(x, s.medoids), _lists(near_ids.take(pa.array(asks)), cid[here])
        own = np.minimum(np.searchsorted(cid[here], cid[asks]), len(here) - 1)
        known[:, -1] = np.where(cid[here[own]] == cid[asks], own, -1)
        # What only neighbours at home elsewhere led to is tied in.
        edges = connect(x, edges, entries, replace(s, degree=edges.shape[1] - 2), np.ones(len(here), bool))
        both = two_way(edges)
        # Those at home ask each other: what one of two found, both have.
        mutual = np.zeros((len(here), len(here)), bool) if table["block"][0].as_py() == 0 else None
        for i in range(0, len(asks), 256):
            q = asks[i : i + 256]
            near = in_range(x, edges, both, entries, exact[q].astype(np.float32), known[i : i + len(q)], s) & (cid[q, None] != cid[None, here])
            a, b = np.nonzero(near)
            if len(a) > 65536:
                near &= exact[q] @ exact[here].T >= s.threshold
            else:
                near[a, b] = np.einsum("ed,ed->e", exact[q[a]], exact[here[b]]) >= s.threshold
            a, b = np.nonzero(near)
            apart = root[place[q[a]]] != root[place[here[b]]]
            root = _join_up(root, place[q[a[apart]]], place[here[b[apart]]])
            if mutual is None:
                k[i : i + len(q)], others[i : i + len(q)] = near.sum(axis=1), near @ n[here]
            else:
                mutual[i : i + len(q)] |= near
                mutual[:, i : i + len(q)] |= near.T
        if mutual is not None:
            k, others = mutual.sum(axis=1), np.concatenate([mutual[i : i + 256] @ n[here] for i in range(0, len(here), 256)])
    found, linked = np.flatnonzero(k), np.flatnonzero(root != np.arange(len(ids)))
    u, v = np.concatenate([cid[asks[found]], ids[linked]]), np.concatenate([np.full(len(found), -1), ids[root[linked]]])
    pad = np.zeros(len(linked), np.int64)
    return pa.table([pa.array(u), pa.array(v, mask=v < 0), pa.array(np.concatenate([others[found], pad])), pa.array(np.concatenate([k[found], pad]))], names=["u", "v", "others", "k"])


def search(dealt: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) from which components follow, and (u, others, k): the rows and classes that each class is linked with."""
    lists = shared_table(united(dealt, s), "embedding-graph")
    here = dealt.filter("home").select("cid", "n", *CELL, "vector", "home", F.lit(True).alias("here"))
    ask = dealt.filter("asks").select("cid", "n", *CELL, "vector", "home", F.lit(False).alias("here"))
    found = _dealt(here.unionByName(ask).join(lists, "cid", "left"), s).groupBy(*CELL, "block").applyInArrow(lambda t: _search_block(t, s), "u long, v long, others long, k long")
    found = shared_table(found, "embedding-links")
    counts = found.filter("v is null").groupBy("u").agg(F.sum("others").alias("others"), F.sum("k").alias("k"))
    return found.filter("v is not null").select("u", "v").distinct(), counts


def audit(classes: DataFrame, counts: DataFrame, s: Settings, few: int = 16) -> list[tuple[int, int]]:
    """(links found, links there are) of the classes in a bounded sample that have ``few`` links at most, and of the others, by brute force against all classes of their labels."""
    n = classes.count()
    share = F.pmod(F.xxhash64("cid", F.lit("audit")), F.lit(1 << 30)) < F.lit(min(1.0, 2.0 * s.audited / max(n, 1)) * (1 << 30))
    sample = [(r.cid, r.label, list(r.vector)) for r in classes.filter(share).orderBy("cid").limit(s.audited).collect()]
    if not sample:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, label = b.column(0).to_numpy(), b.column(1).to_pylist()
            total = dict.fromkeys((q[0] for q in sample), 0)
            dims = b.column(2).value_lengths().to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = unit(b.column(2).take(pa.array(rows)))
                ask = [q for q in sample if len(q[2]) == d]
                if ask:
                    y = unit(pa.array([q[2] for q in ask], pa.list_(pa.float64())))
                    near = x @ y.T >= s.threshold
                    near &= np.array([label[i] for i in rows], object)[:, None] == np.array([q[1] for q in ask], object)[None, :]
                    near &= cid[rows][:, None] != np.array([q[0] for q in ask])[None, :]
                    for q, links in zip(ask, near.sum(axis=0), strict=True):
                        total[q[0]] += int(links)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["u", "n"])

    there = classes.select("cid", "label", "vector").mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    there = {r.u: r.n for r in there.collect()}
    found = {r.u: r.k for r in counts.filter(F.col("u").isin([q[0] for q in sample])).select("u", "k").collect()}
    strata = [[u for u, n in there.items() if (n <= few) == first] for first in (True, False)]
    return [(sum(found.get(u, 0) for u in of), sum(there[u] for u in of)) for of in strata]


def near_vectors(table: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``.

    Vectors link when their labels are equal and their cosine is at least the threshold; null, zero or non-finite ones, those with a null
    label, and those of another dimension, link with nothing.  Repeated rows link with each other like other equal vectors.
    ``n_links`` counts the vectors linked directly, ``component_id`` is the smallest id that can be reached, its own included.
    """
    rows = table.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"), usable(F.col(vector), F.col(label)).alias("_ok"))
    good = rows.filter("_ok")
    grouped = good.groupBy("label", "vector").agg(F.min("_id").alias("least"), F.count("*").alias("n"))
    # Written before use: the numbers of the classes must not change when a task runs again.
    classes = shared_table(grouped.withColumn("cid", F.monotonically_increasing_id()), "embedding-classes")
    s, dealt = settings, cells(classes, settings)
    while True:
        links, linked = search(dealt, s)
        audited = audit(classes, linked, s)
        if all(found >= s.recall * there for found, there in audited) or s.beam >= 8 * settings.beam:
            break
        s = replace(s, beam=s.beam * 2)
    if any(found < 0.9 * there for found, there in audited):
        raise RuntimeError(f"the search found {audited} of the audited links, of classes of few and of many")
    root = components(links, "embedding-components")
    of_class = classes.join(linked, classes.cid == linked.u, "left").join(root, classes.cid == root.node, "left").select("label", "vector", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    ids = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(ids, "root").select("label", "vector", "n_links", "component_id")
    joined = good.join(of_class, ["label", "vector"]).select("_id", "n_links", "component_id")
    alone = rows.filter("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
