"""Removal of repeated passages by level-wise doubling of window lengths.

Documents are dealt to groups of some hundred by their id; a group is worked on as one array of word digests.  At each level a
group names its windows of the level's length once each, by digest; digests are dealt to buckets, and those that occur twice or more come back.  Only
windows of ``words`` words that hold a window repeated at one length are looked at with twice that length, until the length is
``words`` or no candidate survives.  Below ``words``, a level needs not every window: of the windows inside each ``words``-word window, the one with
the smallest digest stands for it, so that equal ``words``-word windows name equal ones.  At the last level the earliest place of each digest is
found, first in the group, then among the groups.  A passage in many documents thus counts once per group and never gathers
in one task.  Plan: the texts are shuffled once and read again by every level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = 0x9E3779B97F4A7C15
#: Sorts before every id.
NULL_ID = -(2**63)
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def windows(digests: np.ndarray, length: int) -> np.ndarray:
    """Digest of every window of ``length`` words, doubling the length and adding a word as its binary digits say."""
    out, have = digests, 1
    for bit in bin(length)[3:]:
        out = out[: max(0, len(out) - have)] * np.uint64(pow(BASE, have, 1 << 64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[: max(0, len(out) - 1)] * np.uint64(BASE) + digests[have : have + max(0, len(out) - 1)]
            have += 1
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: max(0, len(out) - step)], out[step:])
        have += step
    return out


@dataclass
class Group:
    """The documents of a group in the order of their ids, as one array of words."""

    ids: np.ndarray
    words: list[list[bytes]]
    digests: np.ndarray  # words x 2
    owner: np.ndarray  # document of each word
    first: np.ndarray  # first word of each document

    @classmethod
    def of(cls, table: pa.Table) -> Group:
        import xxhash

        ids = np.array([NULL_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        texts = table["text"]
        order = np.argsort(ids, kind="stable")
        words = [(texts[int(i)].as_py() or "").encode().split() for i in order]
        raw = b"".join([b"".join(map(xxhash.xxh3_128_digest, w)) for w in words])
        sizes = np.array([len(w) for w in words], np.int64)
        return cls(ids[order], words, np.frombuffer(raw, "<u8").reshape(-1, 2), np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes)

    def whole(self, length: int) -> np.ndarray:
        """Starts of the windows that lie inside one document."""
        n = max(0, len(self.owner) - length + 1)
        return np.nonzero(self.owner[:n] == self.owner[length - 1 :][:n])[0]

    def named(self, starts: np.ndarray, length: int, words: int) -> np.ndarray:
        """Of each ``words``-word window that begins at ``starts``, the smallest digest of its windows of ``length`` words."""
        return sliding_least(windows(self.digests[:, 0], length), words - length + 1)[starts]

    def keys(self, starts: np.ndarray, words: int) -> np.ndarray:
        out = np.empty(len(starts), KEY)
        out["a"], out["b"] = windows(self.digests[:, 0], words)[starts], windows(self.digests[:, 1], words)[starts] >> np.uint64(32)
        return out

    def places(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, start in its document)."""
        doc = self.owner[starts]
        return self.ids[doc], starts - self.first[doc]


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def key_member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Like ``member``, for ``KEY`` arrays; the set is sorted by ``a`` and has each ``a`` once."""
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_set["a"], keys["a"]), len(sorted_set) - 1)
    return sorted_set[at] == keys


def _slices(top: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Bucket numbers that occur and their part of the rising digests ``top``."""
    of = (top >> np.uint64(40)).astype(np.int64) * buckets >> 24
    cut = np.flatnonzero(np.diff(of)) + 1
    for lo, hi in zip(np.append(0, cut), np.append(cut, len(of)), strict=True):
        if hi > lo:
            yield int(of[lo]), slice(lo, hi)


def _joined(column: pa.ChunkedArray, kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


NAMED = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("digests", pa.binary()), ("twice", pa.binary())])
AGAIN = pa.schema([("g", pa.int64()), ("digests", pa.binary())])
PLACED = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("twice", pa.binary())])
LATER = pa.schema([("g", pa.int64()), ("all", pa.binary()), ("rest", pa.binary())])


def _group_number(table: pa.Table) -> int:
    return table["g"][0].as_py()


def name_windows(texts: pa.Table, before: pa.Table | None, length: int, below: int, words: int, buckets: int) -> pa.Table:
    """A level below the last: digests of a group's windows of ``length`` words, once each, and whether at two places."""
    if not texts.num_rows:
        return _table([], NAMED)
    group = Group.of(texts)
    starts = group.whole(words)
    if before is not None:
        starts = starts[member(group.named(starts, below, words), np.unique(_joined(before["digests"], "<u8")))]
    if not len(starts):
        return _table([], NAMED)
    every, least = windows(group.digests[:, 0], length), group.named(starts, length, words)
    chosen = np.zeros(len(every), bool)
    for i in range(words - length + 1):
        chosen[starts[every[starts + i] == least] + i] = True
    digests, counts = np.unique(every[chosen], return_counts=True)
    g, twice = _group_number(texts), (counts > 1).astype(np.uint8)
    return _table([(b, g, digests[s].astype("<u8").tobytes(), twice[s].tobytes()) for b, s in _slices(digests, buckets)], NAMED)


def repeated(rows: pa.Table) -> pa.Table:
    """A bucket's digests that occur at two places or more, for each group that has them."""
    digests, twice = _joined(rows["digests"], "<u8"), _joined(rows["twice"], np.uint8)
    order = np.argsort(digests, kind="stable")
    ranked = digests[order]
    same = ranked[1:] == ranked[:-1]
    again = twice[order] > 0
    again[1:] |= same
    again[:-1] |= same
    # A digest that is twice in one group is seen once by the others: spread the mark over equal neighbours.
    run = np.cumsum(np.append(0, ~same)) if len(ranked) else np.zeros(0, np.int64)
    marked = np.zeros(run[-1] + 1 if len(run) else 0, bool)
    marked[run[again]] = True
    back = np.empty(len(digests), bool)
    back[order] = marked[run]
    out, at = [], 0
    for g, blob in zip(rows["g"].to_pylist(), rows["digests"], strict=True):
        part = slice(at, at + len(blob.as_py()) // 8)
        at = part.stop
        if back[part].any():
            out.append((g, digests[part][back[part]].tobytes()))
    return _table(out, AGAIN)


def place_windows(texts: pa.Table, before: pa.Table | None, below: int, words: int, buckets: int) -> pa.Table:
    """The last level: a group's surviving windows, once each, with their earliest place and whether there are later ones."""
    if not texts.num_rows:
        return _table([], PLACED)
    group = Group.of(texts)
    starts = group.whole(words)
    if before is not None:
        starts = starts[member(group.named(starts, below, words), np.unique(_joined(before["digests"], "<u8")))]
    if not len(starts):
        return _table([], PLACED)
    keys = group.keys(starts, words)
    ids, inside = group.places(starts)
    order = np.lexsort((inside, ids, keys["b"], keys["a"]))
    keys, ids, inside = keys[order], ids[order], inside[order]
    new = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(keys)) - 1
    twice = ((ids[last] != ids[at]) | (inside[last] != inside[at])).astype(np.uint8)
    keys, ids, inside, g = keys[at], ids[at].astype("<i8"), inside[at].astype("<u4"), _group_number(texts)
    return _table([(b, g, keys[s].tobytes(), ids[s].tobytes(), inside[s].tobytes(), twice[s].tobytes()) for b, s in _slices(keys["a"], buckets)], PLACED)


def later_windows(rows: pa.Table) -> pa.Table:
    """Per group, the windows that begin earlier in another one (``all`` their places go) or are only its own repeats (``rest``: all but the first)."""
    keys, ids, inside = _joined(rows["keys"], KEY), _joined(rows["docs"], "<i8"), _joined(rows["starts"], "<u4")
    twice = _joined(rows["twice"], np.uint8) > 0
    order = np.lexsort((inside, ids, keys["b"], keys["a"]))
    ranked = keys[order]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = ranked[1:] == ranked[:-1]
    out, at = [], 0
    for g, blob in zip(rows["g"].to_pylist(), rows["keys"], strict=True):
        part = slice(at, at + len(blob.as_py()) // KEY.itemsize)
        at = part.stop
        gone, rest = later[part], twice[part] & ~later[part]
        if gone.any() or rest.any():
            out.append((g, keys[part][gone].tobytes(), keys[part][rest].tobytes()))
    return _table(out, LATER)


def cut_words(texts: pa.Table, found: pa.Table, words: int, with_text: bool) -> pa.Table:
    """Per document: words, removed words, digest of the kept ones and, if asked for, the kept text."""
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)
    if not texts.num_rows:
        return _table([], schema)
    group = Group.of(texts)
    gone = np.zeros(len(group.owner), bool)
    starts = group.whole(words)
    if found.num_rows and len(starts):
        keys = group.keys(starts, words)
        away = key_member(keys, np.unique(_joined(found["all"], KEY)))
        own = np.flatnonzero(key_member(keys, np.unique(_joined(found["rest"], KEY))))
        ids, inside = group.places(starts[own])
        order = own[np.lexsort((inside, ids, keys["b"][own], keys["a"][own]))]
        ids, inside = group.places(starts[order])
        new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(order) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
        away[order[(ids != ids[lead]) | (inside != inside[lead])]] = True
        edge = np.zeros(len(gone) + 1, np.int64)
        np.add.at(edge, starts[away], 1)
        np.add.at(edge, starts[away] + words, -1)
        gone = np.cumsum(edge[:-1]) > 0
    rows = []
    for i, (doc, w) in enumerate(zip(group.ids.tolist(), group.words, strict=True)):
        cut = gone[group.first[i] : group.first[i] + len(w)]
        n = int(cut.sum())
        kept = b" ".join(w if not n else [x for x, c in zip(w, cut.tolist(), strict=True) if not c])
        rows.append((None if doc == NULL_ID else doc, len(w), n, hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
    return _table(rows, schema)


def _spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {({pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[f.type]}" for f in schema)


def remove_repeats(docs: DataFrame, words: int = 20, first: int = 10, id_col: str = "doc_id", text: str = "text", group_rows: int = 512, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs``.

    A word goes when a window of ``words`` words over it also begins earlier: in a document of smaller id, or earlier in the same one.
    ``words`` must be ``first`` times a power of two.  Null text has no words; a null id comes before all others; rows that repeat an
    id are one document, so that equal windows at the same start are not earlier than each other.  ``group_rows`` is how many documents
    an array holds on average: memory, not results, depends on it.
    """
    levels = [first]
    while levels[-1] < words:
        levels.append(levels[-1] * 2)
    if levels[-1] != words:
        raise ValueError("words must be first times a power of two")
    groups = -(-docs.count() // group_rows) or 1
    buckets = max(16, groups // 8)
    g = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(groups)).alias("g")
    texts = docs.select(g, F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    def level(before: DataFrame | None, step: Callable[[pa.Table, pa.Table | None], pa.Table], schema: pa.Schema) -> DataFrame:
        if before is None:
            return texts.groupBy("g").applyInArrow(lambda t: step(t, None), _spark_schema(schema))
        return texts.groupBy("g").cogroup(before.groupBy("g")).applyInArrow(lambda t, p: step(t, p), _spark_schema(schema))

    before, below = None, 0
    for length in levels[:-1]:
        named = level(before, partial(name_windows, length=length, below=below, words=words, buckets=buckets), NAMED)
        before, below = named.groupBy("bucket").applyInArrow(repeated, _spark_schema(AGAIN)), length
    placed = level(before, partial(place_windows, below=below, words=words, buckets=buckets), PLACED)
    found = placed.groupBy("bucket").applyInArrow(later_windows, _spark_schema(LATER))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(lambda t, f: cut_words(t, f, words, with_text), schema)
