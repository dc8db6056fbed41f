"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has three segments of 22, 21 and 21 bits.  Two fingerprints that differ in three bits or fewer differ in one bit
or none in at least two of the segments.  Each segment, filled up to 23 bits, is decoded by the perfect Golay code to the
codeword within distance three and, if it lies three bits away from that, also to the five codewords at distance four.
If two segments differ in one bit, the codeword of the one is among the codewords near the other.  So one fingerprint of a
pair looks up its own two codeword indices (three keys, one for each two segments) and the other is listed under all
its near ones; equal keys are joined and the bits that differ are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import merge_with_totals, shared_table
from fleetsift.llm.components import components

#: Generator polynomial of the binary Golay code of length 23, segment widths (sum 64).
GOLAY = 0b101011100011
WIDTHS = (22, 21, 21)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every 12-bit message, and for every remainder the messages' changes towards the near codewords (-1: none)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    of_bit = [remainder(1 << i) for i in range(23)]
    near = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= of_bit[i]
            near[syndrome, filled[syndrome]] = sum(1 << i for i in bits) >> 11
            filled[syndrome] += 1
    return parity, near


def near_codewords(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords near each 23-bit value: column 0 the nearest, five more or -1."""
    parity, near = golay_tables()
    message = segment >> 11
    change = near[(segment & 2047) ^ parity[message]]
    return np.where(change < 0, -1, message[:, None] ^ change)


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the whole text as a signed 64-bit number; A-Z lower-cased, words parted by ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    ones, n, step = np.zeros(64, np.int64), max(1, len(words) - size + 1), 1 << 16
    while part := b"".join([xxhash.xxh64_digest(s, 42) for s, _ in zip(shingles, range(step), strict=False)]):
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a null or wordless text has fingerprint zero."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch], listed: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096].astype(np.uint64)
            near, shift = [], 0
            for w in WIDTHS:
                near.append(near_codewords((part >> np.uint64(shift) & np.uint64((1 << w) - 1)).astype(np.int64)))
                shift += w
            keys, owners = [], []
            for k, (i, j) in enumerate(combinations(range(3), 2)):
                a, c = (near[i], near[j]) if listed else (near[i][:, :1], near[j][:, :1])
                both = (a[:, :, None] << 12 | c[:, None, :]).reshape(len(part), -1) | k << 24
                ok = ((a[:, :, None] >= 0) & (c[:, None, :] >= 0)).reshape(len(part), -1)
                keys.append(both[ok])
                owners.append(np.nonzero(ok)[0])
            own = part.view(np.int64)[np.concatenate(owners)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(own)], names=["key", "fp"])


def fingerprint_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (u, v), u < v, of the fingerprints ``fp`` of ``distinct`` that differ in ``distance`` bits or fewer (three at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys find differences of three bits or fewer")
    spread = distinct.select("fp")
    probes = spread.mapInArrow(lambda it: _keys(it, False), "key int, fp long").select("key", F.col("fp").alias("u"))
    lists = spread.mapInArrow(lambda it: _keys(it, True), "key int, fp long").select("key", F.col("fp").alias("v"))
    # Merged at every size: Spark takes a list of keys for as large as the fingerprints it is made from, and would broadcast it.
    near = probes.join(lists.hint("merge"), "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    return near.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents link when their fingerprints differ in ``distance`` bits or fewer; ``component_id`` is the smallest id that can be
    reached.  Documents of one fingerprint are one class, and only classes are compared.  A null id links like any other but
    is never a component's id, unless all are null.  Repeated rows come out once each.
    """
    rows = shared_table(fingerprints(docs, id_col, text), "simhash")
    classes = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linked = components(shared_table(fingerprint_links(classes, distance), "simhash-links"), "simhash-components")
    # All of these have a row per document or fingerprint: merged at every size, so that none of them passes through the driver.
    roots = classes.join(linked.hint("merge"), classes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = merge_with_totals(roots, ids, "root").select("fp", "component_id")
    return rows.join(of_class.hint("merge"), "fp").select("doc_id", "fp", "component_id")
