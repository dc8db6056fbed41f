"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily, largest piece first; then its smallest piece is replaced with the two unpacked ones that
fill the gap it leaves more tightly, if there are any.  Pieces of one length are alike, so the plan is made from the number of
pieces of each length (``size`` numbers at most, whatever the corpus): a bin is repeated as often as the numbers allow.  Every round
uses up a length or nearly so, which bounds the number of patterns.  Pieces are numbered within their length by a
bucketed scan and look their place up in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import shared_table
from fleetsift.operators.scan import dense_sequence

#: Units kept per Python worker before the memory is emptied, and the longest unit that is kept.
CACHE_UNITS, CACHE_CHARS = 1 << 18, 48
#: A space between two characters that are not white space: no token of a byte-level BPE spans the place before it.
_SAFE_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
_UNSAFE = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]| \Z")
#: What both libraries certainly split alike: printable Latin, and nothing that may be a special token.
_PLAIN = re.compile(r" ?[!-;=-~\u00a1-\u00ac\u00ae-\u024f\n]*\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts by a byte-level BPE of ``tokenizers``; a dictionary of the ids of space-led units.

    The tokenizer joins one space to the word after it, so a text cut before such spaces gives the same ids piece by piece.
    New units in plain Latin go through ``tiktoken`` with the same vocabulary, which is faster and gives equal ids; all others through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        found = self.encode(" " + unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        ids = self.plain(text) if _PLAIN.match(text) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``, without special tokens."""
        units = _SAFE_SPACE.split(text) if _UNSAFE.search(text) else text.split(" ")
        return self.encode(units[0]) + b"".join(map(self.__getitem__, units[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes what does not fill a whole piece."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row; null text counts as empty, every document ends in ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for b in batches:
            rows: list[tuple] = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(body.as_py() or "") + end
                for k, (at, n) in enumerate(cut_points(len(ids) // 4, size)):
                    part = ids[at * 4 : (at + n) * 4]
                    rows.append((doc, k, at, n, zlib.crc32(part)) + ((part,) if with_ids else ()))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, schema)


def bin_patterns(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over ``counts[length]``: (how often, {length: pieces of it in one bin}); ``len(counts) - 1`` is the bin's size."""
    left, size = counts.astype(np.int64), len(counts) - 1
    index, patterns = np.arange(size + 1), []
    while left[1:].any():
        free, bin_, gap = left.copy(), {}, size
        below = np.maximum.accumulate(np.where(free > 0, index, 0))
        while gap and (n := int(below[gap])):
            take = int(min(free[n], gap // n))
            bin_[n], gap = bin_.get(n, 0) + take, gap - take * n
            free[n] -= take
            if not free[n]:
                below[n:][below[n:] == n] = below[n - 1]
        small = min(bin_)
        if gap:
            room = gap + small
            a = index[1 : room + 1][free[1 : room + 1] > 0]
            b = below[np.minimum(a - 1, room - a)]
            twice = (free[a] > 1) & (2 * a <= room)
            b = np.where(twice, a, b)
            sums = np.where(b > 0, a + b, 0)
            if len(sums) and (best := int(sums.argmax())) >= 0 and sums[best] > small:
                bin_[small] -= 1
                for n in (int(a[best]), int(b[best])):
                    bin_[n] = bin_.get(n, 0) + 1
        bin_ = {n: c for n, c in sorted(bin_.items(), reverse=True) if c}
        times = min(int(left[n]) // c for n, c in bin_.items())
        for n, c in bin_.items():
            left[n] -= times * c
        patterns.append((times, bin_))
    return patterns


def _places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, pieces in a bin, first sequence, offset in the bin), rising."""
    used: dict[int, int] = {}
    places: dict[int, list] = {}
    sequence = 0
    for times, bin_ in patterns:
        offset = 0
        for n, c in bin_.items():
            places.setdefault(n, []).append((used.get(n, 0), c, sequence, offset))
            used[n] = used.get(n, 0) + times * c
            offset += n * c
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in places.items()}


def pack_pieces(pieces: DataFrame, size: int, buckets: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows (doc_id, piece, length, ...); the rows must not change when read again."""
    counts = np.zeros(size + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        counts[n] = c
    places = _places(bin_patterns(counts))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    numbered = dense_sequence(pieces, "length", bucket, ["doc_id", "piece"], "_number")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy())
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, plan = np.nonzero(length == n)[0], places[int(n)]
                first, c, base, off = plan[np.searchsorted(plan[:, 0], number[rows], "right") - 1].T
                sequence[rows] = base + (number[rows] - first) // c
                offset[rows] = off + (number[rows] - first) % c * n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, "_number").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` and pack them into sequences of ``size`` tokens; one row per piece, with its ids if asked for.

    Null text is the empty document (its end id alone).  Repeated rows are packed once each; an empty table gives no rows.  Texts
    of any length are encoded whole; other columns of ``docs`` play no part.
    """
    return pack_pieces(shared_table(token_pieces(docs, tokenizer, size, end_id, id_col, text, with_ids), "pieces"), size)
