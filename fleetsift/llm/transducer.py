"""Minimal acyclic transducers: sorted terms as one automaton whose path sums are the terms' ordinals.

A transducer is built from sorted terms in one pass: what hangs below the part that the next term shares is final and is merged with an equal state.  An arc
carries the number of terms that lie before those behind it, so that the arcs of a term add up to its place in the order.  Several transducers, each for a
stretch of the order, are read as one; text runs through them byte by byte, all terms of a batch in step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Terms that advance together.
STEP = 1 << 18
#: Bytes that tell which stretch a term belongs to.
PREFIX = 8


def build(terms: Iterable[bytes]) -> bytes:
    """Terms in ascending order, each once -> arcs by state and byte, as bytes that ``Vocabulary`` reads."""
    known: dict[tuple, int] = {}
    sizes: list[int] = []
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

    def close(depth: int, last: bytes) -> None:
        """Merge the states below ``depth`` of the last term's path."""
        while len(path) > depth + 1:
            (final,), arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, arcs)))

    def state(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        if key not in known:
            known[key] = len(known)
            sizes.append(final + sum(sizes[to] for _, to in arcs))
        return known[key]

    last = b""
    for term in terms:
        shared = 0
        while shared < min(len(last), len(term)) and last[shared] == term[shared]:
            shared += 1
        close(shared, last)
        path.extend(([False], []) for _ in range(len(term) - shared))
        path[-1][0][0] = True
        last = term
    close(0, last)
    root = state(path[0][0][0], path[0][1])
    arc_state, arc_byte, arc_to, arc_skip, final_states = [], [], [], [], []
    for key, number in known.items():  # in order of their numbers
        skip = int(key[0])
        if key[0]:
            final_states.append(number)
        for byte, to in key[1:]:
            arc_state.append(number)
            arc_byte.append(byte)
            arc_to.append(to)
            arc_skip.append(skip)
            skip += sizes[to]
    head = np.array([root, len(known), len(arc_to), len(final_states)], "<i4")
    return b"".join([head.tobytes(), *[np.array(x, "<i4").tobytes() for x in (arc_state, arc_to, arc_skip, final_states)], np.array(arc_byte, "u1").tobytes()])


class Vocabulary:
    """Transducers of several languages and stretches, read as one table of arcs.

    ``shards``: (language, first term, ordinal of the first term, bytes of ``build``).  Terms that share their first eight bytes lie in one shard of a language.
    """

    def __init__(self, shards: list[tuple[str, bytes, int, bytes]]) -> None:
        keys, to, skip, final, self._routes = [], [], [], [], {}
        states = arcs = 0
        for lang, first, offset, blob in sorted(shards, key=lambda s: (s[0], s[1])):
            root, n_states, n_arcs, n_final = np.frombuffer(blob, "<i4", 4)
            parts = np.frombuffer(blob, "<i4", 3 * n_arcs + n_final, 16)
            byte = np.frombuffer(blob, "u1", n_arcs, 16 + 4 * (3 * n_arcs + n_final))
            keys.append((parts[:n_arcs].astype(np.int64) + states) << 8 | byte)
            to.append(parts[n_arcs : 2 * n_arcs] + np.int32(states))
            skip.append(parts[2 * n_arcs : 3 * n_arcs])
            final.append(np.bincount(parts[3 * n_arcs :], minlength=n_states).astype(bool))
            self._routes.setdefault(lang, []).append((int.from_bytes(first[:PREFIX].ljust(PREFIX, b"\0"), "big"), states + int(root), offset))
            states, arcs = states + int(n_states), arcs + int(n_arcs)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self._keys, self._to, self._skip, self._final = join(keys, np.int64), join(to, np.int32), join(skip, np.int32), join(final, bool)
        self._routes = {k: (np.array([r[0] for r in v], np.uint64), np.array([r[1] for r in v], np.int64), np.array([r[2] for r in v], np.int64)) for k, v in self._routes.items()}

    def __contains__(self, lang: str) -> bool:
        return lang in self._routes

    def ordinals(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
        """Ordinal of each term ``raw[start:end]``, -1 where the language's vocabulary has no such term."""
        firsts, roots, offsets = self._routes[lang]
        prefix = np.zeros(len(starts), np.uint64)
        for j in range(PREFIX):
            at = starts + j
            inside = at < ends
            prefix = prefix << np.uint64(8) | np.where(inside, raw[np.where(inside, at, 0)], 0).astype(np.uint64)
        shard = np.maximum(np.searchsorted(firsts, prefix, "right") - 1, 0)
        found = np.full(len(starts), -1, np.int64)
        live, state, place, at, end = np.arange(len(starts)), roots[shard], offsets[shard], starts, ends
        while len(live) and len(self._keys):
            key = state << 8 | raw[at]
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[arc] == key
            live, arc, place, at, end = live[hit], arc[hit], place[hit], at[hit] + 1, end[hit]
            place, state = place + self._skip[arc], self._to[arc].astype(np.int64)
            over = at == end
            ended = over & self._final[state]
            found[live[ended]] = place[ended]
            live, state, place, at, end = live[~over], state[~over], place[~over], at[~over], end[~over]
        return found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, A-Z in lower case, and where each text begins and the last one ends."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw | ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) << np.uint8(5), bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)


def spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every term: a run of letters a-z (in lower case by now) and bytes of other characters than ASCII, within one text."""
    inside = ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(raw) + 1, bool)
    border[bounds] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1


def stretches(n: int) -> Iterator[slice]:
    for at in range(0, n, STEP):
        yield slice(at, at + STEP)
