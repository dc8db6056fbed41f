"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node has a failure link to where matching goes on when no child fits, with the number of tokens that
are popped on the way worked out beforehand; greedy longest-match lengths then take one pass over the bytes of a word and build no
piece.  Words are cut by the pattern of the vocabulary; their counts are remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, functions as F

#: Word counts kept per Python worker before they are forgotten, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 1 << 20, 48


class Automaton(dict):
    """Longest-match automaton over byte tokens; also the memory of word -> (tokens, unknown bytes)."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        super().__init__()
        self.child: list[dict[int, int]] = [{}]
        self.is_token = [False]
        for token in tokens:
            at = 0
            for b in token:
                nxt = self.child[at].get(b)
                if nxt is None:
                    nxt = self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.is_token.append(False)
                at = nxt
            self.is_token[at] = at > 0
        self._link()

    def _link(self) -> None:
        """Breadth first: where a node falls back to (-1: nowhere, the text so far has no cut) and the tokens popped on the way."""
        n = len(self.child)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for parent in level:
                for b, node in self.child[parent].items():
                    below.append(node)
                    if self.is_token[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and b not in self.child[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.child[at][b], count
            level = below

    def lengths(self, word: bytes) -> tuple[int, int]:
        """(tokens, unknown bytes) of a word; a byte at which no token starts is unknown, stands alone, and matching starts anew after it."""
        child, fail, popped = self.child, self.fail, self.popped
        at = count = unknown = 0
        i, n = 0, len(word)
        while i < n:
            nxt = child[at].get(word[i])
            if nxt is not None:
                at, i = nxt, i + 1
                continue
            if at == 0:
                unknown, i = unknown + 1, i + 1
                continue
            if fail[at] < 0:
                return self._plainly(word)
            count, at = count + popped[at], fail[at]
        while at:
            if fail[at] < 0:
                return self._plainly(word)
            count, at = count + popped[at], fail[at]
        return count, unknown

    def _plainly(self, word: bytes) -> tuple[int, int]:
        """Step by step, for words with a byte that starts no token inside a longer path (never with a byte-level vocabulary)."""
        count = unknown = i = 0
        while i < len(word):
            at, best, j = 0, 0, i
            while j < len(word) and (nxt := self.child[at].get(word[j])) is not None:
                at, j = nxt, j + 1
                if self.is_token[at]:
                    best = j
            count, unknown, i = count + (best > 0), unknown + (best == 0), best or i + 1
        return count, unknown

    def __missing__(self, word: str) -> tuple[int, int]:
        found = self.lengths(word.encode())
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a file of base64 tokens, one a line with its rank."""
    with open(path, "rb") as f:
        return Automaton(base64.b64decode(line.split()[0]) for line in f if line.strip())


def token_counts(docs: DataFrame, vocabulary: str, pattern: str = PATTERN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row: words by ``pattern``, greedy longest-match tokens of the vocabulary.

    A null or empty text has none of them.  Whole texts are read; repeated rows come out once each and other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words_of = automaton(vocabulary), regex.compile(pattern).findall
        for b in batches:
            rows = []
            for x in b.column(1):
                words = words_of(x.as_py() or "")
                found = list(map(known.__getitem__, words))
                rows.append((len(words), sum(f[0] for f in found), sum(f[1] for f in found)))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
