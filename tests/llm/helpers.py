"""Awkward documents, and plain versions of the operators to hold them against."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, _key int, g string, _row int, fp int, _found int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows(seed: int = 1, n: int = 120) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies and shared passages; other columns clash with inner names."""
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "né", "üs", "la", "tri") for b in ("", "n", "st", "ment", "ung", "ción", "o")]
    say = lambda k: " ".join(rnd.choices(vocab, k=k))
    passages = [say(rnd.randint(15, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        text = "\n".join(rnd.choice(passages) if rnd.random() < 0.4 else say(rnd.randint(1, 80)) for _ in range(rnd.randint(1, 4)))
        rows.append([i * 3, text, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", None]), len(text)])
    for i in range(0, n, 6):
        rows.append([1000 + i, rows[i][1], "en", "s0", 1])
        rows.append([2000 + i, rows[i][1].replace(" ", "  ") + "\t", "en", "s1", 1])
        words = rows[i][1].split(" ")
        words[rnd.randrange(len(words))] = "anders"
        rows.append([3000 + i, " ".join(words), "fr", "s0", 1])
    rows += [[5000, None, None, None, None], [5001, "", "en", "s1", 0], [5002, " \t\n", "fr", "s1", 3], [5003, None, "en", "s0", None], [5004, "12 34 !!", "en", "s2", 8]]
    rows += [[5005, "x " * 30_000, "en", "s0", 60_000], [5006, "y" * 50_000, "fr", "s0", 50_000], [5007, passages[0] + " " + passages[0], "en", "s0", 9], [-7, passages[1], "en", "s0", 9]]
    rows.append(list(rows[0]))
    rows.append(list(rows[0]))
    return [(*r, "b", 1, "g", 2, 3, 4) for r in rows]


def awkward(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_exact(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list[tuple]] = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    out = []
    for text, members in groups.items():
        points, keep = min((-len(r[1] or ""), r[0]) for r in members)
        out += [(r[0], keep, len(members), r[0] == keep and len(r[1] or "") == -points, sha(text)) for r in members]
    return sorted(out)


def brute_repeats(rows: list[tuple], size: int = 20) -> list[tuple]:
    first: dict[tuple, tuple] = {}
    words = [WORDS.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for s in range(len(w) - size + 1):
            k, place = tuple(w[s : s + size]), (r[0], s)
            first[k] = min(first.get(k, place), place)
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (r[0], s):
                gone[s : s + size] = [True] * size
        out.append((r[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def brute_fingerprint(text: str | None) -> int:
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids: list, near: np.ndarray) -> list:
    """Smallest id reachable in the graph of a boolean matrix."""
    label = list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    seen: set[int] = set()
    for i in order:
        if i in seen:
            continue
        front = [i]
        while front:
            j = front.pop()
            if j in seen:
                continue
            seen.add(j)
            label[j] = i
            front += np.flatnonzero(near[j]).tolist()
    return [ids[i] for i in label]


def brute_near(rows: list[tuple], distance: int = 3) -> list[tuple]:
    prints = [brute_fingerprint(r[1]) for r in rows]
    near = np.array([[bin(a ^ b).count("1") <= distance for b in prints] for a in prints])
    component = brute_components([r[0] for r in rows], near)
    return sorted((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, component, strict=True))
