"""Personal data by weak supervision.

Candidate spans are found by strict and by loose forms.  Labelers vote on each: its form, gazetteers (domains, address blocks, card issuers,
calling codes, titles), cue words before it, and its shape.  The votes of all candidates of the corpus are counted by pattern; expectation-maximisation over
these counts estimates how reliable each labeler is and how likely a candidate is personal.  A logistic classifier trained on these
likelihoods judges the candidates; spans of the strict forms stay in any case.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsift.llm.common import shared_table

KINDS = ("email", "ip", "card", "phone", "name")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: what failed at its start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[(] ?at ?[\])] ?")
_DOTS = re.compile(r"[A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NAME = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.? ([A-Z][a-zà-ÿ]{2,20})( [A-Z][a-zà-ÿ]{2,20})?\b")
#: Gazetteers.
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Señor Señora".split())
DOMAINS = frozenset("com org net edu gov io de fr es eu uk us info biz".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
CUES = {
    "email": re.compile(r"mail|contact|write|écri|schreib|correo", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|anruf|appel|llam", re.I),
    "name": re.compile(r"name|dear|signed|nom|liebe|cher|querid", re.I),
}
AGAINST = re.compile(r"version|release|build|isbn|issn|order|invoice|serial|part no|section|page|fig", re.I)
LABELERS = ("form", "gazetteer", "context", "shape")
#: Characters before a candidate in which cue words are looked for.
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and a domain, found from the @ signs so that no text takes quadratic time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then start: matches that fail their check are dropped and not tried again."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that touch no base span and not each other, first come by kind."""
    found = []
    for m in _AT.finditer(text) if "at" in text and ("[" in text or "(" in text) else ():
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:  # such runs are disjoint: each ends at its own sign
            start -= 1
        if start < m.start() and (d := _DOTS.match(text, m.end())):
            found.append(("email", start, d.end()))
    found += [("ip", m.start(), m.end()) for m in (_IP6.finditer(text) if ":" in text else ())]
    found += [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    found += [("name", m.start(), m.end()) for m in _NAME.finditer(text)]
    if not found:
        return []
    busy = sorted((s, e) for _, s, e in taken)
    starts, out = np.array([s for s, _ in busy] + [1 << 60]), []
    ends = np.maximum.accumulate(np.array([0] + [e for _, e in busy]))
    accepted: list[tuple[int, int]] = []  # sorted and disjoint, so that only the neighbours can touch a newcomer
    for kind, s, e in found:
        i, k = int(np.searchsorted(starts, e)), bisect_left(accepted, (s, e))
        if ends[i] <= s and (k == 0 or accepted[k - 1][1] <= s) and (k == len(accepted) or accepted[k][0] >= e):
            out.append((kind, s, e))
            accepted.insert(k, (s, e))
    return out


#: What the final classifier sees of a span besides the votes, and how many values each has.
TRAITS = {"length": 4, "digits": 3, "before": 3, "after": 3, "word": 3}


def traits(text: str, start: int, end: int) -> int:
    """Traits of a span as one number: length (below 8, 16, 24 or more), share of digits (none, under half, more), the characters on both sides (none or
    space, alphanumeric, other) and the word before (none, up to three characters, longer)."""
    size, digits = end - start, len(_digits(text[start:end]))
    beside = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    words = text[max(0, start - CONTEXT) : start].split()
    values = (min(3, size // 8), 0 if not digits else 1 if 2 * digits < size else 2, beside(text[start - 1 : start]), beside(text[end : end + 1]), 0 if not words else 1 if len(words[-1]) <= 3 else 2)
    code = 0
    for v, n in zip(values, TRAITS.values(), strict=True):
        code = code * n + v
    return code


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> int:
    """One trit for each labeler (0 against, 1 no vote, 2 for), the first the highest."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    form = 2 if strict else 1
    if kind == "email":
        gazetteer = 2 if re.split(r"[.\])] ?", span)[-1].lower() in DOMAINS else 1
        shape = 0 if ".." in span or span[0] in ".-" else 2
    elif kind == "ip":
        gazetteer = 0 if span.startswith(("0.", "127.", "255.")) else 1
        shape = 0 if max(len(p) for p in re.split(r"[.:]", span)) > 4 else 2
    elif kind == "card":
        gazetteer = 2 if span[0] in "3456" else 0
        shape = 2 if len(set(span)) > 3 else 0
    elif kind == "phone":
        d = _digits(span)
        gazetteer = 2 if span[0] == "+" and d.startswith(CALLING) else 1
        shape = 0 if len(set(d)) < 3 else 2 if span[0] == "+" or "(" in span else 1
    else:
        gazetteer = 2 if span.split()[0].rstrip(".") in TITLES else 1
        shape = 2 if len(span.split()) > 2 else 1
    context = 0 if AGAINST.search(before) else 2 if CUES[kind].search(before) else 1
    code = 0
    for v in (form, gazetteer, context, shape):
        code = code * 3 + v
    return code


def _unpack(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**i % 3 for i in range(len(LABELERS) - 1, -1, -1)], axis=1)


def reliabilities(votes_: np.ndarray, kinds: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with counts.

    Returns the likelihood that each pattern is personal, per labeler the chance of each vote given the class (labelers x class x vote), and the
    share of personal candidates of each kind.  Starts from the majority of votes; one of each vote is added to all counts.
    """
    score = ((votes_ == 2).sum(axis=1) - (votes_ == 0).sum(axis=1)).astype(float)
    likely = 1 / (1 + np.exp(-2 * score))
    for _ in range(rounds):
        both = np.stack([1 - likely, likely])
        chance = np.stack([np.stack([[1 + (both[c] * weight * (votes_[:, j] == v)).sum() for v in range(3)] for c in range(2)]) for j in range(votes_.shape[1])])
        chance /= chance.sum(axis=2, keepdims=True)
        prior = np.array([(1 + (likely * weight * (kinds == k)).sum()) / (2 + (weight * (kinds == k)).sum()) for k in range(len(KINDS))])
        logit = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for j in range(votes_.shape[1]):
            logit += np.log(chance[j, 1, votes_[:, j]]) - np.log(chance[j, 0, votes_[:, j]])
        likely = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return likely, chance, prior


def _one_hot(codes: np.ndarray) -> np.ndarray:
    parts, rest = [], codes
    for n in reversed(TRAITS.values()):
        parts.append((rest[:, None] % n == np.arange(n)).astype(float))
        rest = rest // n
    return np.concatenate(parts[::-1], axis=1)


def _features(votes_: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(kinds), 1)), *[(votes_ == v).astype(float) for v in (0, 2)], (kinds[:, None] == np.arange(len(KINDS))), _one_hot(codes)], axis=1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Classifier:
    """Logistic classifier of candidates by votes, kind and the traits of the span."""

    weights: np.ndarray

    def scores(self, votes_: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return _features(_unpack(votes_), kinds, codes) @ self.weights

    def likelihood(self, votes_: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return _logistic(self.scores(votes_, kinds, codes))


def train(votes_: np.ndarray, kinds: np.ndarray, codes: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 50) -> Classifier:
    """Newton's method on the counted patterns, with the likelihoods of expectation-maximisation, which sees the votes alone, as soft labels."""
    x = _features(_unpack(votes_), kinds, codes)
    target, _, _ = reliabilities(_unpack(votes_), kinds, weight)
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(kinds) else 0):
        p = _logistic(x @ w)
        slope = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return Classifier(w)


SPAN = "array<struct<kind:int,start:int,end:int,strict:boolean,votes:int,traits:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.int32()), ("traits", pa.int32())]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, candidates) for every row; null text counts as empty and whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                body = x.as_py() or ""
                strict = strict_spans(body)
                both = [(s, True) for s in strict] + [(s, False) for s in loose_spans(body, strict)]
                rows.append([{"kind": KINDS.index(k), "start": s, "end": e, "strict": f, "votes": votes(body, k, s, e, f), "traits": traits(body, s, e)} for (k, s, e), f in both])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPAN)], names=["doc_id", "candidates"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, f"doc_id long, candidates {SPAN}")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, found) for every row: spans of kind, start, end (code points, end exclusive), strict, and their likelihood.

    Spans of the strict forms stay; others need a likelihood of ``least``.  Spans come by kind as listed, then start.  Repeated rows come out once
    each, a null id is kept, an empty table gives no rows, and other columns play no part.
    """
    rows = shared_table(candidates(docs, id_col, text), "pii-candidates")
    # One row per pattern: 5 kinds x 81 votes x 324 traits at most, whatever the corpus.
    counted = rows.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.traits").count().toPandas()
    judged = train(*[counted[c].to_numpy(np.int64) for c in ("votes", "kind", "traits")], counted["count"].to_numpy(float))
    # The score is a sum: votes and kind, then traits; each part is a literal table.
    n, m = 3 ** len(LABELERS), int(np.prod(list(TRAITS.values())))
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    zero = judged.scores(np.zeros(m, int), np.zeros(m, int), np.arange(m))
    by_votes = F.array(*[numbers(judged.scores(np.arange(n), np.full(n, k), np.zeros(n, int))) for k in range(len(KINDS))])
    likelihood = lambda c: 1 / (1 + F.exp(-(by_votes[c["kind"]][c["votes"]] + numbers(zero - zero[0])[c["traits"]])))
    spans = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict"), likelihood(c).alias("likelihood")))
    return rows.select("doc_id", F.array_sort(F.filter(spans, lambda s: s["strict"] | (s["likelihood"] >= least))).alias("found"))
