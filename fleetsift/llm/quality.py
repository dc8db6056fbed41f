"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text becomes ``len(STATISTICS)`` numbers.  Each class is a normal distribution over them; its covariance is shrunk towards the
pooled one and towards a multiple of the identity.  A score is the difference of two Mahalanobis log-densities, taken through the
Cholesky factors that are computed once, plus the log prior ratio, divided by a temperature, through the logistic function.

Counts, sums and products of all labelled rows make the classes: they are added up in the tasks, one row of moments per task, class
and fold reaches a sum.  Shrinkage and temperature are those of least cross-validated log loss, again over all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.llm.common import shared_table

STATISTICS = (
    "log_bytes", "log_word_length", "spaces", "capitals", "capital_words", "digits", "stops", "shouts", "symbols", "log_lines", "repeated_lines",
    "log_distinct_words", "most_frequent_word", "repeated_neighbours", "entropy",
)
FOLDS = 4
#: Shares of the pooled covariance and of the identity, and temperatures, that cross-validation chooses from.
TO_POOLED, TO_IDENTITY, TEMPERATURES = (0.02, 0.1, 0.3, 0.6, 1.0), (0.001, 0.01, 0.1), (1.0, 2.0, 4.0, 8.0, 16.0)
GRID = tuple(product(TO_POOLED, TO_IDENTITY))

_UPPER, _LOWER, _DIGIT = slice(0x41, 0x5B), slice(0x61, 0x7B), slice(0x30, 0x3A)
_STOPS, _SHOUTS, _SPACES = [ord(c) for c in ".,;:"], [ord(c) for c in "!?"], [ord(c) for c in " \t\n\v\f\r"]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]


def statistics(text: str | None) -> list[float]:
    """The numbers of a whole text, roots of shares and logarithms of counts; a null text has those of an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), text.split(), [x for x in text.split("\n") if x.strip()]
    letters = int(seen[_UPPER].sum() + seen[_LOWER].sum())
    counts = Counter(words)
    w = max(1, len(words))
    p = seen[seen > 0] / max(1, n)
    root = lambda part, whole: math.sqrt(part / max(1, whole))
    return [
        math.log1p(n), math.log((n + 1) / w), root(int(seen[_SPACES].sum()), n), root(int(seen[_UPPER].sum()), letters),
        root(sum(c for x, c in counts.items() if x[0].isupper()), w), root(int(seen[_DIGIT].sum()), n), root(int(seen[_STOPS].sum()), w),
        root(int(seen[_SHOUTS].sum()), w), root(int(seen[_SYMBOLS].sum()), w), math.log1p(len(lines)), root(len(lines) - len(set(lines)), len(lines)),
        math.log((len(counts) + 1) / (len(words) + 1)), root(max(counts.values(), default=0), w), root(sum(map(eq, words, words[1:])), w),
        float(-(p * np.log(p)).sum()),
    ]


@dataclass
class Moments:
    """Rows, sums and sums of products of one class."""

    n: float
    total: np.ndarray
    product: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.product + other.product)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.product - other.product)

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and scatter (sum of squared deviations)."""
        mean = self.total / max(1.0, self.n)
        return mean, self.product - np.outer(mean, mean) * self.n


@dataclass
class Gaussian:
    """A class: mean, Cholesky factor of the covariance and its log determinant, both cached."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of each row of ``x``, without the constant that all classes share."""
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return -0.5 * ((z * z).sum(axis=0) + self.log_det)


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    low: Gaussian | None
    high: Gaussian | None
    log_prior: float
    temperature: float = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of label 1 against label 0; the prior's alone when a class has never been seen."""
        if self.low is None or self.high is None:
            return np.full(len(x), self.log_prior)
        z = (x - self.shift) / self.scale
        return self.high.log_density(z) - self.low.log_density(z) + self.log_prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -500, 500)))


def fit(moments: dict[int, Moments], to_pooled: float, to_identity: float, temperature: float = 1.0) -> Model:
    """The discriminant of two classes' moments.

    Statistics are scaled by their pooled deviation (a constant one by 1).  A class covariance is (1 - to_pooled) of its own and to_pooled of the pooled one, then
    (1 - to_identity) of that and to_identity times its mean variance (at least a thousandth) on the diagonal, so that factors always exist.
    """
    d = len(STATISTICS)
    none = Moments(0.0, np.zeros(d), np.zeros((d, d)))
    low, high = moments.get(0, none), moments.get(1, none)
    n = low.n + high.n
    prior = math.log((high.n + 1) / (low.n + 1))
    spreads = [m.spread() for m in (low, high)]
    pooled = (spreads[0][1] + spreads[1][1]) / max(1.0, n - 2)
    shift = (low.total + high.total) / max(1.0, n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    outer = np.outer(scale, scale)
    made: list[Gaussian | None] = []
    for m, (mean, scatter) in zip((low, high), spreads, strict=True):
        if m.n == 0:
            made.append(None)
            continue
        cov = (1 - to_pooled) * scatter / max(1.0, m.n - 1) / outer + to_pooled * pooled / outer
        cov = (1 - to_identity) * (cov + cov.T) / 2 + to_identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        values, vectors = np.linalg.eigh(cov)  # rounding may leave a variance below zero
        factor = np.linalg.cholesky((vectors * np.maximum(values, 1e-9)) @ vectors.T + 1e-12 * np.eye(d))
        made.append(Gaussian((mean - shift) / scale, factor, 2 * float(np.log(np.diag(factor)).sum())))
    return Model(shift, scale, made[0], made[1], prior, temperature)


def log_loss(odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -odds, odds)).sum())


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows kept from learning: CRC-32 of the id as text is a multiple of 5 (a null id counts as not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` without its text and with the list of its numbers."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))  # one text at a time as a Python string

    return docs.select(*[c for c in docs.columns if c not in (text, name)], run(F.col(text)).alias(name))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def gather(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """``rows`` (y, fold, statistics) -> moments of each fold and class; added up in the tasks, FOLDS x 2 rows reach the driver."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Moments] = {}
        for b in batches:
            y, fold, x = b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False), _matrix(b.column("statistics"))
            for key in {*zip(fold.tolist(), y.tolist(), strict=True)}:
                part = x[(fold == key[0]) & (y == key[1])]
                m = Moments(float(len(part)), part.sum(axis=0), part.T @ part)
                found[key] = found[key] + m if key in found else m
        cells = [(f, y, i, float(v)) for (f, y), m in found.items() for i, v in enumerate([m.n, *m.total, *m.product.ravel()])]
        yield pa.RecordBatch.from_pylist([dict(zip(("fold", "y", "i", "v"), c, strict=True)) for c in cells], pa.schema([("fold", pa.int32()), ("y", pa.int32()), ("i", pa.int32()), ("v", pa.float64())]))

    sums = rows.select("y", "fold", "statistics").mapInArrow(run, "fold int, y int, i int, v double").groupBy("fold", "y", "i").agg(F.sum("v").alias("v")).collect()
    flat: dict[tuple[int, int], np.ndarray] = {}
    for r in sums:
        flat.setdefault((r.fold, r.y), np.zeros(1 + d + d * d))[r.i] = r.v
    return {k: Moments(v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for k, v in flat.items()}


def choose(rows: DataFrame, parts: dict[tuple[int, int], Moments]) -> tuple[float, float, float]:
    """Shrinkages and temperature of least log loss, each row judged by the classes of the other folds."""
    models = []
    for fold in range(FOLDS):
        rest = {y: m for y in (0, 1) if (m := sum((parts[k] for k in parts if k[1] == y and k[0] != fold), Moments(0.0, np.zeros(len(STATISTICS)), np.zeros((len(STATISTICS),) * 2)))).n}
        models.append([fit(rest, *g) for g in GRID])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.zeros((len(GRID), len(TEMPERATURES)))
        for b in batches:
            y, fold, x = b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False), _matrix(b.column("statistics"))
            for f in set(fold.tolist()):
                here = fold == f
                for i, m in enumerate(models[f]):
                    odds = m.log_odds(x[here])
                    lost[i] += [log_loss(odds / t, y[here]) for t in TEMPERATURES]
        yield pa.RecordBatch.from_arrays([pa.array(range(lost.size), pa.int32()), pa.array(lost.ravel())], names=["i", "lost"])

    lost = rows.select("y", "fold", "statistics").mapInArrow(run, "i int, lost double").groupBy("i").agg(F.sum("lost").alias("lost")).collect()
    best = min(lost, key=lambda r: (r.lost, r.i)).i if lost else 0
    return (*GRID[best // len(TEMPERATURES)], TEMPERATURES[best % len(TEMPERATURES)])


def train(rows: DataFrame, id_col: str = "doc_id") -> Model:
    """``rows`` (id, y, statistics), all of them: the final classes have every row, whatever the number."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int"))
    parts = gather(rows)
    whole = {y: sum((m for k, m in parts.items() if k[1] == y), Moments(0.0, 0.0, 0.0)) for y in {k[1] for k in parts}}  # type: ignore[arg-type]
    return fit(whole, *choose(rows, parts)) if len(whole) == 2 else fit(whole, *GRID[0])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``docs`` (id, text) and ``labels`` (id, label 0 or 1) -> (id, held_out, score, predicted) for every row of ``docs``.

    Learns from rows with a label of 0 or 1 that are not held out, all of them; an id with several labels has the smallest, a repeated document counts as
    often as it occurs.  A null text is scored as an empty one.  Without labels of one class the score is the smoothed share of label 1.  Other columns of either table play
    no part.  The numbers of the texts (some 130 bytes a document) are kept as a table in the shared checkpoint folder, so that texts are read once.
    """
    found = shared_table(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "quality-statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    learnt = shared_table(found.filter(~held_out()).join(known, "doc_id").select("doc_id", "y", "statistics"), "quality-learnt")
    model = train(learnt)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two means and two factors, whatever the corpus

    @F.arrow_udf("double")
    def run(numbers: pa.Array) -> pa.Array:
        return pa.array(shipped.value.scores(_matrix(numbers)), pa.float64())

    scored = found.select("doc_id", held_out().alias("held_out"), run("statistics").alias("score"))
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
