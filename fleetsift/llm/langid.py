"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1-, 2- and 3-grams of the lower-cased text, weighted by relative frequency times inverse document frequency.
Document frequencies are counted over all rows that may be learnt from.  The weights are trained by follow-the-regularised-leader
(proximal, per coordinate) with elastic-net penalties on a bounded sample of each language, and a temperature is fitted to a second such
sample.  Prediction reads whole texts: every n-gram of a text adds its row of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
#: N-grams looked up at a time, so that a very long text takes no more memory than a short one.
STEP = 1 << 18


def grams(text: str, dims: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of ``text``, in parts; ``dims`` is a power of two."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for at in range(0, len(codes), STEP):
        part = codes[at : at + STEP + ORDERS[-1] - 1]
        h = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint32(n)) * np.uint32(2654435769)
            h ^= h >> np.uint32(15)
            yield ((h[:STEP] * np.uint32(2246822519)) >> shift).astype(np.int32)


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode category L occurs: digits, fractions, enclosed and Roman numerals are none."""
    return text is not None and _LETTER.search(text) is not None


def bag(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their relative frequencies."""
    counts = np.zeros(dims, np.int64)
    for part in grams(text, dims):
        counts += np.bincount(part, minlength=dims)
    at = np.nonzero(counts)[0]
    return at, counts[at] / max(1, counts.sum())


def document_frequencies(docs: DataFrame, text: str, dims: int) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows with a letter; counted per task before they are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, block, used = np.zeros(dims, np.int64), 0, np.zeros((64, dims), np.uint8), 0
        for b in batches:
            for x in b.column(0):
                body = x.as_py()
                if not has_letter(body):
                    continue
                for part in grams(body, dims):
                    block[used, part] = 1
                used, seen = used + 1, seen + 1
                if used == len(block):
                    total += block.sum(axis=0, dtype=np.int64)
                    block[:], used = 0, 0
        total += block.sum(axis=0, dtype=np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row per bucket
    df, n = np.zeros(dims, np.int64), 0
    for bucket, count in zip(rows["bucket"], rows["n"], strict=True):
        if bucket < 0:
            n = int(count)
        else:
            df[bucket] = count
    return df, n


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        """Probability of each language."""
        total, n = np.zeros(len(self.languages)), 0
        for part in grams(text, len(self.weights)):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return softmax((total / max(1, n) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (dims + 1) x classes; the last row is the bias, which is not penalised by ``l1``."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    penalty = np.full((dims + 1, 1), l1)
    penalty[dims] = 0

    def solve(at: np.ndarray) -> np.ndarray:
        zz, p = z[at], penalty[at]
        return np.where(np.abs(zz) <= p, 0.0, -(zz - np.sign(zz) * p) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, dims), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return solve(np.arange(dims + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean())

    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _sample(docs: DataFrame, id_col: str, text: str, lang: str, per_language: int, dims: int) -> pd.DataFrame:
    """Bags of at most ``per_language`` rows of each language, those with the smallest hash of their id."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}  # one row per language
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col(lang) == k, F.lit(min(1.0, 1.3 * per_language / n + 20 / n))).otherwise(share)
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30))
    near = docs.withColumn("_h", hashed).filter(F.col("_h") < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, y, *bag(x, dims)) for h, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True) if has_letter(x)]
            h, y, at, tf = zip(*rows, strict=True) if rows else ([], [], [], [])
            arrays = [pa.array(h, pa.int64()), pa.array(y, pa.string()), pa.array(list(at), pa.list_(pa.int32())), pa.array(list(tf), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "lang", "at", "tf"])

    bags = near.select("_h", lang, text).mapInArrow(run, "h long, lang string, at array<int>, tf array<float>").toPandas()
    return bags.sort_values(["lang", "h"]).groupby("lang", sort=True).head(per_language).reset_index(drop=True)


class NothingToLearn(ValueError):
    """No labelled row has a letter."""


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = 1 << 16, per_language: int = 600, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 3) -> Model:
    """Fit a model to the rows of ``docs`` where ``learnable`` holds and ``lang`` is not null.

    Document frequencies count all of them.  The classifier sees at most ``per_language`` rows of each language (a documented bound), of
    which every fifth is kept for the temperature.  Raises ``NothingToLearn`` when no row can be learnt from.
    """
    usable = docs.filter(learnable & F.col(lang).isNotNull()).select(id_col, text, lang)
    df, n = document_frequencies(usable, text, dims)
    bags = _sample(usable, id_col, text, lang, per_language, dims)
    if bags.empty:
        raise NothingToLearn("no labelled text to learn from")
    idf = np.log((1 + n) / (1 + df)) + 1.0
    languages = sorted(bags["lang"].unique())
    number = {k: i for i, k in enumerate(languages)}
    rows = []
    for at, tf, k in zip(bags["at"], bags["tf"], bags["lang"], strict=True):
        at = np.asarray(at, np.int64)
        rows.append((at, np.asarray(tf, np.float64) * idf[at] * SCALE, number[k]))
    fit, held = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10], [r for i, r in enumerate(rows) if i % 5 == 0 or len(rows) < 10]
    w = ftrl(fit, dims, len(languages), alpha, beta, l1, l2, epochs)
    logits = np.array([x @ w[at] + w[dims] for at, x, _ in held])
    temperature = fit_temperature(logits, np.array([y for _, _, y in held]))
    return Model(languages, (w[:dims] * idf[:, None] * SCALE).astype(np.float32), w[dims], temperature)


#: Relative frequencies are small; scaled so that gradients are of the order of one.
SCALE = 30.0
NO_LANGUAGE = "und"


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability; (``und``, 1.0) for a null text or one without a letter.

    Whole texts are read and no other column plays a part; one that has the name of an added column is replaced.  Ties go to the first language by name.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        m, names_, scores = shipped.value, [], []
        for x in texts:  # one text at a time as a Python string
            t = x.as_py()
            if not has_letter(t):
                names_.append(NO_LANGUAGE)
                scores.append(1.0)
                continue
            p = m.scores(t)
            names_.append(m.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return pa.StructArray.from_arrays([pa.array(names_, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    # Exploded as by ``session.pin``: a filter on the result would otherwise predict each text again, in a second Python worker per task.
    once = F.explode_outer(F.array(run(F.col(text))))
    found = docs.select(F.struct(*[c for c in docs.columns if c not in names]).alias("_row"), once.alias("_found"))
    return found.select("_row.*", F.col("_found.lang").alias(names[0]), F.col("_found.score").alias(names[1]))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows kept from learning: CRC-32 of the id as text, modulo 4, is 2 (a null id counts as not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the labelled rows that are not held out, None if no such row has a letter."""
    try:
        return train(docs, ~held_out(id_col), id_col, text, lang)
    except NothingToLearn:
        return None


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the labelled rows that are not held out and predict every row; an empty or unlabelled table predicts ``und``."""
    model = learn(docs, id_col, text, lang)
    if model is None:
        return docs.select(*[c for c in docs.columns if c not in names], F.lit(NO_LANGUAGE).alias(names[0]), F.lit(0.0).alias(names[1]))
    return predict(docs, model, text, names)


def least_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", lang: str = "lang", share: float = 0.001) -> float:
    """The score below which a language is no finding: half way between chance and what all but ``share`` of the held-out rows reach that are predicted rightly.

    Chance is one over the learned languages, so the bound follows their number.  It is trusted as far as the model surely beats chance on the held-out rows (three
    standard errors off its share of right answers): a model that does not, or that has no row to show it, rejects nothing by its score.
    """
    chance = 1 / len(model.languages)
    found = predict(docs.filter(held_out(id_col) & F.col(lang).isNotNull()).select(text, lang), model, text, ("_pred", "_score")).filter(F.col("_pred") != NO_LANGUAGE)
    right = F.col("_pred") == F.col(lang)
    reached, skill, n = found.agg(F.percentile_approx(F.when(right, F.col("_score")), share, 10_000), F.avg(right.cast("double")), F.count("*")).first()
    if reached is None or chance == 1:
        return 0.0
    sure = skill - 3 * (skill * (1 - skill) / n + 1 / n**2) ** 0.5
    return chance + (reached - chance) / 2 * max(0.0, (sure - chance) / (1 - chance)) - 1e-9
