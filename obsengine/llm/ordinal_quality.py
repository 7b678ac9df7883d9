"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > t) = logistic(w . x - threshold_t): one set of weights on hashed words and a few shape measures of the text,
and ordered thresholds, kept in order as a first one and positive gaps. The model gives the expected grade and, for
selection, the tail probability of a grade of at least one asked for.

The fit takes at most max_fit_rows rated documents (by a hash of doc_id); their sparse features, bounded by max_fit_rows
times distinct words, are made by Spark and fitted on the driver. Scoring is one pass over all texts without a shuffle.

Cases: null and empty texts have no words and are scored by shape alone; repeated rows are scored one by one; ratings
that repeat count once, by the largest; null ratings are left out; without ratings the model has one grade, 0; grades
that no rating has get probability near 0; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import by_value, id_and_text, per_batch, raw_texts, stored
from obsengine.llm.substring_dedup import word_hashes

SHAPE = 8


def features(raw: bytes | None, bits: int) -> tuple[np.ndarray, float, list[float]]:
    """Distinct hashed words, the value each has, and shape measures."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.int64), 0.0, [1.0] + [0.0] * (SHAPE - 1)
    hashed = np.unique(word_hashes([b" ".join(words)]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)
    n, lines = len(data), raw.split(b"\n")
    letters = np.count_nonzero(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))
    upper, digits = np.count_nonzero((data >= 65) & (data <= 90)), np.count_nonzero((data >= 48) & (data <= 57))
    shape = [0.0, letters / n, upper / n, digits / n, len(set(words)) / len(words), np.log1p(len(words)) / 10, n / len(words) / 10, len(set(lines)) / len(lines)]
    return hashed, 1 / np.sqrt(len(hashed)), shape


class Model:
    """weights of hashed words, of shape measures, and thresholds in ascending order (one fewer than grades)."""

    def __init__(self, bits: int, weights: np.ndarray, shape: np.ndarray, thresholds: np.ndarray):
        self.bits, self.weights, self.shape, self.thresholds = bits, weights, shape, thresholds

    def tails(self, raw: bytes | None) -> np.ndarray:
        """P(grade > t) for each threshold: never rising."""
        hashed, value, shape = features(raw, self.bits)
        z = float(self.weights[hashed].sum() * value + np.dot(self.shape, shape))
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -30, 30)))


def loss_and_gradient(theta: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the grades and half the ridge, and its gradient. theta: weights of words, of shape
    measures, and the first threshold with the logarithms of the gaps to the next."""
    w, s, g = theta
    n, k = len(grades), len(g)
    below, above = np.maximum(grades - 1, 0), np.minimum(grades, k - 1)
    cuts = g[0] + np.concatenate(([0.0], np.cumsum(np.exp(g[1:]))))
    z = np.bincount(rows, w[cols] * values, minlength=n) + shape @ s
    up = np.where(grades > 0, 1 / (1 + np.exp(-np.clip(z - cuts[below], -30, 30))), 1.0)  # P(grade >= own)
    over = np.where(grades < k, 1 / (1 + np.exp(-np.clip(z - cuts[above], -30, 30))), 0.0)  # P(grade > own)
    p = np.maximum(up - over, 1e-9)
    d_up, d_over = up * (1 - up) / p, over * (1 - over) / p  # of log p
    dz = -(d_up - d_over) / n
    d_cuts = np.zeros(k)
    np.add.at(d_cuts, below, np.where(grades > 0, d_up, 0) / n)
    np.add.at(d_cuts, above, np.where(grades < k, -d_over, 0) / n)
    tail = np.cumsum(d_cuts[::-1])[::-1]
    gradient = [np.bincount(cols, values * dz[rows], minlength=len(w)) + ridge * w, shape.T @ dz + ridge * s, np.concatenate((tail[:1], tail[1:] * np.exp(g[1:])))]
    return float(-np.log(p).mean() + 0.5 * ridge * (w @ w + s @ s)), gradient


def fit_rows(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: np.ndarray, grades: np.ndarray, n_grades: int, bits: int, rounds: int = 150, ridge: float = 1e-4, rate: float = 0.3) -> Model:
    """Adam on loss_and_gradient()."""
    k = n_grades - 1
    share = np.array([np.clip(np.mean(grades > t), 1e-3, 1 - 1e-3) for t in range(k)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    theta = [np.zeros(1 << bits), np.zeros(SHAPE), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))]
    moment, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        for j, d in enumerate(loss_and_gradient(theta, rows, cols, values, shape, grades, ridge)[1]):
            moment[j] = 0.9 * moment[j] + 0.1 * d
            square[j] = 0.999 * square[j] + 0.001 * d * d
            theta[j] = theta[j] - rate * (1 - step / (rounds + 1)) * (moment[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)
    w, s, g = theta
    return Model(bits, w, s, g[0] + np.concatenate(([0.0], np.cumsum(np.exp(g[1:])))))


def fit(documents: DataFrame, ratings: DataFrame, grade: Column, max_fit_rows: int = 8_000, bits: int = 16) -> Model:
    """ratings: doc_id and what grade (0, 1, ...) is made of."""
    gs = ratings.select("doc_id", grade.cast("int").alias("g")).filter("doc_id is not null and g >= 0").groupBy("doc_id").agg(F.max("g").alias("g"))
    gs = gs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    chosen = stored(id_and_text(documents).join(F.broadcast(gs), "doc_id").select("text", "g"), "rated")

    def make():
        def f(batch):
            made = [features(t, bits) for t in raw_texts(batch)]
            return {"g": batch.column(1), "cols": [m[0].astype(np.int32).tobytes() for m in made], "value": [m[1] for m in made], "shape": [m[2] for m in made]}

        return f

    got = per_batch(chosen, "g int, cols binary, value double, shape array<double>", make).toPandas()
    if not len(got) or got["g"].max() < 1:
        return Model(bits, np.zeros(1 << bits), np.zeros(SHAPE), np.zeros(0))
    cols = [np.frombuffer(c, np.int32) for c in got["cols"]]
    sizes = np.array([len(c) for c in cols])
    rows = np.repeat(np.arange(len(cols), dtype=np.int32), sizes)
    grades = got["g"].to_numpy(np.int64)
    return fit_rows(rows, np.concatenate(cols), np.repeat(got["value"].to_numpy(), sizes), np.array(got["shape"].tolist()), grades, int(grades.max()) + 1, bits)


def scores(documents: DataFrame, model: Model, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_prob: P(grade >= at_least), 0 if the model has no such grade."""
    docs = id_and_text(documents, id_col, text_col)
    shared = by_value(documents.sparkSession, model)

    def make():
        own = shared()

        def f(batch):
            tails = [own.tails(t) for t in raw_texts(batch)]
            return {"doc_id": batch.column(0), "expected_grade": [float(t.sum()) for t in tails], "tail_prob": [float(t[at_least - 1]) if 1 <= at_least <= len(t) else float(at_least < 1) for t in tails]}

        return f

    schema = T.StructType([docs.schema["doc_id"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())])
    return per_batch(docs, schema, make)


def keep_quality(documents: DataFrame, model: Model, at_least: int = 1, least_prob: float = 0.5, text_col: str = "text") -> DataFrame:
    """documents whose tail probability reaches least_prob; all columns are kept."""
    shared = by_value(documents.sparkSession, model)

    def make():
        own = shared()

        def f(batch):
            keep = []
            for t in raw_texts(batch, text_col):
                tails = own.tails(t)
                keep.append(at_least < 1 or (at_least <= len(tails) and tails[at_least - 1] >= least_prob))
            return batch.filter(pa.array(keep, pa.bool_()))

        return f

    return per_batch(documents, documents.schema, make)
