"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs that stand for letters, and leaves
words with one space between. The lexicon is learned from labelled rows: terms are words and starts of words (four to
six letters, so that inflected forms share one) that a share of the toxic documents has; a term's weight is its smoothed log
odds between toxic and other documents. Words that start like a term but are at home in other documents are exceptions, as are the phrases given:
a hit inside an exception doesn't count. The weights of a document's hits are summed per hundred words, over the whole text
and over its densest passage (so that a long text doesn't hide one), and a small logistic regression on these two gives the
score.

The fit takes at most max_fit_rows labelled rows (by a hash of doc_id), in folds: the regression sees each row through a
lexicon learned on the other folds, and the model's lexicon is learned on all. Term counts by fold are aggregated by Spark;
the driver sees the terms over the bounds of share and weight and the words that are exceptions to them, all from the bounded
sample and none cut off, and two numbers for each row fitted on.

Cases: null and empty texts have no hits and get the score of no hits; repeated rows are scored one by one; labels that
repeat count once, by their largest; without labels, or of one class alone, the lexicon is empty and every score is
the smoothed rate; an empty table gives no rows. lang, source, labels and doc_id are never read for a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import by_value, id_and_text, per_batch, remove, stored

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "loser bracket")
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {"​": None, "­": None})
_WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
PASSAGE = 600  # characters


def folded(text: str) -> list[str]:
    return _WORD.findall(text.lower().translate(_FOLD))


def terms(words: list[str]) -> set[str]:
    """" word " and " start" for the starts of longer words."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        for n in STARTS:
            if len(w) >= n:
                out.add(f" {w[:n]}")
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Model:
    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def _build(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, w in self.weights.items():
            self.automaton.add_word(t, (len(t), w))
        for e in self.exceptions:
            self.automaton.add_word(e, (len(e), None))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> list[float]:
        words = folded(text) if text else []
        found, safe = [], []
        if words and self.weights:
            if self.automaton is None:
                self._build()
            line = f" {' '.join(words)} "
            for end, (n, w) in self.automaton.iter(line):
                (safe if w is None else found).append((end + 1 - n, end + 1, w or 0.0))
            if safe:  # a hit is safe if some exception that starts no later ends no earlier
                safe.sort()
                starts, reach = [x[0] for x in safe], list(accumulate((x[1] for x in safe), max))
                found = [x for x in found if not ((k := bisect_right(starts, x[0])) and reach[k - 1] >= x[1])]
        best: dict[int, float] = {}  # one weight a word: the largest
        for s, _, w in found:
            best[s] = max(best.get(s, 0.0), w)
        total = inside = densest = 0.0
        at, first = sorted(best), 0
        for s in at:
            total += best[s]
            inside += best[s]
            while s - at[first] > PASSAGE:
                inside -= best[at[first]]
                first += 1
            densest = max(densest, inside)
        return [1.0, math.log1p(100 * total / (1 + len(words))), math.log1p(100 * densest / (1 + min(len(words), PASSAGE // 6)))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.coefficients, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps, halved while they don't help; the first column is the constant and has no penalty."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(b):
        z = x @ b
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * b * b)

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * b)
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def labelled(documents: DataFrame, labels: DataFrame, label: str, max_fit_rows: int, folds: int) -> DataFrame:
    """text, y, fold of at most max_fit_rows labelled documents, none of them held out.

    The chosen labels, a bounded table, are broadcast to the documents."""
    ys = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    ys = ys.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    rows = id_and_text(documents).join(F.broadcast(ys), "doc_id")
    return stored(rows.select("text", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold")), "labelled")


def _term_counts(rows: DataFrame, folds: int) -> DataFrame:
    """term, pos and neg (arrays by fold): documents with the term, by label; counted in each batch before the shuffle."""

    def make():
        def f(batch):
            counts: dict = {}
            for text, y, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for t in terms(folded(text)) if text else ():
                    counts.setdefault(t, [0] * (2 * folds))[2 * fold + (y == 1)] += 1
            cols = list(zip(*counts.values(), strict=True)) or [[]] * (2 * folds)
            return {"term": list(counts)} | {f"{'np'[k % 2]}{k // 2}": cols[k] for k in range(2 * folds)}

        return f

    names = [f"{c}{k}" for k in range(folds) for c in "np"]
    return per_batch(rows.select("text", "y", "fold"), "term string, " + ", ".join(f"{n} long" for n in names), make).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def _lexicon(counts: DataFrame, totals: dict, parts: list[int], least_rows: int, least_share: float, least_weight: float) -> tuple[dict[str, float], list[str]]:
    """Weights of terms, and words that begin like one but are at home in other documents, from the folds named."""
    pos, neg = (sum(totals.get((k, y), 0) for k in parts) for y in (1, 0))
    if not pos or not neg:
        return {}, []
    n, p = (sum((F.col(f"{c}{k}") for k in parts), F.lit(0)) for c in "np")
    odds = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
    known = counts.select("term", p.alias("pos"), n.alias("neg"), odds.alias("w"))
    best = known.filter((F.col("pos") >= max(least_rows, least_share * pos)) & (F.col("w") >= least_weight))
    best = best.orderBy(F.desc(F.col("pos") * F.col("w")), F.desc(F.length("term")), "term").collect()
    weights: dict[str, float] = {}
    for r in best:  # a term that a chosen start covers adds nothing
        if not any(r.term.startswith(t) for t in (r.term[: m + 1] for m in STARTS) if t in weights and t != r.term):
            weights[r.term] = float(r.w)
    starts = [t for t in weights if not t.endswith(" ")]
    if not starts:
        return weights, []
    homes = known.filter(F.col("term").endswith(" ") & (F.col("neg") >= 3) & (F.col("w") < 0))
    begins = F.lit(False)
    for m in STARTS:
        begins = begins | F.left(F.col("term"), F.lit(m + 1)).isin(starts)
    return weights, [r.term for r in homes.filter(begins).orderBy(F.desc("neg"), "term").collect()]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_fit_rows: int = 20_000, least_rows: int = 4, least_share: float = 0.01, least_weight: float = 3.0, exceptions: tuple[str, ...] = EXCEPTIONS, folds: int = 3) -> Model:
    rows = labelled(documents, labels, label, max_fit_rows, folds)
    totals = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    counts = stored(_term_counts(rows, folds), "terms")
    given = [f" {' '.join(folded(e))} " for e in exceptions]

    def model(parts: list[int]) -> Model:
        weights, homes = _lexicon(counts, totals, parts, least_rows, least_share, least_weight)
        return Model(weights, given + homes, [0.0] * 3)

    whole, others = model(list(range(folds))), [model([j for j in range(folds) if j != k]) for k in range(folds)]
    n_pos, n_neg = (sum(v for (_, y), v in totals.items() if y == k) for k in (1, 0))
    whole.coefficients = [math.log((n_pos + 0.5) / (n_neg + 0.5)), 0.0, 0.0]
    if whole.weights:

        def make():
            def f(batch):
                x = [others[k].features(t) for t, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                return {"y": batch.column(1), "x": x}

            return f

        got = per_batch(rows.select("text", "y", "fold"), "y int, x array<double>", make).toPandas()  # three numbers a row, of max_fit_rows at most
        y = got["y"].to_numpy(float)
        if 0 < y.sum() < len(y):
            whole.coefficients = logistic(np.array(got["x"].tolist()), y).tolist()
    remove(rows, counts)
    return whole


def scores(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on)."""
    docs = id_and_text(documents, id_col, text_col)
    shared = by_value(documents.sparkSession, model)

    def make():
        own = shared()

        def f(batch):
            return {"doc_id": batch.column(0), "score": [own.score(t) for t in batch.column(1).to_pylist()]}

        return f

    return per_batch(docs, docs.select("doc_id", F.lit(0.0).alias("score")).schema, make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents with a score below the threshold; all columns are kept and nothing is shuffled."""
    shared = by_value(documents.sparkSession, model)

    def make():
        own = shared()

        def f(batch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return batch.filter(pa.array([own.score(t) < threshold for t in texts], pa.bool_()))

        return f

    return per_batch(documents, documents.schema, make)
