"""Estimators that reduce to Spark aggregates. The driver holds sums of p by p numbers; rows never leave the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.operators import joins
from obsengine.operators.ranks import quantiles, ranked as in_order, with_quantiles
from obsengine.operators.windows import case_ranks, group_softmax
from obsengine.plans.sets import FIRST, gram, in_sets, logit_sums, over_sets, packed, subset_sums


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    info: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        return [wald(n, b, math.sqrt(max(v, 0.0))) for n, b, v in zip(self.names, self.beta, np.diag(self.covariance), strict=True)]


def wald(name: str, estimate: float, se: float) -> tuple:
    """name, estimate, se, z, p (two-sided normal), 95 % interval (1.96), and exp of the estimate; nulls without an error."""
    if not se > 0:
        return (name, float(estimate), float(se), None, None, None, None, math.exp(min(estimate, 700)))
    z = float(estimate / se)
    return (name, float(estimate), float(se), z, math.erfc(abs(z) / math.sqrt(2)), float(estimate - 1.96 * se), float(estimate + 1.96 * se), math.exp(min(estimate, 700)))


# With more columns, sums of products are made by matrices inside tasks instead of a SQL sum each.
WIDE = 8
WALD = "name string, estimate double, se double, z double, p double, low double, high double, ratio double"


def pair_sums(x: Sequence[Column], prefix: str) -> list[Column]:
    return [F.sum(a * b).alias(f"{prefix}{k}") for k, (a, b) in enumerate(combinations_with_replacement(x, 2))]


def symmetric(values: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for v, (i, j) in zip(values, combinations_with_replacement(range(p), 2), strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


# --- standardisation and design


def standardisation(df: DataFrame, names: Sequence[str], reference: Column) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over the reference rows; a column without variance is an error."""
    row = df.filter(reference).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {n: (row[f"{n}_m"], row[f"{n}_s"]) for n in names}
    flat = [n for n, (m, s) in out.items() if m is None or not s or s <= 0]
    if flat:
        raise ValueError(f"no variance in the reference period: {flat}")
    return out


def standardised(df: DataFrame, scale: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({f"{n}{suffix}": (F.col(n) - m) / s for n, (m, s) in scale.items()})


def with_interaction(df: DataFrame, value: str, threshold: float, condition: str, name: str = "exposed") -> tuple[DataFrame, list[str]]:
    """df with a threshold dummy, the condition, and their product."""
    out = df.withColumn(name, (F.col(value) >= threshold).cast("double")).withColumn(f"{name}_x_{condition}", F.col(name) * F.col(condition))
    return out, [name, condition, f"{name}_x_{condition}"]


# --- clustered covariance


def cluster_meat(scores: DataFrame, clusters: Sequence[str], names: Sequence[str], n: int) -> np.ndarray:
    """Sum over clusters of the outer product of their score sums, times G / (G - 1) * (n - 1) / max(n - p, 1)."""
    p = len(names)
    sums = scores.groupBy(*clusters).agg(*[F.sum(c).alias(c) for c in names])
    if p > WIDE:
        g, total = gram(sums, names)
    else:
        row = sums.agg(F.count("*").alias("g"), *pair_sums([F.col(c) for c in names], "m")).first()
        g, total = row["g"], symmetric(row[1:], p)
    return total * (g / max(g - 1, 1)) * ((n - 1) / max(n - p, 1))


def two_way_covariance(scores: DataFrame, bread: np.ndarray, first: str, second: str, names: Sequence[str], n: int) -> tuple[np.ndarray, str]:
    """first + second - both, made symmetric; where that has a negative variance, first alone, and the method says so."""
    meat = cluster_meat(scores, [first], names, n) + cluster_meat(scores, [second], names, n) - cluster_meat(scores, [first, second], names, n)
    v = bread @ meat @ bread
    v = (v + v.T) / 2
    if (np.diag(v) < 0).any() or np.linalg.eigvalsh(v).min() < -1e-10 * max(1.0, np.abs(v).max()):
        v = bread @ cluster_meat(scores, [first], names, n) @ bread
        return (v + v.T) / 2, f"{first} only"
    return v, f"{first} and {second}"


# --- within-set linear probability model


def within_set_lpm(df: DataFrame, set_col: str, outcome: str, names: Sequence[str], first: str, second: str) -> Fit:
    """Least squares of the outcome on the columns, all demeaned within sets; errors clustered two ways."""
    w = Window.partitionBy(set_col)
    dm = df.select(set_col, *dict.fromkeys([first, second]), *[(F.col(c).cast("double") - F.avg(c).over(w)).alias(f"__{k}") for k, c in enumerate([outcome, *names])]).persist()
    xs = [f"__{k + 1}" for k in range(len(names))]
    row = dm.agg(F.count("*").alias("n"), F.count_distinct(set_col).alias("g"), *[F.sum(F.col("__0") * F.col(x)).alias(f"y{x}") for x in xs], *pair_sums([F.col(x) for x in xs], "x")).first()
    n, sets, p = row["n"], row["g"], len(xs)
    xy, xx = np.array(row[2 : 2 + p], float), symmetric(row[2 + p :], p)
    bread = np.linalg.pinv(xx)
    beta = bread @ xy
    resid = F.col("__0") - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    scores = dm.withColumn("__e", resid).withColumns({f"s{k}": F.col(x) * F.col("__e") for k, x in enumerate(xs)})
    s = [f"s{k}" for k in range(p)]
    covariance, method = two_way_covariance(scores, bread, first, second, s, n)
    norms = scores.groupBy(set_col).agg(F.sqrt(sum((F.pow(F.sum(c), 2) for c in s), F.lit(0.0))).alias("norm"))
    d = quantiles(norms, [], F.col("norm"), [0.99, 1.0]).first() or (None, None)
    rmse = scores.agg(F.sqrt(F.avg(F.col("__e") * F.col("__e")))).first()[0]
    dm.unpersist()
    return Fit(list(names), beta, covariance, n, {"sets": sets, "method": method, "rmse": rmse, "p99_score": d[0], "max_score": d[1]})


def set_score_norms(df: DataFrame, set_col: str, outcome: str, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """set, norm: length of each set's score at beta, for influence screening."""
    w = Window.partitionBy(set_col)
    dm = df.select(set_col, *[(F.col(c).cast("double") - F.avg(c).over(w)).alias(f"__{k}") for k, c in enumerate([outcome, *names])])
    e = F.col("__0") - sum((F.col(f"__{k + 1}") * float(b) for k, b in enumerate(beta)), F.lit(0.0))
    sums = dm.withColumn("__e", e).groupBy(set_col).agg(*[F.sum(F.col(f"__{k + 1}") * F.col("__e")).alias(f"s{k}") for k in range(len(names))])
    return sums.select(set_col, F.sqrt(sum((F.pow(F.col(f"s{k}"), 2) for k in range(len(names))), F.lit(0.0))).alias("norm"))


# --- conditional logit


def linear_score(names: Sequence[str], beta: Sequence[float]) -> Column:
    return sum((F.col(c).cast("double") * float(b) for c, b in zip(names, beta, strict=True)), F.lit(0.0))


def cond_logit_sums(df: DataFrame, set_col: str, case: str, names: Sequence[str], beta: Sequence[float]) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Sets, negative log likelihood, its gradient and the information at beta, in one pass. One case a set."""
    p = len(names)
    x = group_softmax(df.withColumn("__eta", linear_score(names, beta)), [set_col], "__eta")
    own = F.col(case).cast("double")
    sets = x.groupBy(set_col).agg(
        F.sum(own * (F.col("log_sum_exp") - F.col("__eta"))).alias("loss"),
        *[F.sum(F.col(c) * own).alias(f"c{k}") for k, c in enumerate(names)],
        *[F.sum(F.col(c) * F.col("probability")).alias(f"e{k}") for k, c in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j]) * F.col("probability")).alias(f"q{i}_{j}") for i, j in combinations_with_replacement(range(p), 2)],
    )
    row = sets.agg(F.count("*"), F.sum("loss"), *[F.sum(F.col(f"e{k}") - F.col(f"c{k}")) for k in range(p)], *[F.sum(F.col(f"q{i}_{j}") - F.col(f"e{i}") * F.col(f"e{j}")) for i, j in combinations_with_replacement(range(p), 2)]).first()
    return row[0], row[1] or 0.0, np.array([v or 0.0 for v in row[2 : 2 + p]]), symmetric(row[2 + p :], p)


def set_sums(rows: DataFrame, beta: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """As cond_logit_sums(), of in_sets(), for any number of columns."""
    p = len(beta)
    v = over_sets(rows, 2 + p + p * p, lambda v: logit_sums(v[:, :, FIRST:], v[:, :, 0], beta))
    return int(v[0]), v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p)


def cond_logit(df: DataFrame, set_col: str, case: str, names: Sequence[str], ridge: float = 0.0, first: str | None = None, second: str | None = None, rounds: int = 40, tolerance: float = 1e-9) -> Fit:
    """Newton steps with halving on the likelihood of one case a set, plus ridge / 2 |beta|^2; one Spark pass a step.

    The frame is dealt by set once; beyond WIDE columns a step is one pass of matrices over sets. Where the information is singular, a small ridge is added for the step. Converged when
    the largest gradient is below the tolerance times the number of sets; otherwise an error."""
    p = len(names)
    rows = df.select(set_col, *dict.fromkeys([c for c in (first, second) if c]), F.col(case).cast("int").alias("__case"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = in_sets(rows, set_col, "__case", names).persist() if p > WIDE else rows.repartition(set_col).persist()

    def at(b):
        n, loss, g, h = set_sums(rows, b) if p > WIDE else cond_logit_sums(rows, set_col, "__case", names, b)
        return n, loss + 0.5 * ridge * float(b @ b), g + ridge * b, h + ridge * np.eye(p)

    beta = np.zeros(p)
    n, loss, g, h = at(beta)
    for _ in range(rounds):
        if np.abs(g).max() < tolerance * max(1, n):
            break
        step = np.linalg.solve(h + (1e-8 * max(1.0, np.trace(h))) * np.eye(p), -g)
        size = 1.0
        while True:
            tried = at(beta + size * step)
            if tried[1] <= loss + 1e-12 or size < 1e-4:
                break
            size /= 2
        beta, (n, loss, g, h) = beta + size * step, tried
    if not np.abs(g).max() < tolerance * max(1, n):
        rows.unpersist()
        raise RuntimeError(f"conditional logit did not converge: gradient {np.abs(g).max():.3g}")
    bread = np.linalg.pinv(h)
    covariance, method = bread, "model"
    if first:
        own = df.select(set_col, *dict.fromkeys([c for c in (first, second) if c]), F.col(case).cast("int").alias("__case"), *[F.col(c).cast("double").alias(c) for c in names]) if p > WIDE else rows
        x = group_softmax(own.withColumn("__eta", linear_score(names, beta)), [set_col], "__eta")
        scores = x.withColumns({f"s{k}": (F.col("__case") - F.col("probability")) * F.col(c) for k, c in enumerate(names)})
        s = [f"s{k}" for k in range(p)]
        covariance, method = two_way_covariance(scores, bread, first, second, s, n) if second else (bread @ cluster_meat(scores, [first], s, n) @ bread, first)
    rows.unpersist()
    return Fit(list(names), beta, covariance, n, {"loss": loss, "method": method, "gradient": float(np.abs(g).max())})


def ranking_metrics(df: DataFrame, set_col: str, case: str, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """One row: sets, mean log loss (probabilities kept above 1e-15), share of top-1, mean reciprocal rank, uniform loss."""
    x = group_softmax(df.withColumn("__eta", linear_score(names, beta)), [set_col], "__eta")
    loss = x.groupBy(set_col).agg(F.sum(F.when(F.col(case) == 1, -F.log(F.greatest("probability", F.lit(1e-15))))).alias("loss"), F.log(F.count("*")).alias("uniform"))
    ranks = case_ranks(x, [set_col], "__eta", F.col(case) == 1)
    return loss.join(ranks, set_col).agg(F.count("*").alias("sets"), F.avg("loss").alias("log_loss"), F.avg("top1").alias("top1"), F.avg(1 / F.col("average_rank")).alias("mrr"), F.avg("uniform").alias("uniform_loss"))


def _columns(numbers: int | Sequence[int], p: int) -> slice | list[int]:
    """The columns from a number on, or those of these numbers, as a slice if they are in a row."""
    numbers = range(numbers, numbers + p) if isinstance(numbers, int) else list(numbers)
    return slice(numbers[0], numbers[0] + p) if list(numbers) == list(range(numbers[0], numbers[0] + p)) else list(numbers)


def _kinds(v: np.ndarray, masks: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which masks hold, and which of the sets these are, for every combination of masks that sets have."""
    kinds, which = np.unique(v[:, 0, list(masks)] > 0, axis=0, return_inverse=True)
    for i, kind in enumerate(kinds):
        if kind.any():
            yield kind, np.flatnonzero(which.ravel() == i)


def _information(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    n, m, p = x.shape
    mean = np.einsum("nm,nmp->np", q, x)
    flat = x.reshape(n * m, p)
    return (flat * q.reshape(-1, 1)).T @ flat - mean.T @ mean


def fits_in_step(rows: DataFrame, problems: Sequence[tuple[int, float]], first_name: int | Sequence[int], p: int, rounds: int = 60, tolerance: float = 1e-7) -> np.ndarray:
    """Ridge conditional logits of many problems, all in the same passes: a row of coefficients each.

    rows: in_sets() or packed() with columns of 0 and 1, one of which says for each problem (its number among all columns, its
    penalty) which sets it is fitted on. first_name: number of the first column, or of each. A pass tries one step of every
    problem that has not converged, with its own loss and gradient; the information is that of its sets at the mean of all
    coefficients, made once for every combination of masks, and at its own where that was too slow (a gradient of over a
    quarter of the one before, or a step that doesn't lower the loss, which is halved). Converged when the largest gradient is
    below the tolerance times the number of sets, and so is the step, measured by the information, against the root of it; else
    an error. The step that is left needs no pass and is made."""
    k, columns = len(problems), _columns(first_name, p)
    masks = sorted({c for c, _ in problems})
    of = np.array([masks.index(c) for c, _ in problems])
    beta, trial, size = np.zeros((k, p)), np.zeros((k, p)), np.ones(k)
    state: list = [None] * k
    done, slow = np.zeros(k, bool), np.zeros(k, bool)

    def at(betas, todo):
        own, shared = todo[slow[todo]], sorted(set(of[todo[~slow[todo]]].tolist()))
        about = betas[todo].mean(axis=0)

        def each(v):
            out, info, mine = np.zeros((k, 2 + p)), np.zeros((len(masks), p, p)), np.zeros((len(own), p, p))
            for kind, sets in _kinds(v, masks):
                js = todo[kind[of[todo]]]
                if not len(js):
                    continue
                x, y = np.ascontiguousarray(v[sets][:, :, columns]), v[sets, :, 0]
                n, m, _ = x.shape
                flat = x.reshape(n * m, p)
                eta = (flat @ betas[js].T).reshape(n, m, -1)
                top = eta.max(axis=1, keepdims=True)
                q = np.exp(eta - top)
                z = q.sum(axis=1, keepdims=True)
                q /= z
                out[js, 0] += n
                out[js, 1] += (top + np.log(z)).sum(axis=(0, 1)) - np.einsum("nmj,nm->j", eta, y)
                out[js, 2:] += (q - y[:, :, None]).reshape(n * m, -1).T @ flat
                here = [c for c in shared if kind[c]]
                if here:
                    e = (flat @ about).reshape(n, m)
                    e = np.exp(e - e.max(axis=1, keepdims=True))
                    info[here] += _information(x, e / e.sum(axis=1, keepdims=True))
                for i, j in enumerate(own):
                    if kind[of[j]]:
                        mine[i] += _information(x, q[:, :, np.flatnonzero(js == j)[0]])
            return np.concatenate((out.ravel(), info[shared].ravel(), mine.ravel()))

        got = over_sets(rows, k * (2 + p) + (len(shared) + len(own)) * p * p, each)
        sums, info = got[: k * (2 + p)].reshape(k, 2 + p), got[k * (2 + p) :].reshape(-1, p, p)
        out = {}
        for j in todo:
            b, ridge = betas[j], problems[j][1]
            h = info[len(shared) + own.tolist().index(j)] if slow[j] else info[shared.index(of[j])]
            out[j] = sums[j, 0], sums[j, 1] + 0.5 * ridge * b @ b, sums[j, 2:] + ridge * b, h + ridge * np.eye(p)
        return out

    for _ in range(rounds):
        todo = np.flatnonzero(~done)
        if not len(todo):
            return beta
        tried = at(trial, todo)
        for j in todo:
            before = state[j]
            if before is None or tried[j][1] <= before[1] + 1e-12 * max(1.0, abs(before[1])) or size[j] < 1e-4:
                beta[j], state[j], size[j] = trial[j], tried[j], 1.0
                n, _, g, h = state[j]
                step = np.linalg.solve(h + (1e-12 * max(1.0, np.trace(h))) * np.eye(p), -g)
                done[j] = np.abs(g).max() < tolerance * max(1, n) and -g @ step < tolerance**2 * max(1, n)
                slow[j] |= before is not None and np.abs(g).max() > np.abs(before[2]).max() / 4
            else:
                size[j] /= 2
                slow[j] = True
            n, _, g, h = state[j]
            trial[j] = beta[j] + size[j] * np.linalg.solve(h + (1e-12 * max(1.0, np.trace(h))) * np.eye(p), -g)
            if done[j]:
                beta[j] = trial[j]
    raise RuntimeError(f"{int((~done).sum())} conditional logits did not converge")


def held_out_losses(rows: DataFrame, masks: Sequence[int], betas: np.ndarray, first_name: int | Sequence[int]) -> list[tuple[int, float, float, float]]:
    """Of each mask (a column that says which sets are held out) and coefficients: sets, mean log loss (probabilities kept above
    1e-15), share of cases ranked first (ties share), mean reciprocal of the average rank."""
    columns, every = _columns(first_name, betas.shape[1]), sorted(set(masks))
    of = np.array([every.index(c) for c in masks])

    def each(v):
        out = np.zeros((len(masks), 4))
        for kind, sets in _kinds(v, every):
            js = np.flatnonzero(kind[of])
            x, ys = np.ascontiguousarray(v[sets][:, :, columns]), v[sets, :, 0, None] > 0
            eta = (x.reshape(-1, x.shape[2]) @ betas[js].T).reshape(*x.shape[:2], -1)
            q = np.exp(eta - eta.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            own = np.sum(np.where(ys, eta, 0.0), axis=1, keepdims=True)
            above, tied = np.sum(eta > own + 1e-12, axis=1), np.sum(np.abs(eta - own) <= 1e-12, axis=1)
            losses = -np.log(np.maximum(np.sum(q * ys, axis=1), 1e-15))
            out[js] += np.stack([np.full(len(js), len(sets)), losses.sum(axis=0), np.where(above == 0, 1 / tied, 0.0).sum(axis=0), (1 / (above + (tied + 1) / 2)).sum(axis=0)], axis=1)
        return out.ravel()

    got = over_sets(rows, 4 * len(masks), each).reshape(-1, 4)
    return [(int(n), *(float(x / max(n, 1)) for x in rest)) for n, *rest in got]


def fold_marks(df: DataFrame, set_col: str, cell: str, folds: DataFrame, block: str, n_folds: int) -> DataFrame:
    """A row a set: test_<k> and train_<k>, whether the set is held out in fold k, or may be fitted on, as it shares no cell with a
    set that is. No other columns of df are moved."""
    rows = df.select(set_col, cell, block).join(folds, block)
    of_set = rows.groupBy(set_col).agg(F.min("fold").alias("__fold"))
    rows = rows.select(set_col, cell).join(of_set, set_col)
    touched = rows.groupBy(cell).agg(F.collect_set("__fold").alias("__folds"))  # n_folds numbers at most
    near = rows.join(touched, cell).groupBy(set_col).agg(F.min("__fold").alias("__fold"), F.array_distinct(F.flatten(F.collect_list("__folds"))).alias("__near"))
    marks = [m for k in range(n_folds) for m in ((F.col("__fold") == k).cast("double").alias(f"test_{k}"), (~F.array_contains("__near", k)).cast("double").alias(f"train_{k}"))]
    return near.select(set_col, *marks)


def with_folds(df: DataFrame, set_col: str, cell: str, folds: DataFrame, block: str, n_folds: int) -> DataFrame:
    """df with the marks of fold_marks()."""
    return df.join(folds.select(block), block, "left_semi").join(fold_marks(df, set_col, cell, folds, block, n_folds), set_col)


def in_folds(df: DataFrame, set_col: str, case: str, cell: str, names: Sequence[str], folds: DataFrame, block: str, n_folds: int, widths: dict[str, int] | None = None) -> DataFrame:
    """packed() rows of df with train_<k> of all folds, then test_<k>, then the names."""
    marks = [f"{part}_{k}" for part in ("train", "test") for k in range(n_folds)]
    return packed(df.join(folds.select(block), block, "left_semi"), set_col, case, names, marks, fold_marks(df, set_col, cell, folds, block, n_folds), widths)


def fold_losses(rows: DataFrame, n_folds: int, numbers: Sequence[int], penalties: Sequence[float]) -> list[tuple[float, float, bool]]:
    """As grid_search(), of in_folds() and the numbers of the names to fit among its names."""
    every = [(k, float(penalty)) for penalty in penalties for k in range(n_folds)]
    at = [FIRST + 2 * n_folds + i for i in numbers]
    betas = fits_in_step(rows, [(FIRST + k, penalty) for k, penalty in every], at, len(at))
    losses = held_out_losses(rows, [FIRST + n_folds + k for k, _ in every], betas, at)
    got = [(float(penalty), float(np.mean([x[1] for x, (_, q) in zip(losses, every, strict=True) if q == penalty and x[0]]))) for penalty in map(float, penalties)]
    best = min(got, key=lambda r: (r[1], -r[0]))[0]
    return [(q, x, q == best) for q, x in got]


def grid_search(df: DataFrame, set_col: str, case: str, cell: str, names: Sequence[str], folds: DataFrame, block: str, n_folds: int, penalties: Sequence[float]) -> DataFrame:
    """penalty, mean held-out log loss over purged spatial folds, chosen (least loss; ties to the larger penalty). All
    penalties and folds are fitted in the same passes."""
    rows = in_folds(df, set_col, case, cell, names, folds, block, n_folds).persist()
    got = fold_losses(rows, n_folds, range(len(names)), penalties)
    rows.unpersist()
    return df.sparkSession.createDataFrame(got, "penalty double, log_loss double, chosen boolean")


def multi_case_logit(df: DataFrame, set_col: str, outcome: str, names: Sequence[str], rounds: int = 40, tolerance: float = 1e-6, most_rows: int = 10_000) -> Fit:
    """Conditional logit with any number of positives a set; sets without or with only positives tell nothing.

    Rows are dealt by set and sorted once; each Newton step is one pass of subset_sums(). Converged when the largest gradient
    is below the tolerance times the number of sets; otherwise an error. A set of over most_rows rows is an error."""
    p = len(names)
    rows = in_sets(df, set_col, outcome, names, most_rows=most_rows, mixed=True).persist()

    def sums(beta):
        # A block of sets holds polynomials with p * p numbers a coefficient.
        v = over_sets(rows, 2 + p + p * p, lambda v: subset_sums(v[:, :, FIRST:], v[:, :, 0], beta), 4_000_000 // (p * p))
        return int(v[0]), v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p)

    beta = np.zeros(p)
    n, loss, g, h = sums(beta)
    for _ in range(rounds):
        if np.abs(g).max() < tolerance * max(1, n):
            break
        step, size = np.linalg.solve(h + 1e-9 * np.eye(p), -g), 1.0
        tried = sums(beta + step)
        while not tried[1] <= loss + 1e-12 and size > 1e-4:
            size /= 2
            tried = sums(beta + size * step)
        beta, (n, loss, g, h) = beta + size * step, tried
    rows.unpersist()
    if not np.abs(g).max() < tolerance * max(1, n):
        raise RuntimeError(f"conditional logit of several cases did not converge: gradient {np.abs(g).max():.3g}")
    return Fit(list(names), beta, np.linalg.pinv(h), n, {"loss": loss})


# --- multiple testing, bootstrap, small tests


def holm(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str] = ()) -> DataFrame:
    """df with p_holm: step-down adjusted within the family, at most 1, never falling with p; null p stays null."""
    w = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *tie)
    m = F.count(p).over(Window.partitionBy(*family))
    out = df.withColumn("__raw", F.col(p) * (m - F.row_number().over(w) + 1))
    return out.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))))).drop("__raw")


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """One row: n, mean, and 2.5 and 97.5 percentiles of the mean over replicates.

    Each row's weight in a replicate is a Poisson(1) draw from a hash of key, replicate and seed - the limit of drawing n of
    n - so replicates need no numbering of rows and no join, and don't depend on partitions. Each row is read once: a task
    sums all replicates of a batch before anything is shuffled."""
    import pyarrow as pa

    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    rows = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(value).cast("double").alias("x")).filter("x is not null")

    def sums(batches):
        steps = np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        w, wx = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            h, x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(h), 1000):
                z = h[k : k + 1000, None] + steps[None, :]
                z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                n = np.searchsorted(cuts, (z ^ z >> np.uint64(31)) / 2.0**64, side="right")
                w += n.sum(axis=0)
                wx += x[k : k + 1000] @ n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(w), pa.array(wx)], ["r", "w", "wx"])

    means = rows.mapInArrow(sums, "r int, w double, wx double").groupBy("r").agg((F.sum("wx") / F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count("m").alias("replicates"))  # a row a replicate
    return df.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).crossJoin(ends).select("n", "mean", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"), "replicates")


def rate_ratio(df: DataFrame, exposed: Column, count: str, exposure: str, by: Sequence[str] = ()) -> DataFrame:
    """Two Poisson rates: counts, rates, ratio, its interval (half a count added), score statistic."""
    a = df.groupBy(*by).agg(F.sum(F.when(exposed, F.col(count))).cast("double").alias("c1"), F.sum(F.when(~exposed, F.col(count))).cast("double").alias("c2"), F.sum(F.when(exposed, F.col(exposure))).cast("double").alias("a1"), F.sum(F.when(~exposed, F.col(exposure))).cast("double").alias("a2"))
    ratio = (F.col("c1") / F.col("a1")) / (F.col("c2") / F.col("a2"))
    half = F.log(((F.col("c1") + 0.5) / F.col("a1")) / ((F.col("c2") + 0.5) / F.col("a2")))
    se = F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c2") + 0.5))
    k = F.col("a1") / F.col("a2")
    return a.select(*by, "c1", "c2", (F.col("c1") / F.col("a1")).alias("rate1"), (F.col("c2") / F.col("a2")).alias("rate2"), ratio.alias("ratio"), F.exp(half - 1.96 * se).alias("low"), F.exp(half + 1.96 * se).alias("high"), ((F.col("c1") - F.col("c2") * k) / F.sqrt((F.col("c1") + F.col("c2")) * k)).alias("score"))


def fixed_effect_poisson(df: DataFrame, unit: str, exposed: Column, count: str, exposure: str, tests: int = 1, rounds: int = 50) -> Fit:
    """Log rate ratio with a fixed effect a unit and log-exposure offset: given a unit's total, its exposed count is
    binomial, so each Newton step is one aggregate over units; not converging is an error. Errors clustered by unit; p times `tests`, at most 1."""
    units = df.groupBy(unit).agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).cast("double").alias(n) for n, c, v in (("y1", exposed, count), ("y0", ~exposed, count), ("a1", exposed, exposure), ("a0", ~exposed, exposure))])
    units = units.filter("a1 > 0 and a0 > 0 and y1 + y0 > 0").persist()
    b = 0.0
    for _ in range(rounds):
        q = F.col("a1") * math.exp(b) / (F.col("a1") * math.exp(b) + F.col("a0"))
        u = F.col("y1") - (F.col("y1") + F.col("y0")) * q
        row = units.agg(F.sum(u), F.sum((F.col("y1") + F.col("y0")) * q * (1 - q)), F.sum(u * u), F.count("*")).first()
        step = float(np.clip(row[0] / row[1], -2, 2)) if row[1] else 0.0
        b += step
        if row[3] == 0 or not row[1] or abs(step) < 1e-10:
            break
    units.unpersist()
    if row[3] and (not row[1] or not abs(step) < 1e-10):
        raise RuntimeError(f"fixed-effect rates did not converge: {b:.3g} after a step of {step:.3g}")
    n = row[3]
    se2 = (row[2] / row[1] ** 2) * (n / max(n - 1, 1)) if n and row[1] else 0.0
    fit = Fit(["exposed"], np.array([b]), np.array([[se2]]), n)
    p = wald("exposed", b, math.sqrt(se2))[4]
    fit.info["p_bonferroni"] = 1.0 if p is None else min(1.0, p * tests)
    return fit


def rank_sum(ranked: DataFrame, by: Sequence[str], group: Column, value: str, least: int = 5) -> DataFrame:
    """Two-group medians and rank-sum z (ties corrected) from average_ranks(); null with fewer than `least` on a side.
    Rows without a rank or a side don't count."""
    ranked = ranked.filter(F.col("average_rank").isNotNull() & group.isNotNull())
    out = ranked.groupBy(*by).agg(F.count_if(group).cast("double").alias("n1"), F.count_if(~group).cast("double").alias("n2"), F.sum(F.when(group, F.col("average_rank"))).alias("w"), F.sum(F.col("tie_size") * F.col("tie_size") - 1).cast("double").alias("t"))
    for name, side in (("median1", group), ("median2", ~group)):
        out = with_quantiles(out, ranked, by, F.when(side, F.col(value)), {name: 0.5})
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("t") / (n * (n - 1)))
    z = (F.col("w") - F.col("n1") * (n + 1) / 2) / F.sqrt(var)
    return out.select(*by, "n1", "n2", "median1", "median2", F.when((F.col("n1") >= least) & (F.col("n2") >= least) & (var > 0), z).alias("z"))


def interval_class(low: Column, high: Column, null_value: float = 1.0) -> Column:
    return F.when(low > null_value, "higher").when(high < null_value, "lower").when(low.isNotNull() & high.isNotNull(), "inconclusive")


# --- families and robustness: loops over the same fits


def model_family(df: DataFrame, set_col: str, outcomes: Sequence[str], names: Sequence[str], first: str, second: str, least_sets: int = 200, least_varying: int = 50) -> DataFrame:
    """The within-set model for each outcome that has enough sets and enough sets that vary, first coefficient, Holm over the family."""
    rows = []
    for outcome in outcomes:
        by = df.groupBy(set_col).agg((F.min(outcome) != F.max(outcome)).alias("v"))
        sets, varying = by.agg(F.count("*"), F.count_if("v")).first()
        if sets < least_sets or varying < least_varying:
            rows.append((outcome, sets, varying, "insufficient_support", None, None, None))
            continue
        fit = within_set_lpm(df, set_col, outcome, names, first, second)
        _, b, se, _, p, *_ = fit.rows()[0]
        rows.append((outcome, sets, varying, "fitted", b, se, p))
    out = df.sparkSession.createDataFrame(rows, "outcome string, sets long, varying long, status string, estimate double, se double, p double")
    return holm(out.withColumn("__f", F.lit(1)), ["__f"], "p", ["outcome"]).drop("__f")


def by_subset(df: DataFrame, subsets: dict[str, Column], fit) -> DataFrame:
    """fit (a function from a frame to a Fit) on each named subset: leave-one-year-out, single years, thresholds, trims."""
    rows = [(name, *r) for name, keep in subsets.items() for r in fit(df.filter(keep)).rows()]
    return df.sparkSession.createDataFrame(rows, "subset string, " + WALD)


def subset_fits(df: DataFrame, subsets: dict[str, tuple[Column, str]], set_col: str, names: Sequence[str], first: str, second: str) -> DataFrame:
    """The within-set model's first coefficient for each (rows kept, outcome): subset, sets, sets whose outcome varies, sets of
    the frame that the subset leaves out, and the Wald columns."""
    every, rows = df.select(set_col).distinct().count(), []
    for label, (keep, outcome) in subsets.items():
        kept = df.filter(keep)
        varying = kept.groupBy(set_col).agg((F.min(outcome) != F.max(outcome)).alias("v")).agg(F.count_if("v")).first()[0]
        fit = within_set_lpm(kept, set_col, outcome, names, first, second)
        rows.append((label, fit.info["sets"], varying, every - fit.info["sets"], *fit.rows()[0]))
    return df.sparkSession.createDataFrame(rows, "subset string, sets long, varying_sets long, excluded_sets long, " + WALD)


def trimmed_refit(df: DataFrame, set_col: str, outcome: str, names: Sequence[str], first: str, second: str, shares: Sequence[float] = (0.005, 0.01)) -> DataFrame:
    """The within-set model on all sets, and without the share of sets of largest score."""
    fit = within_set_lpm(df, set_col, outcome, names, first, second)
    norms = in_order(set_score_norms(df, set_col, outcome, names, fit.beta), [F.desc("norm"), F.col(set_col)], "__r").persist()
    n, rows = norms.count(), [("all", *fit.rows()[0])]
    for share in shares:
        kept = norms.filter(F.col("__r") > math.ceil(n * share)).select(set_col)
        rows.append((f"without top {share:g}", *within_set_lpm(df.join(kept, set_col, "left_semi"), set_col, outcome, names, first, second).rows()[0]))
    norms.unpersist()
    return df.sparkSession.createDataFrame(rows, "subset string, " + WALD)


def pre_exposure_control(cases: DataFrame, outcomes: DataFrame, key: str, set_col: str, size: int, cell: str, year: str, flag: str, share: str, names: Sequence[str], first: str, second: str, back: int = 2) -> DataFrame:
    """The negative control: does what comes later already tell what came `back` years before?

    cases: key, set_col, cell, year and the columns; outcomes: cell, year, flag, share. The outcome of `back` years earlier is put
    under the later year (shifted()) and joined; sets that aren't whole then go. On sets that are whole with both outcomes
    (common_support()), the model is also fitted on the differences. subset (pre, post minus pre, share post minus pre), rows,
    and the Wald columns."""
    whole = lambda df: df.withColumn("__n", F.count("*").over(Window.partitionBy(set_col))).filter(F.col("__n") == size).drop("__n")
    post = whole(cases.join(outcomes, [cell, year]))
    pre = whole(cases.join(joins.shifted(outcomes, year, back), [cell, year]))
    both = joins.common_support(post, pre.select(key, flag, share), [key], set_col, size)
    both = both.withColumn("__flag", F.col(flag) - F.col(f"{flag}_b")).withColumn("__share", F.col(share) - F.col(f"{share}_b"))
    out = []
    for label, df, outcome in (("pre", pre, flag), ("post minus pre", both, "__flag"), ("share post minus pre", both, "__share")):
        fit = within_set_lpm(df, set_col, outcome, names, first, second)
        out.append((label, fit.n, *fit.rows()[0]))
    return cases.sparkSession.createDataFrame(out, "subset string, rows long, " + WALD)


def before_and_after(df: DataFrame, set_col: str, post: str, pre: str, names: Sequence[str], first: str, second: str) -> DataFrame:
    """The negative control: the model on the outcome, on the outcome before exposure, and on their difference."""
    both = df.withColumn("__change", F.col(post) - F.col(pre))
    rows = [(n, *within_set_lpm(both, set_col, c, names, first, second).rows()[0]) for n, c in (("post", post), ("pre", pre), ("post minus pre", "__change"))]
    return df.sparkSession.createDataFrame(rows, "subset string, " + WALD)
