"""Sums over whole matched sets, in blocks of sets of one size: numpy inside tasks, one vector a task, vectors added in a tree.

A likelihood's gradient and information have p + p * p numbers. As SQL aggregates these would be thousands of expressions at the
widths of embeddings; here a task multiplies matrices and hands on one vector, and no plan grows with p."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def added(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of v, arrays of `size` numbers, a row a task: added in about the square root of as many tasks, and then in the driver."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    some = max(1, math.isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sum((np.array(r.v) for r in vectors.repartition(some).mapInArrow(add, "v array<double>").collect()), np.zeros(size))


def gram(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray]:
    """Rows, and the sum over rows of the outer product of the columns with themselves."""
    p = len(names)

    def run(batches):
        total = np.zeros(1 + p * p)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += np.concatenate(([len(x)], (x.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    got = added(rows.mapInArrow(run, "v array<double>"), 1 + p * p)
    return int(got[0]), got[1:].reshape(p, p)


def in_sets(df: DataFrame, set_col: str, case: str, names: Sequence[str], keep: Sequence[str] = (), most_rows: int = 10_000, mixed: bool = False) -> DataFrame:
    """case, size of the set, its number of cases, `keep` and the names, as doubles, dealt and sorted so that a task meets whole
    sets of one size and number of cases in a row. mixed: only sets that have cases and others. A set of over most_rows rows
    is an error."""
    w = Window.partitionBy("__h", "__s")
    rows = df.select(F.xxhash64(set_col).alias("__h"), F.col(set_col).cast("string").alias("__s"), F.col(case).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in (*keep, *names)])
    rows = rows.repartition("__h").withColumn("__m", F.count("*").over(w)).withColumn("__k", F.sum("__y").over(w))
    rows = rows.filter("__k > 0 and __k < __m") if mixed else rows
    rows = rows.withColumn("__m", F.when(F.col("__m") <= most_rows, F.col("__m")).otherwise(F.raise_error(F.concat(F.lit("too large a set: "), F.col("__s"))).cast("long")).cast("double"))
    return rows.sortWithinPartitions("__m", "__k", "__h", "__s").select("__y", "__m", "__k", *keep, *names)


FIRST = 3  # of in_sets(), the number of the first column of keep and names


PACKED = "n long, m long, arrays array<int>, d binary, f binary"


def _blocks(batches, matrix: Callable[[pa.RecordBatch], np.ndarray], most_numbers: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """n, m and the rows of n whole sets of one size m and number of cases, of rows in the order of in_sets()."""
    rest = None
    for batch in batches:
        new = matrix(batch)
        rest = new if rest is None else np.concatenate((rest, new))
        at = 0
        while at < len(rest):
            m = int(rest[at, 1])
            other = (rest[at:, 1] != m) | (rest[at:, 2] != rest[at, 2])
            n = min((int(np.argmax(other)) if other.any() else len(other)) // m, max(1, most_numbers // (m * rest.shape[1])))
            if not n:  # the rest of this set is in the next batch
                break
            yield n, m, rest[at : at + n * m]
            at += n * m
        rest = rest[at:]


def _unpacked(batches) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for n, m, arrays, d, f in zip(*batch.columns, strict=True):
            n, m, arrays = n.as_py(), m.as_py(), arrays.as_py()
            d = np.frombuffer(d.as_buffer()).reshape(n * m, -1)
            v = np.empty((n * m, d.shape[1] + len(arrays)))
            v[:, np.setdiff1d(np.arange(v.shape[1]), arrays)] = d
            if arrays:
                f = f.as_buffer()
                v[:, arrays] = np.frombuffer(f, f"f{f.size // (n * m * len(arrays))}").reshape(n * m, -1)
            yield n, m, v


def numbers(names: Sequence[str], own: Sequence[str], widths: dict[str, int]) -> list[int]:
    """Which numbers the columns `own` have among those of `names`, where a column of arrays has as many as widths says."""
    first, at = {}, 0
    for c in names:
        first[c], at = at, at + widths.get(c, 1)
    return [i for c in own for i in range(first[c], first[c] + widths.get(c, 1))]


def packed(df: DataFrame, set_col: str, case: str, names: Sequence[str], keep: Sequence[str] = (), marks: DataFrame | None = None, widths: dict[str, int] | None = None, most_rows: int = 10_000, most_numbers: int = 1_000_000) -> DataFrame:
    """The rows of in_sets() as PACKED, a row a block of whole sets of one size and number of cases: what many passes read. Rows are
    shuffled once. marks: columns of keep that df hasn't, a row a set; sets that it hasn't are left out. widths: of names that
    hold arrays, how many numbers each array has (any other array is an error); arrays of type float stay so."""
    widths, types = widths or {}, dict(df.dtypes)
    kind = "float" if all(types[c] == "array<float>" for c in widths) else "double"
    whole = lambda c: F.when(F.size(c) == widths[c], F.col(c).cast(f"array<{kind}>")).otherwise(F.raise_error(F.lit(f"{c} has not {widths[c]} numbers")))
    arrays = [c for c in names if c in widths]
    order = ["__y", "__m", "__k", *keep, *names]
    rest = [c for c in order if c not in widths]
    rows = df.select(F.col(set_col).cast("string").alias("__s"), F.col(case).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in rest[3:] if c in types], *([F.concat(*map(whole, arrays)).alias("__f")] if arrays else []))
    if marks is not None:
        rows = rows.join(marks.withColumn(set_col, F.col(set_col).cast("string")).withColumnRenamed(set_col, "__s"), "__s")
    w = Window.partitionBy("__s")
    rows = rows.withColumn("__m", F.count("*").over(w)).withColumn("__k", F.sum("__y").over(w))
    rows = rows.withColumn("__m", F.when(F.col("__m") <= most_rows, F.col("__m")).otherwise(F.raise_error(F.concat(F.lit("too large a set: "), F.col("__s"))).cast("long")).cast("double"))
    rows = rows.sortWithinPartitions("__m", "__k", "__s").select(*rest, *(["__f"] if arrays else []))
    doubles, single = numbers(order, rest, widths), numbers(order, arrays, widths)

    def matrix(batch):
        out = np.empty((batch.num_rows, len(doubles) + len(single)))
        for i, c in zip(doubles, batch.columns, strict=False):
            out[:, i] = c.to_numpy(zero_copy_only=False)
        if single:
            out[:, single] = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return out

    def run(batches):
        for n, m, v in _blocks(batches, matrix, most_numbers):
            parts = np.ascontiguousarray(v[:, doubles]).tobytes(), v[:, single].astype("f4" if kind == "float" else "f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m]), pa.array([single], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in parts]], ["n", "m", "arrays", "d", "f"])

    return rows.mapInArrow(run, PACKED)


def over_sets(rows: DataFrame, size: int, each: Callable[[np.ndarray], np.ndarray], most_numbers: int = 4_000_000) -> np.ndarray:
    """Sum over all tasks of each(values of n sets of one size m and number of cases: n, m, columns), a vector of `size` numbers.
    rows: in_sets() or packed(). A block of sets has at most about most_numbers values, one of packed() what that says."""
    ready = "d" in rows.columns and dict(rows.dtypes)["d"] == "binary"

    def run(batches):
        total = np.zeros(size)
        matrix = lambda batch: np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        for n, m, v in _unpacked(batches) if ready else _blocks(batches, matrix, most_numbers):
            total += each(v.reshape(n, m, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return added(rows.mapInArrow(run, "v array<double>"), size)


def logit_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sets, negative log likelihood, gradient and information of sets (n, m, p) with one case each, as one vector."""
    n, m, p = x.shape
    eta = x @ beta
    top = eta.max(axis=1, keepdims=True)
    e = np.exp(eta - top)
    z = e.sum(axis=1, keepdims=True)
    q = e / z
    mean = np.einsum("nm,nmp->np", q, x)
    flat = x.reshape(n * m, p)
    second = (flat * q.reshape(-1, 1)).T @ flat
    loss = np.sum((top + np.log(z))[:, 0] - np.sum(eta * y, axis=1))
    return np.concatenate(([n, loss], (mean - np.einsum("nm,nmp->np", y, x)).sum(axis=0), (second - mean.T @ mean).ravel()))


def _product(a: Sequence[np.ndarray], b: Sequence[np.ndarray], most: int) -> list[np.ndarray]:
    """Products of polynomials, degrees up to `most`, with first and second moments: f, f of x, f of x x'."""
    (fa, ga, ha), (fb, gb, hb) = a, b
    da, db = fa.shape[2], fb.shape[2]
    d = min(da + db - 1, most + 1)
    f, g, h = (np.zeros((*x.shape[:2], d, *x.shape[3:])) for x in (fa, ga, ha))
    for j in range(min(da, d)):
        k = min(db, d - j)
        here = slice(j, j + k)
        one, gx, hx = fa[:, :, j, None], ga[:, :, j, None], ha[:, :, j, None]
        f[:, :, here] += one * fb[:, :, :k]
        g[:, :, here] += one[..., None] * gb[:, :, :k] + gx * fb[:, :, :k, None]
        cross = gx[..., :, None] * gb[:, :, :k, None, :]
        h[:, :, here] += one[..., None, None] * hb[:, :, :k] + hx * fb[:, :, :k, None, None] + cross + np.swapaxes(cross, -1, -2)
    return [f, g, h]


def subset_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sets, negative log likelihood, gradient and information of sets (n, m, p) with the same number k of cases, 0 < k < m.

    The likelihood of a set's cases is over all of its subsets of size k. Members are tilted to odds whose expected number is k:
    the elementary symmetric functions are then probabilities of the number of members drawn, which neither overflow nor
    vanish near k. They come by products of the polynomials of halves, with the moments of what is drawn beside them."""
    n, m, p = x.shape
    k = int(y[0].sum())
    x = x - x.mean(axis=1, keepdims=True)  # changes nothing, as all subsets have k members, but keeps second moments small
    eta = x @ beta
    low, high = -eta.max(axis=1) - 40.0 - math.log(m), -eta.min(axis=1) + 40.0 + math.log(m)
    for _ in range(100):
        middle = (low + high) / 2
        few = (1 / (1 + np.exp(-np.clip(eta + middle[:, None], -700, 700)))).sum(axis=1) < k
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    tilt = ((low + high) / 2)[:, None]
    q = 1 / (1 + np.exp(-np.clip(eta + tilt, -700, 700)))
    width = 1 << (m - 1).bit_length()
    drawn, at = np.zeros((n, width)), np.zeros((n, width, p))  # members that fill up are never drawn
    drawn[:, :m], at[:, :m] = q, x
    f = np.stack((1 - drawn, drawn), axis=2)
    g = np.zeros((n, width, 2, p))
    g[:, :, 1] = drawn[:, :, None] * at
    h = np.zeros((n, width, 2, p, p))
    h[:, :, 1] = g[:, :, 1, :, None] * at[:, :, None, :]
    level = [f, g, h]
    while level[0].shape[1] > 1:
        level = _product([v[:, 0::2] for v in level], [v[:, 1::2] for v in level], k)
    f, g, h = (v[:, 0, k] for v in level)
    mean = g / f[:, None]
    log_all = np.log(f) + np.logaddexp(0, eta + tilt).sum(axis=1) - k * tilt[:, 0]
    loss = log_all - (eta * y).sum(axis=1)
    info = h / f[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return np.concatenate(([n, loss.sum()], (mean - (x * y[:, :, None]).sum(axis=1)).sum(axis=0), info.sum(axis=0).ravel()))
