"""Ablation of feature families: penalties are chosen and a rehearsal is run on the development years, the choice is frozen,
and the locked rows are tested once, by the frozen choice alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.operators import matching
from obsengine.plans.models import fits_in_step, fold_losses, held_out_losses, in_folds
from obsengine.plans.sets import FIRST, numbers, packed
from obsengine.sources.readers import create_lock

REVISION = "family-ablation-1"
METRICS = "family string, penalty double, sets long, log_loss double, top1 double, mrr double"


def all_names(families: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(n for own in families.values() for n in own))


def frame_print(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows and two sums of hashes of the columns, the same for the same rows in any order."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum_of_hashes"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *columns)), F.lit(0)).alias("xor_of_hashes"))


def evaluated(df: DataFrame, fit_on: Column, test_on: Column, set_col: str, case: str, families: dict[str, list[str]], penalties: dict[str, float], widths: dict[str, int] | None = None) -> DataFrame:
    """METRICS of each family, fitted on the sets of fit_on and tested on those of test_on. Rows are dealt once for all families."""
    out, names = [], all_names(families)
    marked = df.withColumn("__fit", F.coalesce(fit_on, F.lit(False))).withColumn("__test", F.coalesce(test_on, F.lit(False)))
    rows = packed(marked, set_col, case, names, ["__fit", "__test"], widths=widths).persist()
    for family, own in families.items():
        at = [FIRST + 2 + i for i in numbers(names, own, widths or {})]
        beta = fits_in_step(rows, [(FIRST, penalties[family])], at, len(at))
        out.append((family, penalties[family], *held_out_losses(rows, [FIRST + 1], beta, at)[0]))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, METRICS)


def develop(df: DataFrame, development: Column, rehearsal: Column, set_col: str, case: str, cell: str, block: str, families: dict[str, list[str]], penalties: dict[str, Sequence[float]], n_folds: int = 5, widths: dict[str, int] | None = None) -> DataFrame:
    """Each family's penalty, chosen over purged spatial folds of the development rows, with its loss there (cv_log_loss) and
    METRICS on the rehearsal rows. Locked rows aren't looked at. Rows are marked and dealt once for all families.
    widths: of names that hold arrays, how many numbers each array has."""
    dev, names = df.filter(development), all_names(families)
    rows = in_folds(dev, set_col, case, cell, names, matching.spatial_folds(dev, block, set_col, n_folds), block, n_folds, widths).persist()
    found = {family: fold_losses(rows, n_folds, numbers(names, own, widths or {}), penalties[family]) for family, own in families.items()}
    rows.unpersist()
    chosen = {family: next((q, x) for q, x, best in got if best) for family, got in found.items()}
    got = evaluated(df.filter(development | rehearsal), development, rehearsal, set_col, case, families, {f: q for f, (q, _) in chosen.items()}, widths)
    losses = df.sparkSession.createDataFrame([(f, x) for f, (_, x) in chosen.items()], "family string, cv_log_loss double")
    return got.join(F.broadcast(losses), "family")


def freeze(developed: DataFrame, df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Writes the lock once: families, penalties, the code's revision and a print of the whole frame."""
    locked = developed.select("family", "penalty", F.lit(REVISION).alias("revision")).crossJoin(F.broadcast(frame_print(df, columns)))  # one row
    create_lock(locked.coalesce(1), path)


def test_locked(df: DataFrame, columns: Sequence[str], lock: str, fit_on: Column, locked: Column, set_col: str, case: str, families: dict[str, list[str]], path: str, widths: dict[str, int] | None = None) -> DataFrame:
    """METRICS on the locked rows by the frozen penalties, written once to path. An error if the frame, the families or the
    revision have changed since the lock, or if the locked rows were tested before."""
    spark = df.sparkSession
    frozen = spark.read.parquet(lock).collect()  # a row a family
    now = frame_print(df, columns).first()
    if {r.family for r in frozen} != set(families) or any(r.revision != REVISION or (r.rows, r.sum_of_hashes, r.xor_of_hashes) != tuple(now) for r in frozen):
        raise ValueError("the frame, the families or the revision changed after the lock")
    out = evaluated(df, fit_on, locked, set_col, case, families, {r.family: r.penalty for r in frozen}, widths)
    create_lock(out.coalesce(1), path)
    return spark.read.parquet(path)
