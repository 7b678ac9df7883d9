"""Deterministic matched risk sets, privatised ids, horizon frames and spatial folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions.expressions import is_finite, private_id
from obsengine.operators.grid import within_distance
from obsengine.operators.quality import resolve_duplicates
from obsengine.operators.windows import hash_top_k


def match_controls(candidates: DataFrame, controls: int = 4, most_cells: float = 25, seed: str = "20260712", required: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """Every day's cases with `controls` controls each: same day, within most_cells, those of least hash; in one job.

    candidates: date, grid_row, grid_col, outcome (1 case, 0 control) and covariates, one row a (date, cell, outcome) -
    identical copies collapse, conflicting ones fail. Rows for which `required` doesn't hold are left out. Cases with fewer
    controls are dropped; a control may serve several cases. Adds matched_set_id, case_row, case_col, status, hash_rank
    (0 for the case). Days and 3 x 3 buckets are the join key, so a heavy day is spread over its buckets."""
    rows = candidates if required is None else candidates.filter(required)
    rows = resolve_duplicates(rows, ["date", "grid_row", "grid_col", "outcome"])
    set_id = F.concat(F.col("date").cast("string"), F.lit(":r"), F.col("case_row"), F.lit(":c"), F.col("case_col"))
    cases = rows.filter("outcome = 1").select("date", F.col("grid_row").alias("case_row"), F.col("grid_col").alias("case_col"))
    free = rows.filter("outcome = 0").select("date", "grid_row", "grid_col")
    a = cases.withColumnsRenamed({"case_row": "row", "case_col": "col"})
    b = free.withColumnsRenamed({"grid_row": "row", "grid_col": "col"})
    near = within_distance(a, b, ["date"], "row", "col", most_cells).withColumnsRenamed({"row": "case_row", "col": "case_col", "right_row": "grid_row", "right_col": "grid_col"})
    if exclude_self:
        near = near.filter((F.col("case_row") != F.col("grid_row")) | (F.col("case_col") != F.col("grid_col")))
    text = F.concat_ws("|", F.lit(seed), F.col("date").cast("string"), F.col("case_row"), F.col("case_col"), F.col("grid_row"), F.col("grid_col"))
    picked = hash_top_k(near, ["date", "case_row", "case_col"], text, controls, ["grid_row", "grid_col"])
    w = Window.partitionBy("date", "case_row", "case_col")
    picked = picked.withColumn("__n", F.count("*").over(w)).filter(F.col("__n") == controls).drop("__n")
    member = F.struct("grid_row", "grid_col", F.lit(0).alias("outcome"), "hash_rank")
    head = F.struct(F.col("case_row").alias("grid_row"), F.col("case_col").alias("grid_col"), F.lit(1).alias("outcome"), F.lit(0).alias("hash_rank"))
    both = picked.select("date", "case_row", "case_col", F.explode(F.when(F.col("hash_rank") == 1, F.array(member, head)).otherwise(F.array(member))).alias("r"))  # pairs are made once
    out = both.select("date", "case_row", "case_col", "r.*").join(rows, ["date", "grid_row", "grid_col", "outcome"])
    return out.withColumn("matched_set_id", set_id).withColumn("status", F.when(F.col("outcome") == 1, "case").otherwise("control"))


def match_report(candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """By date: cases, controls, matched sets, and cases without enough controls."""
    had = candidates.groupBy("date").agg(F.count_if(F.col("outcome") == 1).alias("cases"), F.count_if(F.col("outcome") == 0).alias("controls"))
    got = matched.groupBy("date").agg(F.count_if(F.col("status") == "case").alias("matched_sets"))
    out = had.join(got, "date", "left").withColumn("matched_sets", F.coalesce("matched_sets", F.lit(0)))
    return out.withColumn("cases_without_enough_controls", F.col("cases") - F.col("matched_sets"))


def privatised(matched: DataFrame, prefix: str = "phase1b-grid") -> DataFrame:
    """Rows and columns replaced by hashed cell ids; sets are keyed by their case's cell and date."""
    cell = private_id(prefix, "grid_row", "grid_col")
    w = Window.partitionBy("date", "matched_set_id")
    out = matched.withColumn("cell_id", cell).withColumn("__case", F.max(F.when(F.col("outcome") == 1, F.col("cell_id"))).over(w))
    out = out.withColumn("matched_set_id", F.concat(F.col("date").cast("string"), F.lit(":"), F.col("__case")))
    out = out.withColumn("opportunity_id", private_id("opportunity", "matched_set_id", "cell_id", "status"))
    return out.drop("__case", "grid_row", "grid_col", "case_row", "case_col")


def stratified_candidates(df: DataFrame, date: str, row: str, col: str, size: int, n: int, seed: str) -> DataFrame:
    """At most n rows of each date and supercell, those of least hash."""
    marked = df.withColumn("__sr", F.floor(F.col(row) / size)).withColumn("__sc", F.floor(F.col(col) / size))
    text = F.concat_ws("|", F.lit(seed), F.col(date).cast("string"), F.col(row), F.col(col))
    return hash_top_k(marked, [date, "__sr", "__sc"], text, n, [row, col]).drop("__sr", "__sc", "hash_rank")


def horizon_frame(rows: DataFrame, fractions: DataFrame, horizon: int, least_pre: float = 0.7, least_observed: float = 0.95, threshold: float = 0.1) -> DataFrame:
    """Whole sets eligible for a horizon, with outcome_share (loss over natural before) and outcome_flag (share >= threshold).

    rows: matched_set_id, cell_id, year, rain... . fractions: cell_id, event_year, horizon, pre_natural, pre_observed,
    post_observed, loss. A member without a fraction, or not eligible, drops its set."""
    names = ["pre_natural", "pre_observed", "post_observed", "loss"]
    ok = (F.col("pre_natural") >= least_pre) & (F.col("pre_observed") >= least_observed) & (F.col("post_observed") >= least_observed) & (F.col("loss") >= 0) & (F.col("loss") <= F.col("pre_natural") + 1e-8)
    for n in names:
        ok = ok & is_finite(n)
    # Verdict and share are made of the fraction alone, so that what isn't asked for doesn't travel; a window makes the join once.
    f = fractions.filter(F.col("horizon") == horizon).select("cell_id", F.col("event_year").alias("year"), *names, F.coalesce(ok, F.lit(False)).alias("__ok"))
    f = f.withColumn("outcome_share", F.when(F.col("__ok"), F.col("loss") / F.col("pre_natural")))
    whole = F.min(F.coalesce("__ok", F.lit(False))).over(Window.partitionBy("matched_set_id"))
    out = rows.join(f, ["cell_id", "year"], "left").withColumn("__whole", whole).filter("__whole").drop("__ok", "__whole")
    return out.withColumn("outcome_flag", (F.col("outcome_share") >= threshold).cast("int"))


def spatial_folds(df: DataFrame, block: str, set_col: str, folds: int, most_blocks: int = 100_000) -> DataFrame:
    """block, fold: blocks, largest first (ties by name), go to the fold with the fewest sets so far.

    The counts are Spark's. The greedy pass is in the driver over the most_blocks largest; blocks beyond these, which are small
    and many, go to folds by a hash of their name, in Spark."""
    counts = df.groupBy(block).agg(F.count_distinct(set_col).alias("n"))
    first = counts.orderBy(F.desc("n"), block).limit(most_blocks).collect()
    load, rows = [0] * folds, []
    for r in first:
        k = min(range(folds), key=lambda j: (load[j], j))
        load[k] += r.n
        rows.append((r[block], k))
    dealt = df.sparkSession.createDataFrame(rows, f"{block} {df.schema[block].dataType.simpleString()}, fold int")
    if len(first) < most_blocks:
        return dealt
    rest = counts.join(F.broadcast(dealt.select(F.col(block).alias("__block"))), F.col(block).eqNullSafe(F.col("__block")), "left_anti")
    return dealt.unionByName(rest.select(block, F.pmod(F.xxhash64(block), F.lit(folds)).cast("int").alias("fold")))


def purged_split(df: DataFrame, fold: Column, set_col: str, cell: str) -> tuple[DataFrame, DataFrame]:
    """Test rows, and training sets none of whose cells occurs in a test row."""
    test = df.filter(fold)
    cells = test.select(cell).distinct()
    rest = df.filter(~fold)
    touched = rest.join(cells, cell, "left_semi").select(set_col).distinct()
    return test, rest.join(touched, set_col, "left_anti")


def choose_source(files: DataFrame, by: Sequence[str], kind: str, month: str, months: int = 5) -> DataFrame:
    """Files to use by key: all monthly ones if the season's months are complete, else the one season file, else an error row."""
    out = files.groupBy(*by).agg(F.count_distinct(F.when(F.col(kind) == "month", F.col(month))).alias("monthly"), F.count_if(F.col(kind) == "season").alias("seasonal"))
    return out.withColumn("choice", F.when(F.col("monthly") == months, "month").when(F.col("seasonal") == 1, "season").otherwise("error"))
