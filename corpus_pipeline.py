"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine.llm import decontaminate, mixing, records, simhash, toxicity
from obsengine.llm.common import read_table, stored
from obsengine.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go. Null and empty texts have no hits and stay; repeated rows are
    judged one by one; an empty table gives no rows."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one row stays: that of the smallest doc_id (null counts as the largest), and
    of several such rows one chosen by the hash of their text."""
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("row"))
    rows = stored(docs.withColumn("__rank", rank), "ranked")
    groups = simhash.near_duplicates(rows, id_col="__rank")
    gone = groups.filter("doc_id.row <> component_id.row").select("doc_id.row")
    return rows.join(gone, F.col("__rank.row") == gone["row"], "left_anti").select(docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, if these cover a twentieth of their words. Null and empty texts hold
    none; rows of null or equal doc_id are judged one by one; an empty benchmark takes nothing away."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rate says: good texts are repeated until they make up their part of all tokens, and
    none is thinned out. Null and empty texts have rates too and are kept; without labels every row comes once."""
    quality = F.when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    _, steps, classifier, _ = mixing.mix(docs, read_table(spark, sf_dir, "labels"), quality, shares={"good": 0.88, "poor": 0.12}, least_rate=1.0)
    return mixing.apply_rates(docs, classifier, steps, least_rate=1.0)


def written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as binary records; the result is read back from them, in doc_id order, null first. A null or empty text is
    its end id alone; rows that share a doc_id are records of their own."""
    return records.to_records_and_back(docs, tokenizer_path(), end_id=2, null_ids=True)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", contaminated), ("mixing", mixed), ("records", written)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
