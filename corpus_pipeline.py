"""A training corpus from ``documents``: drop toxic texts, near copies and benchmark passages, mix sources, store token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.llm import decontaminate, minhash_dedup, mixing, token_store, toxicity
from bedwise.llm.common import new_path, ship
from bedwise.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one row of each group of texts stays, whatever the ids are; texts without a word all stay.

    Groups are formed of texts (by their hash), so an id that several texts share, or none, decides nothing but which row
    stays: the one with the smallest id.
    """
    ship(spark)
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.where(wordy)
    groups = minhash_dedup.near_duplicates(some.select(F.xxhash64("text").alias("doc_id"), "text"), percent=minhash_dedup.PERCENT)
    groups = groups.select(F.col("doc_id").alias("tid"), "component_id").distinct()
    # Equal rows share a key, so the one shuffle by it also brings repeated rows together.
    keyed = some.withColumn("row_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    marks = keyed.select("doc_id", "row_key", F.xxhash64("text").alias("tid")).distinct().join(groups, "tid")
    first = marks.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")).select("m.row_key")
    kept = keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select(*docs.columns).unionByName(docs.where(~wordy))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark passages go."""
    ship(spark)
    bad = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("bad_id"), "tid").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["tid"]), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files, described as read back."""
    ship(spark)
    return token_store.token_table(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
    ("token_files", token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
