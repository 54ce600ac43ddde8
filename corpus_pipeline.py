"""A training corpus from raw documents: quality, toxicity, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return whole rows of docs, with the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.llm import minhash, packing, quality, toxicity, winnow
from tidewright.llm.labelled import text_key
from tidewright.session import ship_package, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of docs whose text is not among the rejected ones (text_key); equal texts are judged alike."""
    key = f"_{uuid.uuid4().hex}"
    rejected = rejected.select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key(F.col("text"))).join(rejected, key, "left_anti").drop(key).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 0"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scored = toxicity.classify(docs, _table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of the smallest doc_id; rows without words are no group and all stay."""
    ship_package(spark)
    found = minhash.near_duplicates(docs)
    chosen = found.where("group_key is not null").groupBy("group_key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one"))
    doc, key, loose = (f"_{uuid.uuid4().hex}" for _ in range(3))
    keep = chosen.select(F.col("one.doc_id").alias(doc), F.col("one.text_key").alias(key), F.lit(False).alias(loose)).union(
        found.where("group_key is null").select("doc_id", "text_key", F.lit(True)).distinct())
    own = docs.withColumn(key, text_key(F.col("text")))
    kept = own.join(keep.withColumnRenamed(key, f"{key}k"), F.col(key).eqNullSafe(F.col(f"{key}k")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)))
    one = kept.where(~F.col(loose)).dropDuplicates([key, doc])  # repeated rows of the chosen document
    return one.select(docs.columns).unionByName(kept.where(F.col(loose)).select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = winnow.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained classifiers and a linear program are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each keeps is written to the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
