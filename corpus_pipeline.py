"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, mixing, shards.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs, with
the columns of documents. The last one adds the shard and the slot. run() writes each stage's rows as Parquet
in the cluster's shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emendata.llm import decontaminate, kd_shards, minhash, pfair_mix, zstd_toxicity
from emendata.llm.common import file_order, shared_folder, table, text_key

SHARDS = 24
#: SQL can express neither compression lengths nor MinHash; tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    scored = zstd_toxicity.score(docs, table(spark, sf_dir, "labels"), keep=(F.struct("*").alias("row"),))
    return scored.filter("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id."""
    return minhash.without_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order that interleaves the sources by their weights."""
    return pfair_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; within a shard slots follow the order in which the files hold ``docs``.

    That is the order of the mixing stage. A table that is not read from Parquet files has none, and is mixed here.
    """
    if (ordered := file_order(docs, "mix_position")) is None:
        ordered = pfair_mix.mix(docs, ties=(text_key(),)).drop("mix_block", "mix_slot")
    placed = kd_shards.assign_shards(ordered, shards=SHARDS)
    return kd_shards.number_slots(placed, along="mix_position").drop("mix_position")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
