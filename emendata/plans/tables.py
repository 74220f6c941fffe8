"""Shared pieces of the queries: table access and the analogies that lay the pipelines over the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FENCE = "```"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run in this process."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)


def graded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, n, c): an order is a problem, its lines are samples, and a sample is right unless returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("c"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, reference, prediction): the words of each turn and of the one before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    cut = lambda c: F.filter(F.split(F.translate(c, "\n", " "), " "), lambda x: x != "")
    pairs = rows.withColumn("_before", before).filter(F.col("_before").isNotNull() & F.col("text").isNotNull())
    return pairs.select("conv_id", "turn", "role", cut("_before").alias("reference"), cut("text").alias("prediction"))


#: The same rows as turn_pairs(), as the beginning of a WITH clause.
TURN_PAIRS = """
before AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
pairs AS (
    SELECT conv_id, turn, role,
        list_filter(string_split(replace(prior, chr(10), ' '), ' '), lambda x: x <> '') AS reference,
        list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS prediction
    FROM before WHERE prior IS NOT NULL AND text IS NOT NULL
)"""

#: pass@k of n, c and k in SQL.
PASS_AT_K = "CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_reduce(list_prepend(1.0, list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i::DOUBLE)), lambda a, b: a * b) END"
COUNTS = "counts AS (SELECT l_orderkey AS question_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS c FROM lineitem GROUP BY 1)"
