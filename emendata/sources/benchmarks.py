"""Benchmark tables. Hub data sets are read from Parquet copies: no operator here uses the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import tests_of
from ..operators.passk import in_window
from ..operators.relational import last_row
from . import schemas


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """``df``, which fails where the column holds an unknown value."""
    known = F.col(column).isin(*allowed) | F.col(column).isNull()
    return df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column))).cast("string")))


def problems_by_task(spark: SparkSession, path: str, order: str = "_line") -> DataFrame:
    """One row for each task, the last in order."""
    return last_row(spark.read.parquet(path), "task_id", [order])


def parse_tests(df: DataFrame, *columns: str) -> DataFrame:
    """JSON test lists (plain or packed) as arrays of structs."""
    for c in columns:
        df = df.withColumn(c, F.from_json(tests_of(F.col(c)), f"array<{schemas.TEST}>"))
    return df


def generation_problems(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, tests: bool = True) -> DataFrame:
    """Problems within inclusive dates. The dates are filtered before any test is unpacked."""
    rows = in_window(spark.read.parquet(path).withColumn("contest_date", F.col("contest_date").cast("timestamp")), start=start, end=end)
    rows = checked(checked(rows, "platform", schemas.PLATFORMS), "difficulty", schemas.DIFFICULTIES)
    rows = rows.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    return parse_tests(rows, "public_test_cases", "private_test_cases") if tests else rows


def execution_problems(spark: SparkSession, path: str) -> DataFrame:
    """Sorted by the number in an id such as sample_12."""
    return spark.read.parquet(path).withColumn("_n", F.split("id", "_")[1].cast("int")).orderBy("_n").drop("_n")


def test_output_problems(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("test", F.from_json("test", f"array<{schemas.TEST}>")).orderBy("question_id", "test_id")


def evaluation_sample(problems: DataFrame) -> DataFrame:
    """(question_id, input_output): public then private tests as parallel lists in JSON, with the function's name."""
    every = F.concat("public_test_cases", "private_test_cases")
    shape = F.struct(F.transform(every, lambda t: t["input"]).alias("inputs"), F.transform(every, lambda t: t["output"]).alias("outputs"), F.col("metadata")["func_name"].alias("fn_name"))
    return problems.select("question_id", F.to_json(shape).alias("input_output"))


def execution_sample(problems: DataFrame) -> DataFrame:
    return problems.select("id", "code", "input", "output")


def test_output_sample(problems: DataFrame) -> DataFrame:
    """The question as input, and the first test's output as what is expected."""
    return problems.select("question_id", "test_id", F.col("question_content").alias("input"), F.get("test", F.lit(0))["output"].alias("output"))


def write_dataset(df: DataFrame, path: str, split: str) -> None:
    """Publishes a split of a data set as a folder of Parquet files."""
    df.write.mode("overwrite").parquet(f"{path}/{split}")
