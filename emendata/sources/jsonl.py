"""JSON lines: scans that keep the file order, and append-only sinks. Rewrites are in versions.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import json_array, schemas


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _line): the lines of text files with their numbers from 1.

    A file's splits may be read in any order and by any task. So a line's number is its place in its split,
    plus the lines of the file's earlier splits; only the splits' counts are gathered, never a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block", "_begin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(starts, ["_file", "_block"]).select("value", "_file", (F.col("_at") - F.col("_begin") + F.col("_before") + 1).alias("_line"))


def read_ordered(spark: SparkSession, path: str, ddl: str, blank: str = "skip") -> DataFrame:
    """Records with _file and _line, the number of their line in the file from 1.

    ``blank`` lines are skipped, but counted, or make the read fail.
    """
    numbered = numbered_lines(spark, path)
    if blank == "skip":
        numbered = numbered.filter(F.trim("value") != "")
    parsed = F.from_json("value", _schema(ddl), {"mode": "FAILFAST"})
    return numbered.select(parsed.alias("_row"), "_file", "_line").select("_row.*", "_file", "_line")


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """Samples with _identifier (task and line); a row without a solution fails the read when it is used."""
    rows = read_ordered(spark, path, schemas.SOLUTIONS)
    checked = F.when(F.col("solution").isNotNull(), F.col("solution")).otherwise(F.raise_error(F.concat(F.lit("no solution in line "), F.col("_line").cast("string"))))
    return rows.withColumn("solution", checked.cast("string")).withColumn("_identifier", F.concat_ws("_", "task_id", F.col("_line").cast("string")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_ordered(spark, path, schemas.QUESTIONS, blank="fail")


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    return read_ordered(spark, path, schemas.QUESTIONS)


def processed_ids(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """Keys that an output holds; none if the file is absent or any line is broken, so that a run starts anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{key} string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", _schema(f"{key} string, _broken string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    if not rows.filter(F.col("_broken").isNotNull()).isEmpty():
        return spark.createDataFrame([], f"{key} string")
    return rows.filter(F.col(key).isNotNull()).select(key).distinct()


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A text list as column value, without blank lines."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("value")).distinct()


def append_list(values: DataFrame, path: str) -> None:
    values.select("value").write.mode("append").text(path)


def append(df: DataFrame, path: str) -> None:
    """Adds a batch; each batch is complete or absent."""
    df.write.mode("append").json(path)


def read_results(spark: SparkSession, folder: str, suffix: str = "_eval_results.json", whole: bool = False) -> DataFrame:
    """(path, json) of all result files below a folder, in the order of the paths: a row for each line, or each ``whole`` file.

    A result is a file of that name, or a folder of it that Spark wrote; path is that of the result.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("wholetext", str(whole).lower()).text(folder)
    named = rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "").alias("path"), F.col("value").alias("json"))
    return named.filter(F.endswith("path", F.lit(suffix))).orderBy("path")


def read_custom_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, test_id, outputs) from JSON lists of records with code_list or pred_list; any task reads any part of a list."""
    rows = json_array.read_records(spark, path, "question_id string, test_id string, code_list array<string>, pred_list array<string>")
    outputs = F.coalesce("code_list", "pred_list")
    checked = F.when(outputs.isNotNull(), outputs).otherwise(F.from_json(F.raise_error(F.lit("a record has no outputs")).cast("string"), "array<string>"))
    return rows.select("question_id", "test_id", checked.alias("outputs")).orderBy("question_id", "test_id")


def write_results(results: dict[str, DataFrame], folder: str, stem: str) -> None:
    """The three outputs of a run: samples, scores, and both together, named by their suffix."""
    for suffix, df in results.items():
        df.write.mode("overwrite").json(f"{folder}/{stem}{suffix}.json")
