"""Queries about the benchmark harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import harness, passk
from . import scores
from .tables import rounded, table


def _old_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run over the conversations: the outputs of a question are its assistant turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit("")).alias("said"), "turn")
    return turns.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]).alias("output_list"))


def harness_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to generate after an earlier run."""
    benchmark = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("question_id"), "role")
    return harness.resume(benchmark, _old_rows(spark, sf_dir), "codegeneration")[1]


def repair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair prompts for two samples of each benchmark item, one of them passing."""
    items = table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull())
    problems = items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question_content"))
    wrong = F.lit('{"error_code": -2, "inputs": "1", "output": "2", "expected": "3"}')
    graded = items.select(F.col("item_id").alias("question_id"), F.array(F.lit("a = 1"), F.lit("b = 2")).alias("code_list"), F.array(wrong, F.lit("{}")).alias("metadata"), F.array(F.lit(False), F.lit(True)).alias("graded_list"))
    rows = harness.repair_rows(problems, graded).filter("style = 'MistralWeb'")
    return rows.select("question_id", F.col("position").cast("long").alias("position"), F.col("prompt.messages")[0]["content"].alias("prompt"))


def harness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass@k by difficulty from graded lists: an order's lines, by the order's priority."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", 1).otherwise(-2).alias("code"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("difficulty"))
    counts = passk.fold_codes(lines, "o_orderkey", "code").join(orders, "o_orderkey").select("difficulty", "n", F.col("passed").alias("c"))
    report = passk.by_slice(counts, "difficulty", (1, 5))
    return report.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "k", rounded(F.col("pass_at_k")).alias("pass_at_k"), F.col("problems").cast("long").alias("problems"))


def first_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents of quality 1: the number is what is asked for."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return harness.first_passing(rows, F.col("quality") == 1, ["doc_id"], 50).select("doc_id", "source")


def model_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as a registry lookup; keys that the registry lacks keep a null."""
    registry = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("model_name"), F.col("n_name").alias("model_style"))
    requests = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("model_name"))
    return harness.with_style(requests, registry).select("c_custkey", "model_style")


QUERIES = {f.__name__: f for f in (harness_resume, repair_prompts, harness_report, first_passing, model_styles)}

ORACLES = {
    "harness_resume": """
        SELECT conv_id AS question_id, role FROM conversations c WHERE turn = 0
            AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'assistant' AND o.text <> '')""",
    "repair_prompts": """
        SELECT item_id AS question_id, unnest([0, 1])::BIGINT AS position, unnest(['### Question:' || chr(10) || text || chr(10) || chr(10) || '### Answer:' || chr(10) || '```python' || chr(10) || 'a = 1' || chr(10) || '```' || chr(10) || chr(10)
            || 'The above code is incorrect and got a wrong answer.' || chr(10) || 'Input: 1' || chr(10) || 'Generated Output: 2' || chr(10) || 'Expected: 3' || chr(10)
            || '### Format: Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows.' || chr(10) || '```python' || chr(10) || '# YOUR CODE HERE' || chr(10) || '```' || chr(10) || chr(10)
            || '### Answer: (use the provided format with backticks)' || chr(10) || chr(10), '']) AS prompt
        FROM benchmark WHERE text IS NOT NULL""",
    # the numbers of pass_at_k_by_difficulty, for two values of k
    "harness_report": scores.ORACLES["pass_at_k_by_difficulty"].replace("[1, 5, 10, 25, 50, 100, 150, 200]", "[1, 5]"),
    "first_passing": "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY doc_id LIMIT 50",
    "model_styles": "SELECT c_custkey, n_name AS model_style FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 3",
}
