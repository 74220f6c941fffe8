"""Queries about training sets, benchmark samples and the folding of graded generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import datasets, grading, harness, passk
from ..sources import benchmarks, connectors, jsonl, naming
from .files import folder_of, records_of
from .tables import FENCE, rounded, table

#: Options of runs: (model, reasoning, explicit, with tests, examples, generic), and the path that they give for 7 questions.
RUNS = (
    (("lab/m-1", True, False, False, 0, False), "edits/results_m-1_reasoning_7.jsonl"),
    (("m-2", False, True, True, 2, False), "edits/2_shot_explicit_with_tests/results_m-2_non_reasoning_explicit_with_tests_7.jsonl"),
    (("m-2", False, False, True, 0, True), "edits/zero_shot_generic/results_m-2_non_reasoning_with_tests_7.jsonl"),
)


def task_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem table in which tasks repeat: the last row of each stands."""
    path = folder_of(spark) + "/problems"
    rows = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull()).select(F.col("source").alias("task_id"), F.col("doc_id").alias("_line"), "lang", "n_chars")
    rows.write.parquet(path)
    return benchmarks.problems_by_task(spark, path).select("task_id", F.col("_line").alias("line"), "lang", "n_chars")


def named_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of several runs, each under the name that its options give, read back with their paths."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir).select("doc_id", "task_id", "solution")
    for k, ((model, reasoning, explicit, tests, shots, generic), _) in enumerate(RUNS):
        path = naming.solutions_path(model, reasoning, 7, explicit=explicit, with_tests=tests, shots=shots, generic=generic, base=f"{folder}/edits")
        jsonl.append(rows.filter(F.col("doc_id") % len(RUNS) == k).drop("doc_id"), path)
    read = spark.read.schema("task_id string, solution string").option("recursiveFileLookup", "true").json(f"{folder}/edits")
    return read.select("task_id", "solution", F.regexp_extract(F.col("_metadata.file_path"), r"/(edits/.*\.jsonl)/", 1).alias("path"))


def parallel_test_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as tests, each with its number as output, turned to two lists."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    tests = F.transform("lines", lambda x, i: F.struct(x.alias("input"), i.cast("string").alias("output")))
    lists = docs.select("doc_id", grading.parallel_tests(tests).alias("t"))
    return lists.select("doc_id", F.sha2(F.array_join("t.inputs", "\n"), 256).alias("inputs_sha256"), F.array_join("t.outputs", ",").alias("outputs"))


def closest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three shortest documents of each source."""
    rows = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull()).select(F.col("source").alias("problem_spec"), F.col("n_chars").alias("levenshtein"), F.col("doc_id").alias("_pos"))
    return datasets.best_samples(rows).select("problem_spec", F.col("_pos").alias("doc_id"))


def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records of turns: the role as the problem, the text as the program."""
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull() & F.col("role").isNotNull()).select("role", "text", F.concat_ws(":", "conv_id", "turn").alias("answer"))
    records = datasets.chat_records(rows, "role", "text", "answer")
    return records.select(F.col("conversations")[0]["content"].alias("asked"), F.col("conversations")[1]["content"].alias("answer"), (F.col("system") == prompts.SYSTEM_PROMPT).alias("has_system"))


def environment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for reinforcement learning from short documents, in the order of their numbers of mutations."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull() & F.col("lang").isNotNull())
    rows = docs.select(F.col("source").alias("problem_spec"), F.col("text").alias("corrupted_answer"), F.col("doc_id").cast("string").alias("correct_answer"), F.lit("[]").alias("tests"), F.when(F.col("doc_id") % 4 > 0, F.array_repeat("lang", (F.col("doc_id") % 4).cast("int"))).alias("applied_mutations"))
    shaped = datasets.environment_rows(rows)
    return shaped.select(F.sha2("question", 256).alias("question_sha256"), "answer", "info.dataset_type", F.sha2("info.corrupted_solution", 256).alias("corrupted_sha256"), "task")


def extracted_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers in the outputs of three scenarios, two for each item."""
    items = table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull()).select("item_id", F.translate("text", "`=[]\n", "'----").alias("said"))
    outputs = {
        "codegeneration": F.array(F.concat(F.lit(f"So\n{FENCE}python\nno\n{FENCE}\nor\n{FENCE}python\n"), "said", F.lit(f"\n{FENCE}\nDone")), F.lit("nothing")),
        "testoutputprediction": F.array(F.concat(F.lit("so\nassert f(1) == 0\nassert "), "said", F.lit("\nyes")), F.concat(F.lit(f"{FENCE}python\n"), "said", F.lit(f"\n{FENCE}"))),
        "codeexecution": F.array(F.concat(F.lit("[ANSWER]assert f() == "), F.trim("said"), F.lit("[/ANSWER]")), F.concat(F.lit("f() == "), F.trim("said"), F.lit("\nmore"))),
    }
    shown = []
    for scenario, output in outputs.items():
        done = harness.extracted(items.withColumn("output_list", output), scenario, steps=False)
        found = F.col("code_list" if scenario == "codegeneration" else "pred_list")
        shown.append(done.select("item_id", F.lit(scenario).alias("scenario"), F.array_join(found, "|").alias("found")))
    return shown[0].union(shown[1]).union(shown[2])


def folded_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems, their lines as generations with two test codes: how many pass every test."""
    code = lambda good: F.when(good, 1).otherwise(-2)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.when(F.col("l_linenumber") == 7, F.array().cast("array<int>")).otherwise(F.array(code(F.col("l_returnflag") != "R"), code(F.col("l_linestatus") == "O"))).alias("codes"))
    return passk.fold_generations(lines)


def mean_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass@1 in percent over lines of two verdicts each."""
    lines = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O").alias("graded"))
    return passk.mean_of_rows(lines).select(rounded(F.col("pass_at_1")).alias("pass_at_1"))


def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' requests with the greatest of their answers, orders' priorities; a default without one."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custom_id"))
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custom_id"), F.col("o_orderpriority").alias("response"))
    return connectors.answer_batch(asked, answers)


QUERIES = {f.__name__: f for f in (task_problems, named_runs, parallel_test_lists, closest_samples, sft_records, environment_records, extracted_outputs, folded_generations, mean_pass_rate, batch_answers)}

_ASKED = "'I am trying to implement a function with the following specifications:' || chr(10) || {0} || '.' || chr(10) || chr(10) || 'The function I have written so far is:' || chr(10) || '```python' || chr(10) || {1} || {2} || 'Wrap your response in ```python and ```'"
_GOOD = "(l_returnflag <> 'R')::INT + (l_linestatus = 'O')::INT"
_RUNS = ", ".join(f"({k}, '{path}')" for k, (_, path) in enumerate(RUNS))
ORACLES = {
    "task_problems": "SELECT source AS task_id, max(doc_id) AS line, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "named_runs": f"SELECT doc_id::VARCHAR AS task_id, coalesce(lang, 'none') AS solution, path FROM documents JOIN (VALUES {_RUNS}) r(k, path) ON doc_id % {len(RUNS)} = k",
    "parallel_test_lists": "SELECT doc_id, sha256(coalesce(text, '')) AS inputs_sha256, array_to_string(range(len(string_split(coalesce(text, ''), chr(10)))), ',') AS outputs FROM documents",
    "closest_samples": "SELECT source AS problem_spec, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 3",
    "sft_records": f"SELECT {_ASKED.format('role', 'text', chr(39) + ' ```' + chr(39) + ' || chr(10) || chr(10)')} AS asked, conv_id || ':' || turn AS answer, TRUE AS has_system FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL",
    "environment_records": f"""
        SELECT sha256({_ASKED.format('source', 'text', "chr(10) || '```' || chr(10)")}) AS question_sha256, doc_id::VARCHAR AS answer, 'edits' AS dataset_type, sha256(text) AS corrupted_sha256, 'minimal-edit' AS task
        FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND length(text) < 2000""",
    "extracted_outputs": """
        WITH s AS (SELECT item_id, translate(text, '`=[]' || chr(10), '''----') AS t FROM benchmark WHERE text IS NOT NULL)
        SELECT item_id, scenario, CASE scenario WHEN 'codegeneration' THEN t || '|' WHEN 'testoutputprediction' THEN 'assert ' || t || '|' || t ELSE trim(t) || '|' || trim(t) END AS found
        FROM s, (VALUES ('codegeneration'), ('testoutputprediction'), ('codeexecution')) x(scenario)""",
    "folded_generations": f"SELECT l_orderkey AS question_id, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 7 OR {_GOOD} = 2) AS c FROM lineitem GROUP BY 1",
    "mean_pass_rate": f"SELECT round(avg(({_GOOD}) / 2.0::DOUBLE) * 100, 6) AS pass_at_1 FROM lineitem",
    "batch_answers": "SELECT c_custkey AS custom_id, coalesce(max(o_orderpriority), 'Result missing') AS response FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
}
