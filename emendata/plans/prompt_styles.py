"""Queries about prompts by model style. The SQL fills literal texts, which stand in prompts.json with {slots}."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, prompts, templates
from ..operators import harness
from .mutations import literal
from .tables import table

EXPECTED = json.loads(Path(__file__).with_name("prompts.json").read_text())


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull()).select("item_id", F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question_content"))


def _shown(made: DataFrame, *names: str) -> DataFrame:
    return made.select(*names, "style", F.col("prompt.system").alias("system"), F.sha2(F.col("prompt.messages")[0]["content"], 256).alias("content_sha256"))


def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = _items(spark, sf_dir).withColumn("starter_code", F.when(F.col("item_id") % 2 == 0, F.lit("def f():")).otherwise(F.lit("")))
    return _shown(templates.generation_prompts(problems), "question_id")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples of each item, one for each error code, and one that passed."""
    messages = F.array(*[F.lit(json.dumps({"error_code": -k, "error": "boom", "inputs": "1", "output": "2", "expected": "3"})) for k in range(1, 5)], F.lit("{}"))
    graded = F.array(*[F.lit(False)] * 4, F.lit(True))
    codes = F.array(*[F.concat(F.lit(f"x{k} = "), F.col("question_id")) for k in range(5)])
    return _items(spark, sf_dir).select("question_id", codes.alias("code_list"), graded.alias("graded_list"), messages.alias("metadata"))


def repair_prompt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harness.repair_rows(_items(spark, sf_dir), _metadata(spark, sf_dir))
    return _shown(rows.withColumn("position", F.col("position").cast("long")), "question_id", "position")


def test_output_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starter = F.concat(F.lit("class S:\n    def g"), F.col("question_id"), F.lit("(self, a, b):\n        pass"))
    problems = _items(spark, sf_dir).withColumns({"starter_code": starter, "test_input": F.lit("[1]\n'x'")})
    named = problems.withColumn("function_name", code.function_named("starter_code"))
    return _shown(templates.test_output_prompts(named), "question_id", "function_name")


def execution_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = _items(spark, sf_dir).select("question_id", F.concat(F.lit("def f(x):\n    return "), F.col("question_id")).alias("code"), F.lit("f(x = 1)").alias("call"))
    both = [templates.execution_prompts(problems, steps).withColumn("steps", F.lit(steps)) for steps in (False, True)]
    return _shown(both[0].union(both[1]), "question_id", "steps")


def corruption_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request for a subtly wrong version of a solution, and its system prompt."""
    text = prompts.corruption_request(F.col("question_content"), prompts.full_solution(F.concat(F.lit("def f():\n    '''"), F.col("question_id"), F.lit("'''")), F.lit("    return 1")), F.lit("check(f)"))
    return _items(spark, sf_dir).select("question_id", text.alias("request"), F.sha2(F.lit(prompts.CORRUPTION_SYSTEM_PROMPT), 256).alias("system_sha256"))


def style_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask models in turn; the registry gives each its style, and models that it lacks none."""
    names = [m for m, _ in harness.REGISTRY] + ["unknown-model"]
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % len(names) + 1).cast("int")).alias("model_name"))
    return harness.with_style(asked, harness.registry(spark)).select("c_custkey", "model_name", "model_style")


def _texts(rows: list[list], names: str) -> str:
    body = ", ".join("(" + ", ".join(literal(v) if not isinstance(v, bool) else str(v).upper() for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS texts({names})"


_ITEMS = "(SELECT item_id, item_id::VARCHAR AS question_id, text FROM benchmark WHERE text IS NOT NULL)"
_CHECKS = """
    CASE position
        WHEN 0 THEN 'The above code is incorrect and got the following compilation error.' || chr(10) || 'boom'
        WHEN 1 THEN 'The above code is incorrect and got a wrong answer.' || chr(10) || 'Input: 1' || chr(10) || 'Generated Output: 2' || chr(10) || 'Expected: 3'
        WHEN 2 THEN 'The above code is incorrect and got time limit exceeded.' || chr(10) || 'boom' || chr(10) || 'Input: 1' || chr(10) || 'Expected: 3'
        WHEN 3 THEN 'The above code is incorrect and got a runtime error.' || chr(10) || 'Input: 1' || chr(10) || 'Expected: 3' || chr(10) || 'boom'
    END"""

QUERIES = {f.__name__: f for f in (generation_prompts, repair_prompt_styles, test_output_prompts, execution_prompts, corruption_prompt, style_registry)}
ORACLES = {
    "generation_prompts": f"""
        SELECT question_id, style, system, sha256(replace(replace(t, '{{content}}', text), '{{starter}}', 'def f():')) AS content_sha256
        FROM {_ITEMS} JOIN {_texts(EXPECTED['generation'], 'style, with_starter, system, t')} ON (item_id % 2 = 0) = with_starter""",
    "repair_prompt_styles": f"""
        SELECT question_id, position, style, CASE WHEN position < 4 THEN system END AS system,
            sha256(CASE WHEN position < 4 THEN replace(replace(replace(t, '{{content}}', text), '{{code}}', 'x' || position || ' = ' || question_id), '{{check}}', {_CHECKS}) ELSE '' END) AS content_sha256
        FROM {_ITEMS}, (SELECT unnest(range(5)) AS position), {_texts(EXPECTED['repair'], 'style, system, t')}""",
    "test_output_prompts": f"""
        SELECT question_id, 'g' || question_id AS function_name, style, system, sha256(replace(replace(replace(replace(t, '{{content}}', text),
            '{{starter}}', 'class S:' || chr(10) || '    def g' || question_id || '(self, a, b):' || chr(10) || '        pass'), '{{function}}', 'g' || question_id), '{{input}}', '[1], ''x''')) AS content_sha256
        FROM {_ITEMS}, {_texts(EXPECTED['test_output'], 'style, system, t')}""",
    "execution_prompts": f"""
        SELECT question_id, steps, style, system, sha256(replace(replace(t, '{{code}}', 'def f(x):' || chr(10) || '    return ' || question_id), '{{call}}', 'f(x = 1)')) AS content_sha256
        FROM {_ITEMS}, {_texts(EXPECTED['execution'], 'style, steps, system, t')}""",
    "corruption_prompt": f"""
        SELECT question_id, 'Problem Statement:' || chr(10) || text || chr(10) || chr(10) || 'Correct Solution:' || chr(10) || 'def f():' || chr(10) || '    ''''''' || question_id || '''''''' || chr(10) || '    return 1' || chr(10) || chr(10)
            || 'Test Code:' || chr(10) || 'check(f)' AS request, '3fded230db9d68da6f43101de8ce8feb570bc8e0faba7d94b204b941e662d6c0' AS system_sha256 FROM {_ITEMS}""",
    "style_registry": f"""
        SELECT c_custkey, model_name, model_style FROM customer JOIN (SELECT * FROM {_texts([[i, m, s] for i, (m, s) in enumerate([*harness.REGISTRY, ('unknown-model', None)])], 'i, model_name, model_style')}) ON c_custkey % {len(harness.REGISTRY) + 1} = i""",
}
