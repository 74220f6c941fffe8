"""The library's functions by name, for queries that are written in SQL.

register() gives a session scalar functions over programs and texts, expressions as SQL functions, and table functions
that are called laterally.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import code, compare

#: Scalar functions over Arrow batches.
FUNCTIONS = {
    "standardise_code": code.standardise_code,
    "code_tokens": code.tokenise_code,
    "code_body": code.body_of,
    "code_of_response": code.code_of_response,
    "token_distance": code.distance_of,
    "changed_leaf_lines": code.leaf_lines_of,
    "rouge_l": code.rouge_l_of,
    "chrf": code.chrf_of,
    "bleu": code.bleu_of,
    "meteor": code.meteor_of,
    "codebleu": code.codebleu_of,
    "output_equal": compare.decimals,
    "output_like": compare.lenient,
}
TABLES = {"diff_rows": code.DiffRows}
#: Expressions: (name, parameters, type, body).
EXPRESSIONS = (
    ("pass_at_k", "n BIGINT, c BIGINT, k BIGINT", "DOUBLE", "CASE WHEN n - c < k THEN 1D WHEN c = 0 THEN 0D ELSE 1 - aggregate(sequence(n - c + 1, n), 1D, (a, i) -> a * (1 - k / i)) END"),
    ("all_verified", "codes ARRAY<INT>", "BOOLEAN", "size(codes) > 0 AND forall(codes, x -> x = 1)"),
    ("without_thought", "response STRING", "STRING", "regexp_replace(response, '(?s)^.*</think>', '')"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, and returns their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    for name, parameters, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS, *TABLES, *[e[0] for e in EXPRESSIONS]]
