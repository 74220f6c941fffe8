"""Queries that run programs in the sandbox. The programs are those below, none comes from a table; items give their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading, sandbox
from .mutations import literal
from .tables import table

TESTS = "import unittest\nclass T(unittest.TestCase):\n    def test_a(self):\n        self.assertEqual(f(1), 2)\n    def test_b(self):\n        self.assertEqual(f(2), 3)\n"
#: (program, status, tests run, failures, errors, name of what failed)
SOLUTIONS = (
    ("def f(NAME): return NAME + 1", "pass", 2, 0, 0, ""),
    ("def f(NAME): return 2", "fail", 2, 1, 0, "test_b"),
    ("def f(NAME): return None + 1", "fail", 2, 0, 2, "test_a,test_b"),
    ("def f(", "fail", 0, 0, 0, "ALL"),
)
#: (program, function, inputs, outputs, codes, error code, codes of the lenient verifier)
GRADED = (
    ("NAME = int(input())\nprint(NAME * 2)", None, ("1", "2", "3"), ("2", "4.0", "6"), "1,1,1", None, "1,1,1"),
    ("NAME = input()\nprint(NAME)", None, ("a", "b", "c"), ("a", "x y", "c"), "1,-2", -2, "1,0"),
    ("NAME = 1 / 0", None, ("", ""), ("", ""), "-4", -4, "-3"),
    ("def f(NAME, b): return (NAME, b)", "f", ("1\n2", "3\n4"), ("[1, 2]", "[3, 5]"), "1,-2", -2, "1,0"),
    ("class Solution:\n    def f(self, NAME): return [NAME]", "f", ("1",), ("[1]",), "1", None, "1"),
    ("if 1:\n    print(input())\n    return", None, ("x",), ("x",), "1", None, "1"),
    ("import os\nNAME = os.fork()\nif not NAME:\n    while True:\n        pass\nprint(input())", None, ("x", "y"), ("x", "y"), "1,1", None, "1,1"),
    ("NAME = []\ndef f(x):\n    NAME.append(x)\n    return (x, len(NAME))", "f", ("7", "7"), ("[7, 1]", "[7, 2]"), "1,1", None, "1,1"),
)
#: (program, call, generations, which are right)
EXECUTED = (
    ("def f(NAME):\n    return NAME + 1", "f(1)", ("2", "3", "f(1)"), "true,false"),
    ("NAME = 4", "NAME", ("NAME", "NAME + 0"), "false,false"),
)


def _over(spark: SparkSession, sf_dir: str, rows: list[tuple], ddl: str) -> DataFrame:
    """(item_id, case_id, the columns): one of the rows for each item of the benchmark."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {ddl}")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.pmod("item_id", F.lit(len(rows))).cast("int").alias("case_id"), F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("own"))
    return items.repartition(spark.sparkContext.defaultParallelism).join(F.broadcast(cases), "case_id").withColumn("code", F.replace("code", F.lit("NAME"), F.col("own")))


def sandbox_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [r[:1] for r in SOLUTIONS], "code string").withColumn("test", F.lit(TESTS)).select("item_id", "code", "test")
    done = sandbox.execute_solutions(rows, "code", "test", seconds=60)
    failed = F.array_join(F.array_sort(F.map_keys("details")), ",")
    return done.select("item_id", grading.fold_status(F.col("status"), F.size("details") > 0).alias("status"), "tests_run", "failures", "errors", failed.alias("failed"))


def sandbox_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [r[:4] for r in GRADED], "code string, fn_name string, inputs array<string>, outputs array<string>")
    tests = F.transform(F.arrays_zip("inputs", "outputs"), lambda t: F.struct(t["inputs"].alias("input"), t["outputs"].alias("output")))
    ready = rows.select("item_id", "code", "fn_name", tests.alias("tests"))
    graded = sandbox.grade(ready, seconds=60).withColumnRenamed("codes", "strict")
    both = sandbox.verified(graded, seconds=60)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return both.select("item_id", shown("strict").alias("codes"), F.get_json_object("metadata", "$.error_code").cast("int").alias("error_code"), shown("codes").alias("verified"), "passed")


def sandbox_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [(c, e, list(g)) for c, e, g, _ in EXECUTED], "code string, call string, generations array<string>")
    named = rows.select(F.col("item_id").cast("string").alias("id"), "code", F.replace("call", F.lit("NAME"), F.col("own")).alias("input"), F.replace("call", F.lit("NAME"), F.col("own")).alias("output"), F.transform("generations", lambda g: F.replace(g, F.lit("NAME"), F.col("own"))).alias("generations"))
    return sandbox.execution_results(named, 60).select(F.col("id").alias("item_id"), F.array_join(F.transform("graded", lambda g: g.cast("string")), ",").alias("graded"))


def _table(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in (i, *r)) + ")" for i, r in enumerate(rows))
    return f"(SELECT item_id, cases.* FROM benchmark JOIN (VALUES {body}) AS cases(case_id, {names}) ON item_id % {len(rows)} = case_id)"


QUERIES = {f.__name__: f for f in (sandbox_verdicts, sandbox_grades, sandbox_executions)}
ORACLES = {
    "sandbox_verdicts": f"SELECT item_id, status, tests_run, failures, errors, failed FROM {_table([r[1:] for r in SOLUTIONS], 'status, tests_run, failures, errors, failed')}",
    "sandbox_grades": f"SELECT item_id, codes, error_code, verified, passed FROM {_table([(*r[4:], set(r[6].split(',')) == {'1'}) for r in GRADED], 'codes, error_code, verified, passed')}",
    "sandbox_executions": f"SELECT item_id::VARCHAR AS item_id, graded FROM {_table([r[3:] for r in EXECUTED], 'graded')}",
}
