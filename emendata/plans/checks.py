"""Queries about filters, verdicts and small functions over programs. Cases are laid over the documents, with a name of the row's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, compare, extract, prompts, similarity
from ..operators import datasets, grading
from .mutations import values
from .tables import rounded, table


def _over(spark: SparkSession, sf_dir: str, rows: list[tuple], ddl: str) -> DataFrame:
    """doc_id and the columns of one of the rows, by doc_id; NAME in a text becomes n and the doc_id."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {ddl}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).cast("int").alias("case_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("own"))
    texts = [n for n, kind in cases.dtypes if kind == "string"]
    return docs.join(F.broadcast(cases), "case_id").withColumns({n: F.replace(n, F.lit("NAME"), F.col("own")) for n in texts}).drop("case_id", "own")


def _expected(rows: list[tuple], names: str) -> str:
    """The SQL of a table of expected values: texts get the row's name."""
    shown = ", ".join(f"replace({n}, 'NAME', 'n' || doc_id) AS {n}" if any(isinstance(r[k], str) for r in rows) else n for k, n in enumerate(names.split(", ")))
    return f"SELECT doc_id, {shown} FROM documents JOIN {values(rows, names)} ON doc_id % {len(rows)} = case_id"


#: (code, text of a docstring, with it, the docstring found in it)
DOCSTRINGS = [
    ("def f(NAME):\n    pass\n", "'''NAME d'''", "def f(NAME):\n    '''NAME d'''\n    pass\n", "'''NAME d'''"),
    ("NAME = 1\n", "'''d'''", "NAME = 1\n", ""),
    ("def f(NAME):\n    pass\n", "", "def f(NAME):\n    pass\n", ""),
    ("x = 1\ndef f(a):\n    return NAME\n", '"""two\nlines"""', 'x = 1\ndef f(a):\n    """two\nlines"""\n    return NAME\n', '"""two\nlines"""'),
]
#: (line, its right side, JSON, whether they are equal)
ASSERTIONS = [
    ("assert f('NAME') == [1, 'NAME']", "[1, 'NAME']", '[1, "NAME"]', True),
    ("assert f('NAME') == g()", "g()", "1", False),
    ("assert NAME > 1", "Not an equality assertion", "1", False),
    ("NAME = 1", "Not an assert statement", "1", False),
    ("", "Empty statement", "1", False),
    ("assert (NAME", "Invalid syntax", "1", False),
    ("# assert NAME == 1\nassert NAME == 2", "2", "2", True),
    ("{'NAME': 1}", "Not an assert statement", '{"NAME": 1}', True),
]
#: (response, the block after its thought, what its first two fences enclose)
BLOCKS = [
    ("<think>\n```python\nno\n```\n</think>\n```python\nNAME\n```\n", "NAME", "no"),
    ("```\nNAME\n```\nthen\n```js\nlast NAME\n```", "last NAME", "NAME"),
    ("NAME alone", None, ""),
    ("```python\nNAME", None, ""),
]
#: (report, number of lines that it names)
REPORTS = [("\u001b[31m1-3:\u001b[0m\nNAME\n2:\n7:\n", 4), ("NAME\n", 0), ("10 - 12:\n11:\n", 3), ("5:\n5:\n", 1)]
#: (script, with an open guard, as a function)
SCRIPTS = [
    ("NAME = 1\nif __name__ == '__main__':\n    print(NAME)\n", "NAME = 1\nprint(NAME)", "def wrapped_function():\n    NAME = 1\n    if __name__ == '__main__':\n        print(NAME)"),
    ("import os\nNAME = 1", "import os\nNAME = 1", "import os\n\ndef wrapped_function():\n    NAME = 1"),
    ("if __name__ == 'NAME':\n    pass", "if __name__ == 'NAME':\n    pass", "def wrapped_function():\n    if __name__ == 'NAME':\n        pass"),
    ("NAME = (", "NAME = (", "NAME = ("),
]
#: (program, as a function, as a script), both without the prelude and the streams before the first plain line
FORMS = [
    ("import os\nNAME = 1\nprint(NAME)", "import os\nPRELUDEdef code():\n\tNAME = 1\n\tprint(NAME)\n", "import os\nPRELUDENAME = 1\nprint(NAME)\n"),
    ("from os import *\nNAME = 1\nfrom sys import path", "PRELUDEdef code():\n\tNAME = 1\n\tfrom sys import path\n", "from os import *\nPRELUDENAME = 1\nfrom sys import path\n"),
]
#: (JSON, with plain numbers as keys)
KEYS = [('{"01": {"-2": "NAME"}}', '{"1": {"-2": "NAME"}}'), ('[{"x": 1}]', '[{"x": 1}]'), ("NAME", "NAME"), ('{"7": [{"08": 1}]}', '{"7": [{"8": 1}]}')]
#: (output, what is expected, whether the lenient rules and whether the exact ones take them for equal)
OUTPUTS = [
    ("1.0000000001", "1", True, False),
    ("NAME b\n c", "NAME b\nc", True, True),
    ("b NAME\nc", "NAME b\nc", True, False),
    ("NAME 1", "other 1", True, False),
    ("1\n2", "1\n3", False, False),
    ("1", "2\n3", False, False),
    ("1e2", "100", True, True),
    ("1" + "0" * 50, "1" + "0" * 50 + ".0", True, True),
    ("0." + "0" * 30 + "1", "0", True, False),
]
#: (problem, without fixed sentences and white space, solution, without its fence)
PROBLEMS = [(" NAME. DROP b ", "NAME. b", "```python\nNAME = 1\n```", "NAME = 1"), ("\n\tNAME\n", "NAME", "NAME = 1\n", "NAME = 1")]


def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [r[:2] for r in DOCSTRINGS], "program string, doc string")
    made = rows.withColumn("made", F.when(extract.docstring(F.col("program")) == "", code.insert_doc("program", "doc")).otherwise(F.col("program")))
    return made.select("doc_id", "made", extract.docstring(F.col("made")).alias("found"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of line compares with; of several lines the right side of the last is shown."""
    rows = _over(spark, sf_dir, [(r[0], r[2]) for r in ASSERTIONS], "line string, expected string")
    last = F.element_at(F.split("line", "\n", -1), -1)
    return rows.select("doc_id", code.right_side(last).alias("side"), code.equals_expected("line", "expected").alias("equal"))


def response_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [r[:1] for r in BLOCKS], "response string")
    return rows.select("doc_id", extract.block_after_thought(F.col("response")).alias("block"), extract.first_two_fences(F.col("response")).alias("enclosed"))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [r[:1] for r in REPORTS], "report string").select("doc_id", extract.changed_lines(F.col("report")).cast("long").alias("n_lines"))


def script_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [r[:1] for r in SCRIPTS], "script string").select("doc_id", code.opened("script").alias("opened"), code.wrapped("script").alias("wrapped"))


def script_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's forms for a grader. The prelude is checked by its digest, and shown as a mark."""
    rows = _over(spark, sf_dir, [r[:1] for r in FORMS], "program string").withColumn("forms", code.forms_of("program"))
    cut = lambda k, extra: F.replace(F.replace(F.col("forms")[k], F.lit(code.PRELUDE + extra + code.STREAMS), F.lit("PRELUDE")), F.lit(code.PRELUDE + code.STREAMS), F.lit("PRELUDE"))
    prelude = F.sha2(F.replace(code.prefixed("program"), F.col("program"), F.lit("")), 256)
    return rows.select("doc_id", cut(0, "from os import *").alias("as_function"), cut(1, "").alias("as_script"), prelude.alias("prelude_sha256"))


def integer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [r[:1] for r in KEYS], "given string").select("doc_id", code.whole_keys("given").alias("fixed"))


def output_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [r[:2] for r in OUTPUTS], "got string, want string")
    return rows.select("doc_id", compare.lenient("got", "want").alias("lenient"), compare.decimals("got", "want").alias("exact"))


def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [(r[0], r[2]) for r in PROBLEMS], "problem string, solution string")
    return rows.select("doc_id", prompts.clean_problem(F.col("problem"), ("DROP ",)).alias("problem"), prompts.strip_fence(F.col("solution")).alias("solution"))


def corrupted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a broken program fails all its tests, by the order's lines."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "pass").when(F.col("l_linenumber") % 5 == 0, "timeout").otherwise("fail")
    run, failures, errors = F.col("l_linenumber") % 3, F.col("l_linenumber") % 2, F.lit(1)
    return lines.select("l_orderkey", "l_linenumber", grading.fails_every_test(status, run, failures, errors).alias("fails"))


def accepted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that pass and are short enough."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("tokens", F.split(F.coalesce("text", F.lit("")), " "))
    return datasets.within_tokens(datasets.accepted(rows, "quality"), F.col("tokens"), 200).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def complexity_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 2).alias("a"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", rounded(similarity.complexity_similarity(F.col("a"), F.col("b"))).alias("similarity"))


def model_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning models by marks in their names, and prompts that ask a model to think or not."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("M"), F.when(F.col("c_custkey") % 3 == 0, "-R1-").when(F.col("c_custkey") % 3 == 1, "-o3-").otherwise("-chat-"), "c_name").alias("model"), "c_name")
    thinking = prompts.is_reasoning_model(F.col("model"), ("-r1", "-o3"))
    return rows.select("c_custkey", thinking.alias("reasons"), F.when(thinking, prompts.thinking_suffix(F.col("c_name"), True)).otherwise(prompts.thinking_suffix(F.col("c_name"), False)).alias("prompt"))


QUERIES = {f.__name__: f for f in (docstrings, assertions, response_blocks, changed_lines, script_rewrites, script_forms, integer_keys, output_compare, cleaned_rows, corrupted_verdicts, accepted_samples, complexity_similarity, model_kinds)}
ORACLES = {
    "docstrings": _expected([r[2:] for r in DOCSTRINGS], "made, found"),
    "assertions": _expected([(r[1], r[3]) for r in ASSERTIONS], "side, equal"),
    "response_blocks": _expected([r[1:] for r in BLOCKS], "block, enclosed"),
    "changed_lines": _expected([r[1:] for r in REPORTS], "n_lines").replace("n_lines FROM documents", "n_lines::BIGINT AS n_lines FROM documents"),
    "script_rewrites": _expected([r[1:] for r in SCRIPTS], "opened, wrapped"),
    "script_forms": _expected([(*r[1:], "55083c1dead8216e13fc2f91a14de8bc4e5bd4a41f07489303a46e7e21fc90d1") for r in FORMS], "as_function, as_script, prelude_sha256"),
    "integer_keys": _expected([r[1:] for r in KEYS], "fixed"),
    "output_compare": _expected([r[2:] for r in OUTPUTS], "lenient, exact"),
    "cleaned_rows": _expected([(r[1], r[3]) for r in PROBLEMS], "problem, solution"),
    "corrupted_verdicts": """
        SELECT l_orderkey, l_linenumber, status = 'fail' AND (l_linenumber % 3 = 0 OR l_linenumber % 2 + 1 = l_linenumber % 3) AS fails
        FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'pass' WHEN l_linenumber % 5 = 0 THEN 'timeout' ELSE 'fail' END AS status FROM lineitem)""",
    "accepted_samples": "SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n_tokens FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND len(string_split(coalesce(text, ''), ' ')) <= 200",
    "complexity_similarity": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 / (1 + abs(l_linenumber + 2 - l_quantity)) END, 6)::DOUBLE AS similarity FROM lineitem",
    "model_kinds": "SELECT c_custkey, c_custkey % 3 < 2 AS reasons, c_name || CASE WHEN c_custkey % 3 < 2 THEN ' \\think' ELSE ' \\nothink' END AS prompt FROM customer",
}
