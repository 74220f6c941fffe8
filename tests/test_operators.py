"""Sources, joins that need an order, the sandbox and the stream."""

import datetime
import json
import os
import re
import textwrap
import time

import pandas as pd
from emendata.operators import datasets, evaluation, grading, harness, passk, relational, runner, sandbox
from emendata.sources import benchmarks, connectors, jsonl, naming, schemas
from emendata.streaming import resume
from pyspark.sql import functions as F


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if r is not None else "" for r in rows) + "\n")


def test_solutions_keep_line_numbers(spark, tmp_path):
    write(tmp_path / "s.jsonl", [{"task_id": "a", "solution": "x"}, None, {"task_id": "b", "solution": "y"}])
    got = {r.task_id: r for r in jsonl.read_solutions(spark, str(tmp_path / "s.jsonl")).collect()}
    assert {t: (r._line, r._identifier) for t, r in got.items()} == {"a": (1, "a_1"), "b": (3, "b_3")}


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 700)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3700
    assert all(r.value.split()[0] == f"{r._file[-5]}{r._line}" for r in got)


def test_processed_ids(spark, tmp_path):
    assert jsonl.processed_ids(spark, str(tmp_path / "absent")).count() == 0
    write(tmp_path / "good.jsonl", [{"task_id": "a"}, {"task_id": "a"}, {"task_id": "b"}])
    assert {r.task_id for r in jsonl.processed_ids(spark, str(tmp_path / "good.jsonl")).collect()} == {"a", "b"}
    (tmp_path / "bad.jsonl").write_text('{"task_id": "a"}\n{broken\n')
    assert jsonl.processed_ids(spark, str(tmp_path / "bad.jsonl")).count() == 0



def test_results_and_lists(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x_eval_results.json").write_text('{"n": 1}')
    got = jsonl.read_results(spark, str(tmp_path)).collect()
    assert len(got) == 2 and got[0].path < got[1].path
    jsonl.append_list(spark.createDataFrame([("k1",), ("k2",)], "value string"), str(tmp_path / "list"))
    jsonl.append_list(spark.createDataFrame([("k2",)], "value string"), str(tmp_path / "list"))
    assert sorted(r.value for r in jsonl.read_list(spark, str(tmp_path / "list")).collect()) == ["k1", "k2"]


def test_names():
    assert naming.solutions_path("org/m", True, 5, explicit=True) == "data/code_edits/results_m_reasoning_explicit_5.jsonl"
    assert naming.solutions_path("m", False, 5, shots=2) == "data/code_edits/2_shot/results_m_non_reasoning_5.jsonl"
    assert naming.solutions_path("m", False, 5, generic=True) == "data/code_edits/zero_shot_generic/results_m_non_reasoning_5.jsonl"
    assert naming.scenario_path("output", "m", "codegeneration", 10, 0.2, ending="_eval") == "output/m/codegeneration_10_0.2_eval.json"
    assert naming.results_path("d/s.jsonl") == "d/results/s_eval_results.json"


def test_connector(spark):
    class Half(connectors.EchoConnector):
        def respond(self, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return super().respond(prompt)

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    made = connectors.generate(rows, Half())
    assert {r.id: r.error for r in made.collect()} == {1: None, 2: "ValueError: no"}
    assert [r.id for r in connectors.usable(made).collect()] == [1]
    lines = spark.createDataFrame([('{"custom_id": "2", "response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}',), ("broken",)], "value string")
    requests = spark.createDataFrame([("1",), ("2",)], "custom_id string")
    assert {r.custom_id: (r.response, r.error) for r in connectors.join_batch(requests, lines).collect()} == {"1": ("", "Result missing"), "2": ("hi", None)}
    failed = spark.createDataFrame([('{"custom_id": "1", "error": "late"}',)], "value string")
    assert {r.custom_id: (r.response, r.error) for r in connectors.join_batch(requests, lines, failed).collect()} == {"1": ("", "late"), "2": ("hi", None)}


def test_benchmark_tables(spark, tmp_path):
    tests = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    row = ("t", "c", "leetcode", "q1", "c1", "2024-03-01T00:00:00", "", "easy", tests, tests, '{"func_name": "f"}')
    late = (*row[:3], "q2", "c1", "2025-01-01T00:00:00", *row[6:])
    names = "question_title string, question_content string, platform string, question_id string, contest_id string, contest_date string, starter_code string, difficulty string, public_test_cases string, private_test_cases string, metadata string"
    spark.createDataFrame([row, late], names).write.parquet(str(tmp_path / "p"))
    got = benchmarks.generation_problems(spark, str(tmp_path / "p"), end="2024-12-31")
    assert [r.question_id for r in got.collect()] == ["q1"]
    sample = json.loads(benchmarks.evaluation_sample(got).first().input_output)
    assert sample == {"inputs": ["1", "1"], "outputs": ["2", "2"], "fn_name": "f"}


def test_ties_keep_the_file_order(spark):
    rows = spark.createDataFrame([("p", 1, 0, "c", "a"), ("p", 1, 1, "c", "b"), ("p", 3, 2, "c", "d"), ("p", 3, 3, "c", "e")], "problem_spec string, levenshtein int, _pos int, corrupted_answer string, completion string")
    pair = relational.best_and_worst(rows, "problem_spec", "levenshtein", "_pos").first()
    assert (pair.best.completion, pair.worst.completion) == ("a", "e")
    assert [r.completion for r in datasets.best_samples(rows).orderBy("_pos").collect()] == ["a", "b", "d"]
    record = datasets.preference_pairs(rows).first()
    assert (record.chosen, record.rejected) == ("a", "e")


def test_splits_partition_their_rows(spark):
    rows = spark.range(500).withColumn("key", F.col("id") % 50)
    train, test = relational.split_by_key(rows, "key", 2)
    assert train.count() + test.count() == 500 and not {r.key for r in train.select("key").distinct().collect()} & {r.key for r in test.select("key").distinct().collect()}
    for last in (False, True):
        train, test = relational.edge_split(rows, ["id"], 100, last)
        assert test.count() == 100 and train.count() == 400
    small = relational.edge_split(rows.filter("id < 10"), ["id"], 100)
    assert (small[0].count(), small[1].count()) == (5, 5)
    first = [r.id for r in relational.seeded_order(rows, "id", 4).collect()]
    assert first == [r.id for r in relational.seeded_order(rows.repartition(7), "id", 4).collect()] and sorted(first) == list(range(500))


def test_shapes_of_tests(spark):
    texts = ['[{"input": "1", "output": "2", "fn_name": "f"}]', '[{"inputs": "1", "outputs": "2"}]', '{"inputs": ["1", "3"], "outputs": ["2", "4"], "fn_name": "g"}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", grading.normalise_tests(F.col("t")).alias("t")).orderBy("i").collect()
    assert [[tuple(t) for t in r.t] for r in got] == [[("1", "2", "f")], [("1", "2", None)], [("1", "2", "g"), ("3", "4", "g")]]


def test_sandbox():
    test = "import unittest\nclass T(unittest.TestCase):\n    def test_a(self):\n        self.assertEqual(f(1), 2)\n    def test_b(self):\n        self.assertEqual(f(2), 3)\n"
    good = sandbox.run_unittest("def f(x): return x + 1", test, 20)
    assert (good["status"], good["tests_run"]) == ("pass", 2)
    bad = sandbox.run_unittest("def f(x): return 2", test, 20)
    assert (bad["status"], bad["failures"]) == ("fail", 1) and set(bad["details"]) == {"test_b"}
    assert sandbox.run_unittest("while True: pass", test, 1)["status"] == "timeout"
    assert sandbox.run_unittest("def f(", test, 20)["status"] == "fail"
    assert sandbox.run_tests("print(int(input()) * 2)", [("1", "2"), ("2", "4.0"), ("3", "7"), ("1", "2")], None, 20) == [1, 1, -2]
    assert sandbox.run_tests("def f(a, b): return (a, b)", [("1\n2", "[1, 2]")], "f", 20) == [1]
    assert sandbox.run_tests("1 / 0", [("", "")], None, 20) == [-4]


def test_metadata_of_failed_tests():
    codes, about = sandbox.run_graded("print(int(input()) * 2)", [("1", "2"), ("2", "5" * 400)], None, 20)
    assert codes == [1, -2] and about["error_code"] == -2 and about["inputs"] == "2" and about["output"] == "4\n" and len(about["expected"]) < 330
    codes, about = sandbox.run_graded("1 / 0", [("", "")], None, 20)
    assert codes == [-4] and about["error_message"] == "Runtime Error" and "ZeroDivisionError" in about["error"]
    assert sandbox.run_graded("while True: pass", [("", "")], None, 0.5)[1]["error_code"] == -3
    codes, about = sandbox.run_graded("def f(x): return x", [("1", "not json")], "f", 20)
    assert codes == [-4] and about["error_message"].startswith("Error during testing")
    assert sandbox.run_graded("def g(x): return x", [("1", "1")], "f", 20)[0] == [-4]
    assert sandbox.run_graded("def f(", [("1", "1")], None, 20)[0] == [-4] and sandbox.run_graded("1", [], None, 20)[0] == []
    assert sandbox.run_graded("print(1)", [("", None)], None, 20)[1]["error_code"] == -5  # the grader itself fails


def test_strict_grading_runs_scripts_as_functions():
    graded = lambda code, *tests: sandbox.run_graded(code, list(tests), None, 20)[0]
    assert graded("if 1:\n    print(input())\n    return", ("x", "x")) == [1]
    assert graded("if __name__ == '__main__':\n    print(gcd(4, 6), deque([1])[0])", ("", "2 1")) == [1]  # the prelude's names
    assert graded("import sys\nfor line in sys.stdin:\n    print(line.strip())\nsys.exit(3)", ("a\nb", "a\nb"), ("c", "c")) == [1, 1]
    assert graded("print(open(0).read().split()[1])", ("a b", "b")) == [1]
    assert graded("import sys\nsys.stdout.buffer.write(sys.stdin.buffer.readline())", ("é\nb", "é")) == [1]
    assert sandbox.run_graded("class Solution:\n    n = 0\n    def f(self):\n        self.n += 1\n        return self.n, 0", [("1", "[1, 0]")], "f", 20)[0] == [-4]


def children(pid):
    with open(f"/proc/{pid}/task/{pid}/children") as f:
        return f.read().split()


FORKS = "import os, time\nfor k in range(4):\n    if not os.fork():\n        if k % 2: os.setsid()\n        if not os.fork():\n            time.sleep(600)\n        time.sleep(600)\nprint(input())"


def test_what_programs_fork_does_not_outlive_them():
    own = runner.Runner()
    try:
        assert sandbox.run_graded(FORKS, [("a", "a"), ("b", "b")], None, 5, own)[0] == [1, 1]
        assert not children(own._server.pid)
        assert sandbox.verify(FORKS, [("a", "a"), ("b", "b")], None, 5, runner=own) == [1, 1]
        assert sandbox.run_unittest(FORKS.replace("print(input())", ""), "import unittest\nclass T(unittest.TestCase):\n    def test_a(self): pass", 5, own)["status"] == "pass"
        assert not children(own._server.pid)
        assert own.starts == 1  # one interpreter for all of them
    finally:
        own.close()


def test_output_without_end_is_bounded():
    own = runner.Runner(output=1 << 20)
    try:
        flood = "while True:\n    print('x' * 1000)"
        codes, about = sandbox.run_graded(flood, [("", "x")], None, 20, own)
        assert codes == [-4] and "File too large" in about["error"]
        assert sandbox.verify(flood, [("", "x")], None, 20, runner=own) == [-3]
        out, _, code = own.script("import os\nwhile True:\n    os.write(2, b'e' * 4096)", "", 20)
        assert out == "" and code
        with open(f"/proc/{own._server.pid}/status") as f:
            assert int(re.search(r"VmRSS:\s+(\d+)", f.read())[1]) < 400_000
        long = "def f(x): return 'y' * (1 << 24)"
        assert sandbox.run_graded(long, [("1", '"y"')], "f", 20, own)[0] == [-2]
        assert own.script("print('a' * 10)", "", 20)[0] == "a" * 10 + "\n" and own.starts == 1
    finally:
        own.close()


def test_a_test_that_swallows_its_timer_meets_the_limit_of_all():
    own = runner.Runner()
    try:
        stubborn = "while True:\n    try:\n        while True: pass\n    except Exception: pass"
        begin = time.monotonic()
        codes, about = sandbox.run_graded("n = input()\nif n == 'a': print(n)\nelse:\n" + textwrap.indent(stubborn, "    "), [("a", "a"), ("b", "b")], None, 0.3, own)
        assert codes == [-1, -1] and about["error_code"] == -1 and 7 < time.monotonic() - begin < 12
        assert not children(own._server.pid)
        assert sandbox.run_graded("def f(x):\n    while True: pass", [("1", "1")], "f", 0.3, own)[0] == [-3]
    finally:
        own.close()


def test_a_program_that_kills_the_server_or_itself_is_an_error():
    own = runner.Runner()
    try:
        assert sandbox.run_graded("import os, signal\nos.kill(os.getppid(), signal.SIGKILL)\nimport time\ntime.sleep(60)", [("", "")], None, 5, own)[0] == [-4]
        assert sandbox.run_graded("import os\nos._exit(0)", [("", "")], None, 5, own)[0] == [-4]
        assert sandbox.run_graded("print(input())", [("a", "a")], None, 5, own)[0] == [1] and own.starts == 2
        assert sandbox.run_graded("x = bytearray(1 << 33)", [("", "")], None, 5, own)[0] == [-4]  # more memory than it may have
        assert sandbox.verify("import sys\nsys.exit('no')", [("", "")], None, 5, runner=own) == [-3]
        assert own.script("print(open('f', 'w').write('x'), __name__)", "", 5)[0] == "1 __main__\n"
        assert own.script("import os\nprint(os.listdir('.'), sorted(os.environ))", "", 5)[0].startswith("[] [")
    finally:
        own.close()


def test_lenient_verifier(spark):
    assert sandbox.verify("n = int(input())\nprint(n / 3)", [("1", "0.333333333"), ("2", "0.66666666")], None, 20) == [1, 1]
    assert sandbox.verify("print(1)", [("", "1"), ("", "2"), ("", "1")], None, 20) == [1, 0]
    assert sandbox.verify("import sys\nif 1:\n    print(input())\n    return\n", [("x", "x")], None, 20) == [1]  # as a function
    assert sandbox.verify("while True: pass", [("", "")], None, 0.5) == [-1]
    assert sandbox.verify("print(", [("", "")], None, 20) == [-2] and sandbox.verify("1 / 0", [("", "")], None, 20) == [-3]
    assert sandbox.verify("def f(a): return [a, gcd(4, 6)]", [("1", "[1, 2]")], "f", 20) == [1]
    assert sandbox.verify("def g(a): return a", [("1", "1")], "f", 20) == [-2]
    many = [("a" * k, "") for k in (1, 5, 3, 5, 2, 4, 9)]
    assert len(sandbox.verify("input()", many, None, 20)) == 5
    rows = spark.createDataFrame([("print(input())", [("a", "a")], None), ("print(input())", [], None)], "code string, tests array<struct<input:string,output:string>>, fn_name string")
    assert sorted((r.codes, r.passed) for r in sandbox.verified(rows, seconds=20).collect()) == [([], False), ([1], True)]


def test_sandbox_in_a_table(spark):
    rows = spark.createDataFrame([("print(input())", [("a", "a")], None), ("print(1)", [("a", "a")], None)], "code string, tests array<struct<input:string,output:string>>, fn_name string")
    assert sorted(r.codes for r in sandbox.grade(rows, seconds=20).collect()) == [[-2], [1]]


def test_execution_results(spark):
    rows = spark.createDataFrame([("sample_1", "def f(a):\n    return a + 1", "f(1)", "f(1)", ["2", "3", "f(1)"]), ("sample_2", "x = 1", "x", "x", ["x", "x x"])], "id string, code string, input string, output string, generations array<string>")
    got = {r.id: r.graded for r in sandbox.execution_results(rows, 20).collect()}
    assert got == {"sample_1": [True, False], "sample_2": [False, False]}
    assert passk.mean_of_rows(sandbox.execution_results(rows, 20)).first().pass_at_1 == 25.0


def test_samples_of_other_benchmarks(spark, tmp_path):
    ids = spark.createDataFrame([("sample_10", "c"), ("sample_9", "d")], "id string, code string").withColumns({"input": F.lit("i"), "output": F.lit("o")})
    ids.write.parquet(str(tmp_path / "e"))
    assert [r.id for r in benchmarks.execution_sample(benchmarks.execution_problems(spark, str(tmp_path / "e"))).collect()] == ["sample_9", "sample_10"]
    tests = spark.createDataFrame([("q", 1, "text", '[{"input": "1", "output": "2", "testtype": "functional"}]')], "question_id string, test_id int, question_content string, test string")
    benchmarks.write_dataset(tests, str(tmp_path / "t"), "test")
    row = benchmarks.test_output_sample(benchmarks.test_output_problems(spark, str(tmp_path / "t" / "test"))).first()
    assert (row.input, row.output) == ("text", "2")


def test_evaluation(spark):
    same = "def f(a):\n    return a + 1\n"
    rows = spark.createDataFrame([("t", 1, same, same.replace("+", "-"), same), ("u", 2, "", None, same)], "task_id string, _line long, solution string, corrupted_solution string, canonical_solution string")
    long = evaluation.similarity_long(rows)
    got = {(r.pair, r.variant, r.metric): r.value for r in long.filter("task_id = 't'").collect()}
    assert len(got) == 3 * 4 * len(evaluation.METRICS)
    assert got["llm_vs_canonical", "", "levenshtein"] == 0 and got["llm_vs_corrupted", "", "levenshtein"] == 1
    assert got["llm_vs_canonical", "", "diffsitter"] == 0 and got["llm_vs_corrupted", "", "diffsitter"] == 1 and got["llm_vs_corrupted", "", "normalized_diffsitter"] == 0.5
    assert long.filter("task_id = 'u'").count() == 0
    summary = {(r.pair, r.variant, r.metric): r.mean for r in evaluation.summarise(long).collect()}
    assert summary["llm_vs_corrupted", "body_", "levenshtein"] == 1
    deltas = evaluation.complexity_rows(rows).filter("task_id = 't'").first()
    assert deltas.cyclomatic_canonical_llm == 0


def test_stream_resumes(spark, tmp_path):
    """The first of each key and horizon over several runs, and the state of keys that are over is dropped."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ddl = "task_id string, event_id long, ts timestamp"
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    batches = [
        [("a", 2, day(1, 5)), ("a", 1, day(1, 5)), ("a", 9, day(1, 9)), ("b", 3, day(2)), (None, 4, day(2)), ("n", 5, None)],
        [("a", 6, day(3)), ("b", 7, day(1, 1)), ("c", 8, day(4))],
        [("a", 10, day(9)), ("b", 11, day(8)), ("a", 12, day(8, 6)), ("late", 13, day(1))],
        [("d", 14, day(28))],
        [("b", 15, day(29)), ("b", 16, day(28, 12)), ("a", 17, day(15))],
    ]
    seen, sizes = [], []
    for rows in batches:
        spark.createDataFrame(rows, ddl).repartition(2).write.mode("append").json(folder)
        stream = resume.first_records(resume.new_records(spark, folder, ddl), horizon=datetime.timedelta(days=7), late="1 day")
        query = resume.append_batches(stream, out, state)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = spark.read.schema(ddl).option("recursiveFileLookup", "true").json(out).collect()
        seen.append(sorted(r.event_id for r in got))
    assert seen == [[1, 3], [1, 3, 8], [1, 3, 8, 12], [1, 3, 8, 12, 14], [1, 3, 8, 12, 14, 16]]
    # 11 came within seven days of 3 and a day less; a late row and rows without key or time give nothing
    assert sizes[3] < sizes[2]  # timers have dropped what the watermark has passed


def test_first_passing_judges_no_more_than_it_needs(spark):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def verdict(v):
        judged.add(1)
        return v % 3 == 0

    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 50)).alias("t"), F.col("id").alias("v")).repartition(5)
    for order, n in ((["k"], 30), (["t", "k"], 20), (["t", "k"], 0)):
        judged.value = 0
        got = harness.first_passing(rows, verdict("v"), order, n, splitters=256)
        want = rows.filter("v % 3 = 0").orderBy(*order).limit(n)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        assert judged.value < 3000  # of 20,000
    every = harness.first_passing(rows, F.col("v") > 19_990, ["k"], 50, splitters=16)
    assert every.count() == 9 and harness.first_passing(rows.limit(0), F.col("v") > 0, ["k"], 5).count() == 0


def test_schemas_parse(spark):
    from pyspark.sql.types import StructType

    for name in ("PROBLEMS", "QUESTIONS", "SOLUTIONS", "VERDICTS", "GENERATION_PROBLEMS", "EXECUTION_PROBLEMS", "TEST_OUTPUT_PROBLEMS", "EDITS", "SYNTHETIC", "CHAT", "PREFERENCE"):
        assert StructType.fromDDL(getattr(schemas, name)).fields


def test_stream_keeps_groups_of_keys_in_a_row(spark, tmp_path, monkeypatch):
    """Keys that share a row of state do not meet: each is given once within the horizon, and dropped at its end."""
    monkeypatch.setattr(resume, "BUCKETS", 4, raising=False)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ddl = "task_id string, event_id long, ts timestamp"
    sizes = []
    for begin, days in ((0, (1, 2)), (1000, (8,)), (2000, (25,))):
        rows = [(f"k{k}", begin + 100 * d + k, datetime.datetime(2024, 1, d, k % 24)) for d in days for k in range(0 if begin < 2000 else 50, 60)]
        spark.createDataFrame(rows, ddl).write.mode("append").json(folder)
        query = resume.append_batches(resume.first_records(resume.new_records(spark, folder, ddl)), out, state)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(r.event_id for r in spark.read.schema(ddl).option("recursiveFileLookup", "true").json(out).collect())
    assert got == [100 + k for k in range(60)] + [1800 + k for k in range(60)] + [4500 + k for k in range(50, 60)]
    assert max(sizes) <= 16  # a value and its timers


def test_metrics_are_given_in_small_frames():
    class Table:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802  name of the interface
            return run

    whole = pd.DataFrame({"task_id": [str(k) for k in range(1000)], "line": range(1000), "solution": "a = 1", "corrupted_solution": "a = 2", "canonical_solution": "a = 1"})
    each = len(evaluation.PAIRS) * len(evaluation.VARIANTS) * len(evaluation.METRICS)
    made = list(evaluation.similarity_long(Table())(iter([whole, whole])))
    assert max(map(len, made)) < evaluation.SLICE + each and sum(map(len, made)) == 2000 * each
    assert [k for f in made for k in f["_line"][:: each]][:70] == list(range(70))
