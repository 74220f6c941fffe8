"""Queries about sources and sinks: tables are written to the shared folder by the sinks, and read back by the scans."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import harness, relational
from ..sources import batch_jobs, benchmarks, cache, connectors, jsonl, naming, versions
from .tables import table, work_folder


def folder_of(spark: SparkSession) -> str:
    return work_folder(spark, "files")


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: task_id, and two columns of text that are never null."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("task_id"), F.coalesce("lang", F.lit("none")).alias("solution"), F.coalesce("source", F.lit("none")).alias("corrupted_solution"))


def _lines(rows: DataFrame, path: str, blank: bool = False) -> None:
    """Ranges of the records in the order of doc_id as JSON lines, each with a blank line behind it if wanted."""
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    json = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]))
    (ordered.select(F.explode(F.array(json, F.lit(" "))).alias("value")) if blank else ordered.select(json.alias("value"))).write.text(path)


def _place(step: int) -> Column:
    """Whether a record's line number is its place among the file's records, of which every ``step``-th line holds one."""
    rank = F.row_number().over(Window.partitionBy("_file").orderBy(F.col("task_id").cast("long")))
    return (F.col("_line") == step * rank - (step - 1)).alias("in_order")


def solution_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their line numbers; blank lines are skipped, but counted."""
    path = folder_of(spark) + "/samples"
    _lines(records_of(spark, sf_dir), path, blank=True)
    rows = jsonl.read_solutions(spark, path)
    return rows.select("task_id", "solution", _place(2), (F.col("_identifier") == F.concat_ws("_", "task_id", F.col("_line").cast("string"))).alias("identified"))


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, which may have no blank line, and worked examples, which may."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir).drop("solution").withColumn("mutation_types", F.array(F.lit("a"), "corrupted_solution"))
    for name, blank in (("questions", False), ("shots", True)):
        _lines(rows, f"{folder}/{name}", blank)
    read = [(jsonl.read_questions(spark, f"{folder}/questions"), "questions", 1), (jsonl.read_shots(spark, f"{folder}/shots"), "shots", 2)]
    shown = [df.select("task_id", "corrupted_solution", F.array_join("mutation_types", ",").alias("mutations"), _place(step), F.lit(name).alias("kind")) for df, name, step in read]
    return shown[0].union(shown[1])


def resumed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has left after two batches were appended, one of them twice; and after a line of the output was broken."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir)
    for part in (0, 1, 1):
        jsonl.append(rows.filter(F.col("doc_id") % 3 == part), f"{folder}/out")
    done = jsonl.processed_ids(spark, f"{folder}/out")
    left = relational.unprocessed(rows, done).select("task_id", F.lit("left").alias("kind"))
    jsonl.append(rows.filter("doc_id % 3 = 0"), f"{folder}/broken")
    spark.createDataFrame([('{"task_id": ',)], "value string").write.mode("append").text(f"{folder}/broken")
    anew = relational.unprocessed(rows, jsonl.processed_ids(spark, f"{folder}/broken")).select("task_id", F.lit("anew").alias("kind"))
    complete = relational.all_processed(rows.filter("doc_id % 3 < 2"), done), relational.all_processed(rows, done)
    return left.union(anew).withColumn("complete", F.lit(",".join(str(c).lower() for c in complete)))


def failed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that is appended to twice, read as a set."""
    path = folder_of(spark) + "/failed"
    rows = records_of(spark, sf_dir).select("doc_id", F.concat("task_id", F.lit(" "), "solution").alias("value"))
    for part in ("doc_id % 3 = 0", "doc_id % 2 = 0"):
        jsonl.append_list(rows.filter(part), path)
    return jsonl.read_list(spark, path)


def rewritten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that replaces itself, twice, beside one whose second writer stops before it publishes."""
    folder, ddl = folder_of(spark), "task_id string, solution string"
    shown = []
    for name, stops in (("whole", None), ("stopped", "publish")):
        path = f"{folder}/{name}"
        jsonl.append(records_of(spark, sf_dir).select("task_id", "solution"), path)
        for mark in ("a", "b"):
            rows = versions.read(spark, path, ddl).filter("solution != 'none'").withColumn("solution", F.concat("solution", F.lit(mark)))

            def stop(step: str, at: str | None = stops if mark == "b" else None) -> None:
                if step == at:
                    raise InterruptedError(step)

            with contextlib.suppress(InterruptedError):
                versions.VersionedTable(spark, path, stop).rewrite(rows)
        shown.append(versions.read(spark, path, ddl).withColumn("name", F.lit(name)))
    return shown[0].union(shown[1])


def cache_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache over three runs: the first asks some prompts, the second what the cache has not, and the third finds all."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull()).select("conv_id", "turn", F.col("text").alias("prompt"), F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    store = cache.PromptCache(spark, folder_of(spark) + "/cache", buckets=16)
    store.upsert(turns.filter("conv_id % 2 = 0").withColumn("outputs", F.array(F.concat(F.lit("first "), "name"))))
    hits, misses = store.lookup(turns, 1)
    outcome = hits.select("conv_id", "turn", F.lit("hit").alias("outcome")).union(misses.select("conv_id", "turn", F.lit("miss").alias("outcome")))
    store.upsert(misses.withColumn("outputs", F.array(F.concat(F.lit("second "), "name"))))
    found, missed = store.lookup(turns, 1)
    final = found.select("conv_id", "turn", F.col("outputs")[0].alias("output")).union(missed.select("conv_id", "turn", F.lit("missed")))
    return outcome.join(final, ["conv_id", "turn"])


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs, found by their names among other files."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir).select("task_id", "solution")
    for stem in ("one", "two"):
        rows.withColumn("run", F.lit(stem)).write.json(naming.results_path(f"{folder}/{stem}/{stem}.jsonl"))
        jsonl.append(rows.limit(0), f"{folder}/{stem}/{stem}.jsonl")
    found = jsonl.read_results(spark, folder)
    return found.select(F.regexp_extract("path", r"/([^/]*)_eval_results\.json$", 1).alias("stem"), F.get_json_object("json", "$.run").alias("run"), F.get_json_object("json", "$.task_id").alias("task_id"))


def scenario_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three outputs of a run, in the order of question_id, read by their names."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir).select(F.col("task_id").alias("question_id"), F.array("solution").alias("code_list"))
    graded = harness.with_scores(rows.withColumn("graded_list", F.array(F.col("code_list")[0] == "en", F.lit(True))))
    jsonl.write_results({"": rows, "_eval": graded.select("question_id", "pass_at_1"), "_eval_all": graded}, folder, "codegeneration_10_0.2")
    out = None
    for suffix in ("", "_eval", "_eval_all"):
        path = naming.scenario_path("output", "m", "codegeneration", 10, 0.2, ending=suffix).rpartition("/")[2]
        read = spark.read.schema("question_id string, code_list array<string>, pass_at_1 double").json(f"{folder}/{path}")
        shown = read.select(F.lit(path).alias("file"), "question_id", F.array_join("code_list", ",").alias("codes"), "pass_at_1")
        out = shown if out is None else out.union(shown)
    return out


def partitioned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of several models, modes and numbers of examples in one table, of which one is read by its partition."""
    path = folder_of(spark) + "/runs"
    rows = records_of(spark, sf_dir).select("task_id")
    for model, mode, shots in (("m", "reasoning", 0), ("m", "plain", 2), ("n", "plain", 2)):
        naming.write_partitioned(rows.filter(F.col("task_id") % 2 == shots % 2), path, model, mode, shots)
    return spark.read.parquet(path).filter("mode = 'plain'").select("task_id", "model", "mode", "num_shots")


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set is published in two splits, and its registry names the files."""
    folder = folder_of(spark)
    rows = records_of(spark, sf_dir)
    for split, part in (("train", "doc_id % 10 > 0"), ("test", "doc_id % 10 = 0")):
        benchmarks.write_dataset(rows.filter(part).select("task_id"), folder, split)
    naming.register_dataset(spark, {s: {"file_name": f"{s}.parquet", "formatting": "sharegpt", "columns": {"messages": "conversations"}, "ranking": s == "test"} for s in ("train", "test")}, f"{folder}/registry")
    entries = spark.read.schema("name string, file_name string, formatting string, columns map<string,string>, ranking boolean").json(f"{folder}/registry")
    data = [spark.read.parquet(f"{folder}/{s}").select("task_id", F.lit(s).alias("name")) for s in ("train", "test")]
    return data[0].union(data[1]).join(entries, "name").select("task_id", "name", "file_name", F.col("columns")["messages"].alias("messages"), "ranking")


def custom_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists of records with code_list or pred_list, each a file of two thousand items."""
    path = folder_of(spark) + "/custom"
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("question_id"), F.lit("0").alias("test_id"), F.array(F.coalesce("text", F.lit("")), F.lit('"}],\\{["')).alias("texts"))
    odd = F.col("item_id") % 2 == 1
    record = F.to_json(F.struct("question_id", "test_id", F.when(odd, F.col("texts")).alias("code_list"), F.when(~odd, F.col("texts")).alias("pred_list")))
    listed = items.select("item_id", F.expr("item_id div 2000").alias("part"), record.alias("record"))
    edges = listed.groupBy(F.col("part").alias("_part")).agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"))
    line = F.concat(F.when(F.col("item_id") == F.col("low"), F.lit("[\n")).otherwise(F.lit("")), "record", F.when(F.col("item_id") == F.col("high"), F.lit("\n]")).otherwise(F.lit(",")))
    lines = listed.join(edges, F.col("part") == F.col("_part")).select("part", "item_id", line.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "item_id").select("part", "value").write.partitionBy("part").text(path)
    return jsonl.read_custom_outputs(spark, f"{path}/*").select("question_id", "test_id", F.array_join("outputs", "|").alias("outputs"))


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull())
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("item_id") % 3 + 1).cast("int"))
    test = lambda k: F.concat(F.lit('[{"input": "'), F.col("item_id").cast("string"), F.lit(f'", "output": "{k}", "testtype": "stdin"}}]'))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 300).cast("int")), "yyyy-MM-dd'T'00:00:00")
    return items.select(
        *[F.lit("t").alias("question_title"), F.col("text").alias("question_content"), pick("leetcode", "codeforces", "atcoder").alias("platform"), F.col("item_id").cast("string").alias("question_id"), F.lit("c").alias("contest_id")],
        *[day.alias("contest_date"), F.lit("").alias("starter_code"), pick("easy", "medium", "hard").alias("difficulty"), test(1).alias("public_test_cases"), test(2).alias("private_test_cases"), F.lit('{"func_name": "f"}').alias("metadata")],
    )


def generation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a range of dates, their tests as one JSON of parallel lists, and the row that a run writes of each."""
    path = folder_of(spark) + "/problems"
    benchmarks.write_dataset(_problems(spark, sf_dir), path, "test")
    problems = benchmarks.generation_problems(spark, f"{path}/test", start="2024-02-01", end="2024-09-01")
    outputs = problems.select("question_id", F.array(F.lit("a"), F.lit("b")).alias("output_list"), F.array(F.lit("a"), F.lit("b")).alias("code_list"), F.array(F.lit(True), F.lit(False)).alias("graded_list"))
    rows = harness.inserted(problems, outputs, "codegeneration", graded=True)
    shown = rows.select("question_id", "contest_date", "platform", "difficulty", F.array_join("code_list", ",").alias("codes"), "pass_at_1")
    return shown.join(benchmarks.evaluation_sample(problems), "question_id")


def execution_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by the number in their id, and what is compared of each; with the row that a run writes."""
    path = folder_of(spark) + "/problems"
    items = _problems(spark, sf_dir).select("question_id", "contest_id", "contest_date", "difficulty", F.lit("f").alias("function_name"), F.lit("def f(): pass").alias("code"), F.concat(F.lit("f("), "question_id", F.lit(")")).alias("input"), F.lit("None").alias("output"), F.concat(F.lit("sample_"), "question_id").alias("id"), F.lit("p").alias("problem_id"), F.lit(3).alias("numsteps"))
    benchmarks.write_dataset(items.withColumn("contest_date", F.to_timestamp("contest_date")), path, "test")
    problems = benchmarks.execution_problems(spark, f"{path}/test")
    outputs = problems.select("id", F.array("input").alias("output_list"), F.array("output").alias("pred_list"))
    rows = harness.inserted(problems, outputs, "codeexecution").select("id", "question_id", "contest_date", "numsteps", F.array_join("pred_list", ",").alias("preds"))
    return rows.join(benchmarks.execution_sample(problems), "id").select(*rows.columns, "input", "output")


def test_output_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with the first test's output as what is expected, and the row that a run writes."""
    path = folder_of(spark) + "/problems"
    items = _problems(spark, sf_dir).select("question_title", "question_content", "question_id", "contest_id", F.to_timestamp("contest_date").alias("contest_date"), "difficulty", F.col("private_test_cases").alias("test"), "starter_code", F.lit("f").alias("function_name"), F.lit(0).alias("test_id"))
    benchmarks.write_dataset(items, path, "test")
    problems = benchmarks.test_output_problems(spark, f"{path}/test")
    outputs = problems.select("question_id", "test_id", F.array("function_name").alias("output_list"), F.array("function_name").alias("pred_list"), F.array(F.lit(True)).alias("graded_list"))
    rows = harness.inserted(problems, outputs, "testoutputprediction", graded=True).select("question_id", "test_id", "function_name", F.array_join("pred_list", ",").alias("preds"), "pass_at_1")
    return rows.join(benchmarks.test_output_sample(problems), ["question_id", "test_id"]).select(*rows.columns, "input", "output")


def ordered_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new rows in the order of the number in their id; the items are few, so one window numbers them."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("sample_"), F.col("item_id").cast("string")).alias("id"))
    rows = harness.combined(items.filter("item_id % 2 = 0").select("id"), items.filter("item_id % 2 = 1").select("id"), "codeexecution")
    return rows.withColumn("at", F.monotonically_increasing_id()).select("id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def connector_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a run writes from its connector's answers; empty prompts have no usable one."""
    asked = records_of(spark, sf_dir).select("task_id", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("x = "), "task_id")).otherwise(F.lit("")).alias("prompt"))
    answered = connectors.generate(asked, connectors.EchoConnector())
    empty = answered.withColumn("final_answer", F.when(F.col("prompt") != "", F.col("final_answer")).otherwise(F.lit("")))
    rows = connectors.result_rows(empty, ["task_id"])
    return rows.select("task_id", "solution", F.length("llm_response").cast("long").alias("n_characters"), F.col("token_usage.total_tokens").alias("total_tokens"))


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch job's request lines, and its output and error lines joined back: some answered, some failed, some missing."""
    asked = records_of(spark, sf_dir).select(F.concat(F.lit("task-"), "task_id").alias("custom_id"), F.lit("be kind").alias("system"), F.col("solution").alias("prompt"), "doc_id")
    path = folder_of(spark) + "/requests"
    connectors.batch_requests(asked, "m-1_minimal").write.text(path)
    sent = spark.read.text(path)
    get = lambda p: F.get_json_object("value", f"$.{p}")
    number = F.regexp_extract(get("custom_id"), r"(\d+)$", 1).cast("long") % 4
    answer = F.to_json(F.struct(get("custom_id").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("re: "), get("body.messages[1].content")).alias("content"), F.lit("because").alias("reasoning")).alias("message"))).alias("choices"), F.struct(F.lit(3).alias("prompt_tokens"), F.lit(4).alias("completion_tokens"), F.lit(9).alias("total_tokens")).alias("usage")).alias("body")).alias("response")))
    output = sent.filter(number < 2).select(answer.alias("value"))
    errors = sent.filter(number == 2).select(F.to_json(F.struct(get("custom_id").alias("custom_id"), F.lit("too long").alias("error"))).alias("value"))
    joined = connectors.join_batch(asked.drop("doc_id"), output, errors)
    effort = sent.select(get("custom_id").alias("custom_id"), F.concat_ws("|", get("body.model"), get("body.reasoning_effort"), get("url"), get("body.messages[0].content")).alias("request"))
    return joined.join(effort, "custom_id").select("custom_id", "request", "response", "reasoning", "error", "total_tokens", "reasoning_tokens")


def batch_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch job whose answers and errors come in parts, in no order, between polls; some requests are never answered."""
    folder = folder_of(spark)
    asked = records_of(spark, sf_dir).select(F.concat(F.lit("task-"), "task_id").alias("custom_id"), F.lit("be kind").alias("system"), F.col("solution").alias("prompt"))
    connectors.batch_requests(asked, "m-1").write.text(f"{folder}/requests")
    sent, get = spark.read.text(f"{folder}/requests"), lambda p: F.get_json_object("value", f"$.{p}")
    number, spread = F.regexp_extract(get("custom_id"), r"(\d+)$", 1).cast("long"), F.pmod(F.xxhash64(get("custom_id")), F.lit(3))
    message = F.struct(F.struct(F.concat(F.lit("re: "), get("body.messages[1].content")).alias("content")).alias("message"))
    answer = F.to_json(F.struct(get("custom_id").alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    error = F.to_json(F.struct(get("custom_id").alias("custom_id"), F.lit("too long").alias("error")))
    names = iter((("1-output", answer, (number % 4 < 2) & (spread == 0)), ("2-errors", error, number % 4 == 2), ("3-output", answer, (number % 4 < 2) & (spread > 0))))

    def deliver() -> None:
        """The service's next part; its end comes with the last."""
        if (part := next(names, None)) is None:
            spark.createDataFrame([("completed",)], "value string").coalesce(1).write.text(f"{folder}/ended")
            _renamed(spark, f"{folder}/ended", f"{folder}/job/status")
        else:
            name, line, chosen = part
            sent.filter(chosen).select(line.alias("value")).write.text(f"{folder}/job/parts/{name}")

    job = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/job")
    uri = job.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(job).toUri().toString()
    done = batch_jobs.collect_job(asked, f"{folder}/lines", f"{folder}/state", wait=deliver, most_polls=10, path=uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return done.select("custom_id", "response", "error")


def _renamed(spark: SparkSession, folder: str, target: str) -> None:
    """The one file with rows of a folder that Spark wrote, under another name."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, target)]
    fs = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.listStatus(paths[0]) if s.getPath().getName().startswith("part-") and s.getLen()]
    fs.rename(part, paths[1])


def thinking_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(e) for e in ("", "_low", "_medium", "_high", "_minimal")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("m_low_"), F.col("c_custkey").cast("string"), ends).alias("model"))
    return rows.select("c_custkey", extract.thinking_budget(F.col("model")).alias("budget"), extract.effort_suffix(F.col("model"), minimal=True).alias("effort"), extract.model_base(F.col("model"), minimal=True).alias("base"))


QUERIES = {f.__name__: f for f in (solution_lines, question_lines, resumed_ids, failed_list, rewritten_table, cache_upserts, result_files, scenario_outputs, partitioned_runs, dataset_registry, custom_outputs, generation_problems, execution_problems, test_output_problems, ordered_outputs, connector_answers, batch_files, batch_polling, thinking_budgets)}
_RECORDS = "records AS (SELECT doc_id, doc_id::VARCHAR AS task_id, coalesce(lang, 'none') AS solution, coalesce(source, 'none') AS corrupted_solution FROM documents)"
_ITEMS = "items AS (SELECT *, item_id::VARCHAR AS question_id, (DATE '2024-01-01' + (item_id % 300)::INT)::DATE AS day FROM benchmark WHERE text IS NOT NULL)"
ORACLES = {
    "solution_lines": f"WITH {_RECORDS} SELECT task_id, solution, TRUE AS in_order, TRUE AS identified FROM records",
    "question_lines": f"WITH {_RECORDS} SELECT task_id, corrupted_solution, 'a,' || corrupted_solution AS mutations, TRUE AS in_order, kind FROM records, (VALUES ('questions'), ('shots')) k(kind)",
    "resumed_ids": f"WITH {_RECORDS} SELECT task_id, kind, 'true,false' AS complete FROM records JOIN (VALUES ('left'), ('anew')) k(kind) ON kind = 'anew' OR doc_id % 3 = 2",
    "failed_list": f"WITH {_RECORDS} SELECT task_id || ' ' || solution AS value FROM records WHERE doc_id % 3 = 0 OR doc_id % 2 = 0",
    "rewritten_table": f"WITH {_RECORDS} SELECT task_id, solution || marks AS solution, name FROM records, (VALUES ('whole', 'ab'), ('stopped', 'a')) v(name, marks) WHERE solution <> 'none'",
    "cache_upserts": """
        WITH turns AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS name FROM conversations WHERE text IS NOT NULL),
        first AS (SELECT text, arg_max(name, conv_id * 1000 + turn) AS name FROM turns WHERE conv_id % 2 = 0 GROUP BY text),
        every AS (SELECT text, arg_max(name, conv_id * 1000 + turn) AS name FROM turns GROUP BY text)
        SELECT conv_id, turn, CASE WHEN first.text IS NULL THEN 'miss' ELSE 'hit' END AS outcome, coalesce('first ' || first.name, 'second ' || every.name) AS output
        FROM turns JOIN every USING (text) LEFT JOIN first USING (text)""",
    "result_files": f"WITH {_RECORDS} SELECT stem, stem AS run, task_id FROM records, (VALUES ('one'), ('two')) s(stem)",
    "scenario_outputs": f"""
        WITH {_RECORDS} SELECT 'codegeneration_10_0.2' || suffix || '.json' AS file, task_id AS question_id, CASE WHEN suffix <> '_eval' THEN solution END AS codes, CASE WHEN suffix <> '' THEN CASE WHEN solution = 'en' THEN 1 ELSE 0.5 END END::DOUBLE AS pass_at_1
        FROM records, (VALUES (''), ('_eval'), ('_eval_all')) s(suffix)""",
    "partitioned_runs": "SELECT doc_id::VARCHAR AS task_id, model, 'plain' AS mode, 2 AS num_shots FROM documents, (VALUES ('m'), ('n')) m(model) WHERE doc_id % 2 = 0",
    "dataset_registry": "SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS name, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END || '.parquet' AS file_name, 'conversations' AS messages, doc_id % 10 = 0 AS ranking FROM documents",
    "custom_outputs": "SELECT item_id::VARCHAR AS question_id, '0' AS test_id, coalesce(text, '') || '|\"}],\\{[\"' AS outputs FROM benchmark",
    "generation_problems": f"""
        WITH {_ITEMS} SELECT question_id, strftime(day, '%Y-%m-%dT00:00:00') AS contest_date, ['leetcode', 'codeforces', 'atcoder'][item_id % 3 + 1] AS platform, ['easy', 'medium', 'hard'][item_id % 3 + 1] AS difficulty, 'a,b' AS codes, 0.5::DOUBLE AS pass_at_1,
            '{{"inputs":["' || item_id || '","' || item_id || '"],"outputs":["1","2"],"fn_name":"f"}}' AS input_output
        FROM items WHERE day BETWEEN DATE '2024-02-01' AND DATE '2024-09-01'""",
    "execution_problems": f"WITH {_ITEMS} SELECT 'sample_' || question_id AS id, question_id, strftime(day, '%Y-%m-%dT00:00:00') AS contest_date, 3 AS numsteps, 'None' AS preds, 'f(' || question_id || ')' AS input, 'None' AS output FROM items",
    "test_output_problems": f"WITH {_ITEMS} SELECT question_id, 0 AS test_id, 'f' AS function_name, 'f' AS preds, 1.0::DOUBLE AS pass_at_1, text AS input, '2' AS output FROM items",
    "ordered_outputs": "SELECT 'sample_' || item_id AS id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark",
    "connector_answers": "SELECT doc_id::VARCHAR AS task_id, 'x = ' || doc_id AS solution, length('x = ' || doc_id) + 14 AS n_characters, 6::BIGINT AS total_tokens FROM documents WHERE doc_id % 5 > 0",
    "batch_files": f"""
        WITH {_RECORDS} SELECT 'task-' || task_id AS custom_id, 'm-1|minimal|/v1/chat/completions|be kind' AS request, CASE WHEN doc_id % 4 < 2 THEN 're: ' || solution ELSE '' END AS response, CASE WHEN doc_id % 4 < 2 THEN 'because' ELSE '' END AS reasoning,
            CASE doc_id % 4 WHEN 2 THEN 'too long' WHEN 3 THEN 'Result missing' END AS error, CASE WHEN doc_id % 4 < 2 THEN 9 END::BIGINT AS total_tokens, CASE WHEN doc_id % 4 < 2 THEN 2 END::BIGINT AS reasoning_tokens FROM records""",
    "batch_polling": f"""
        WITH {_RECORDS} SELECT 'task-' || task_id AS custom_id, CASE WHEN doc_id % 4 < 2 THEN 're: ' || solution ELSE '' END AS response, CASE doc_id % 4 WHEN 2 THEN 'too long' WHEN 3 THEN 'Result missing' END AS error FROM records""",
    "thinking_budgets": """
        SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 1024 WHEN 2 THEN 8192 WHEN 3 THEN 24576 END AS budget, [NULL, 'low', 'medium', 'high', 'minimal'][c_custkey % 5 + 1] AS effort, 'm_low_' || c_custkey AS base FROM customer""",
}
