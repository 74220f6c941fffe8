"""The benchmark harness: what to generate anew, repairs of failed samples, grading columns, and result tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import extract, templates
from . import passk
from .relational import take_first, unprocessed

#: Keys that name a row of each scenario.
KEYS = {"codegeneration": ["question_id"], "testoutputprediction": ["question_id", "test_id"], "selfrepair": ["question_id"], "codeexecution": ["id"]}


# The columns of a problem that each scenario's rows show.
COLUMNS = {
    "codegeneration": ["question_title", "question_content", "platform", "question_id", "contest_id", "contest_date", "starter_code", "difficulty"],
    "codeexecution": ["question_id", "contest_id", "contest_date", "difficulty", "function_name", "code", "input", "output", "id", "problem_id", "numsteps"],
    "testoutputprediction": ["question_title", "question_content", "question_id", "contest_id", "contest_date", "difficulty", "test_id", "function_name", "starter_code"],
}
# The models of each style.
MODELS = {
    "Qwen3Instruct": "Qwen/Qwen3-4B-Instruct-2507",
    "GenericBase": "meta-llama/Meta-Llama-3-8B meta-llama/Meta-Llama-3-70B meta-llama/Llama-3.1-8B meta-llama/Llama-3.1-70B meta-llama/Llama-3.1-405B-FP8 deepseek-ai/deepseek-coder-33b-base deepseek-ai/deepseek-coder-6.7b-base deepseek-ai/deepseek-coder-1.3b-base bigcode/starcoder2-3b bigcode/starcoder2-7b bigcode/starcoder2-15b google/codegemma-7b google/codegemma-2b google/gemma-7b google/gemma-2b",
    "LLaMa3": "meta-llama/Meta-Llama-3-8B-Instruct meta-llama/Meta-Llama-3-70B-Instruct meta-llama/Llama-3.1-8B-Instruct meta-llama/Llama-3.1-70B-Instruct meta-llama/Llama-3.1-405B-Instruct-FP8 meta-llama/Llama-3.3-70B-Instruct",
    "DeepSeekCodeInstruct": "deepseek-ai/deepseek-coder-33b-instruct deepseek-ai/deepseek-coder-6.7b-instruct deepseek-ai/deepseek-coder-1.3b-instruct",
    "DeepSeekAPI": "01-ai/Yi-Coder-9B-Chat deepseek-r1-preview deepseek-r1-lite-preview deepseek-chat deepseek-coder",
    "OpenAIChat": "gpt-3.5-turbo-0301 gpt-3.5-turbo-0125 gpt-4-0613 gpt-4-1106-preview gpt-4-turbo-2024-04-09 gpt-4o-2024-05-13 gpt-4o-2024-08-06 gpt-4o-mini-2024-07-18",
    "OpenAIReasonPreview": "o1-preview-2024-09-12 o1-mini-2024-09-12",
    "OpenAIReason": "o1-2024-12-17__low o1-2024-12-17__medium o1-2024-12-17__high o3-mini-2025-01-31__low o3-mini-2025-01-31__medium o3-mini-2025-01-31__high o4-mini__high o4-mini__medium o4-mini__low o3__high",
    "Claude": "claude-instant-1 claude-2",
    "Claude3": "claude-3-opus-20240229 claude-3-sonnet-20240229 claude-3-5-sonnet-20240620 claude-3-5-sonnet-20241022 claude-3-haiku-20240307 claude-sonnet-4-20250514_nothink",
    "Claude3Thinking": "claude-3-7-sonnet-20250219 claude-sonnet-4-20250514 claude-opus-4-20250514 claude-opus-4-20250514_nothink",
    "Gemini": "gemini-1.5-pro-002 gemini-1.5-flash-002",
    "GeminiThinking": "gemini-2.5-pro gemini-2.5-pro-preview-06-05 gemini-2.5-pro-preview-05-06 gemini-2.5-flash-preview-04-17 gemini-2.5-flash-preview-05-20",
    "MistralWeb": "mistral-large-latest open-mixtral-8x22b open-mixtral-8x7b codestral-latest",
    "QwQ": "Qwen/QwQ-32B-Preview Qwen/QwQ-32B Qwen/QwQ-Max-Preview",
    "CodeQwenInstruct": "Qwen/Qwen2-72B-Instruct Qwen/Qwen2.5-7B-Instruct Qwen/Qwen2.5-32B-Instruct Qwen/Qwen2.5-72B-Instruct Qwen/Qwen2.5-Coder-7B-Instruct Qwen/Qwen2.5-Coder-32B-Instruct Qwen/Qwen3-235B-A22B azerogpt Kimi-k1.6-IOI-high Kimi-k1.6-IOI",
    "DeepSeekR1": "accounts/fireworks/models/deepseek-r1 deepseek-reasoner deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B deepseek-ai/DeepSeek-R1-Distill-Qwen-7B deepseek-ai/DeepSeek-R1-Distill-Qwen-14B deepseek-ai/DeepSeek-R1-Distill-Qwen-32B deepseek-ai/DeepSeek-R1-Distill-Llama-8B deepseek-ai/DeepSeek-R1-Distill-Llama-70B MetaStone-L1-7B nvidia/Llama-3_1-Nemotron-Ultra-253B-v1 nvidia/Llama-3_1-Nemotron-Nano-8B-v1 agentica-org/DeepCoder-14B-Preview",
    "CohereCommand": "command-r-plus-08-2024 command-r-08-2024 command-r7b-12-2024 command-a-03-2025",
    "TogetherAI": "Qwen/Qwen2.5-72B-Instruct-Turbo",
    "Grok": "grok-3-mini-beta grok-3-mini-beta_high",
}
REGISTRY = tuple((model, style) for style, models in MODELS.items() for model in models.split())


def usable_rows(old: DataFrame) -> DataFrame:
    """Rows of an earlier run with at least one output that is not empty."""
    return old.filter(F.coalesce(F.exists("output_list", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(False)))


def resume(benchmark: DataFrame, old: DataFrame, scenario: str) -> tuple[DataFrame, DataFrame]:
    """(usable old rows, benchmark rows that they do not cover), by the scenario's whole key."""
    kept = usable_rows(old)
    return kept, unprocessed(benchmark, kept, KEYS[scenario])


def extracted(outputs: DataFrame, scenario: str, name: str = "output_list", style: str | None = None, steps: bool = False) -> DataFrame:
    """The answer in each output: a block, an assert line, or what an execution is said to give."""

    def pick(text: Column) -> Column:
        if scenario == "codeexecution":
            return extract.execution_answer(text, steps)
        return extract.assert_line(text) if scenario == "testoutputprediction" else extract.between_last_fences(text, style)

    column = "pred_list" if scenario in ("codeexecution", "testoutputprediction") else "code_list"
    return outputs.withColumn(column, F.transform(name, lambda x: pick(x)))


def combined(old: DataFrame, new: DataFrame, scenario: str) -> DataFrame:
    """Old and new rows in the order of the key; an id such as sample_12 sorts by its number."""
    rows = old.unionByName(new, allowMissingColumns=True)
    order: list[Column] = [F.split("id", "_")[1].cast("int"), F.col("id")] if scenario == "codeexecution" else [F.col(k) for k in KEYS[scenario]]
    return rows.orderBy(*order)


def repair_rows(benchmark: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(question_id, position, style, prompt): a repair prompt of each style for each sample, empty where it passed.

    Samples, verdicts and metadata are parallel lists. A problem must have exactly one evaluated row.
    """
    samples = F.arrays_zip("code_list", "graded_list", "metadata").alias("samples")
    found = evaluated.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.any_value(samples).alias("samples"))
    joined = benchmark.select("question_id", "question_content").join(found, "question_id", "left")
    only = F.when(F.col("n") == 1, F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("not one evaluated row: "), F.col("question_id").cast("string"))))
    rows = joined.select("question_id", "question_content", F.posexplode(only).alias("position", "s"))
    flat = rows.select("question_id", "question_content", "position", F.col("s.code_list").alias("code"), F.col("s.graded_list").alias("passed"), "s.metadata")
    return templates.repair_prompts(flat).select("question_id", "position", "style", "prompt")


def inserted(problems: DataFrame, outputs: DataFrame, scenario: str, graded: bool = False) -> DataFrame:
    """The rows that a run writes: the scenario's columns of a problem, its outputs, and verdicts with pass_at_1 if ``graded``.

    ``outputs`` has the scenario's key, output_list, what was taken from it, and graded_list; other columns of it stay.
    """
    rows = problems.select(*COLUMNS[scenario]).join(outputs, KEYS[scenario])
    listed = F.date_format("contest_date", "yyyy-MM-dd'T'HH:mm:ss")
    shown = rows.withColumn("contest_date", listed) if "contest_date" in rows.columns else rows
    return with_scores(shown) if graded else shown.drop("graded_list")


def with_scores(rows: DataFrame) -> DataFrame:
    """pass_at_1 of each row from graded_list."""
    return rows.withColumn("pass_at_1", passk.share_passed(F.col("graded_list")))


def report(evaluated: DataFrame, ks: tuple[int, ...] = passk.REPORTED_K) -> DataFrame:
    """(difficulty or null, k, pass_at_k, problems) from graded rows."""
    counts = evaluated.select("difficulty", F.size("graded_list").alias("n"), F.size(F.filter("graded_list", lambda g: g)).alias("c"))
    return passk.by_slice(counts, "difficulty", ks)


#: Keys of the sample that bounds the ranges of a scan: a range holds about a thousandth of the rows.
SPLITTERS = 1024


def first_passing(rows: DataFrame, verdict: Column, order: list[str], n: int, splitters: int = SPLITTERS) -> DataFrame:
    """The first n rows in ``order`` that pass: ranges of the order are judged, twice as many each time, until n rows pass.

    ``order`` is a key, nulls first. A sample of keys, those of least hash, bounds the ranges; neither is the table
    sorted, nor is the verdict made beyond the last range that was needed. Each step reads its own range.
    """
    key = F.struct(*order)
    if n <= 0:
        return rows.limit(0)
    sample = rows.select(*order).orderBy(F.xxhash64(*order)).limit(splitters)  # of bounded size
    bounds = sample.distinct().orderBy(*order).collect()
    kinds = {c: rows.schema[c].dataType for c in order}
    found, low, step = None, 0, 1
    while True:
        part = rows
        head = F.col(order[0])  # told apart first, as scans can leave out what lies beyond a column's bounds
        if low:
            begin = bounds[low - 1]
            part = part.filter((key > _key(begin, order, kinds)) & (F.lit(True) if begin[0] is None else head >= F.lit(begin[0])))
        if low + step <= len(bounds):
            end = bounds[low + step - 1]
            part = part.filter((key <= _key(end, order, kinds)) & (head.isNull() if end[0] is None else head.isNull() | (head <= F.lit(end[0]))))
        passed = take_first(part.filter(verdict), order, n)
        if low + step > len(bounds):
            last, have = True, 0
        else:
            passed = passed.persist(StorageLevel.DISK_ONLY)  # at most n rows, judged once
            last, have = False, passed.count() + (found.count() if found is not None else 0)
        found = passed if found is None else found.unionByName(passed)
        if last or have >= n:
            return take_first(found, order, n)
        low, step = low + step, step * 2


def _key(bound: Row, order: list[str], kinds: dict[str, DataType]) -> Column:
    """A key as a constant, of the columns' own types."""
    return F.struct(*[F.lit(bound[c]).cast(kinds[c]).alias(c) for c in order])


def registry(spark: SparkSession) -> DataFrame:
    """(model_name, model_style) of the known models."""
    return spark.createDataFrame(list(REGISTRY), "model_name string, model_style string")


def with_style(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with their model's style, the least of several; unknown models keep a null style. The registry is a small dimension table."""
    return requests.join(registry.groupBy("model_name").agg(F.min("model_style").alias("model_style")), "model_name", "left")
