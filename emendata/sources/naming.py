"""Where runs write: names that follow from their options, as a path or as partition columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solutions_path(model: str, reasoning: bool, questions: int, explicit: bool = False, with_tests: bool = False, shots: int = 0, generic: bool = False, base: str = "data/code_edits") -> str:
    suffix = ("_explicit" if explicit else "") + ("_with_tests" if with_tests else "")
    name = f"results_{model.rsplit('/', 1)[-1]}_{'reasoning' if reasoning else 'non_reasoning'}{suffix}_{questions}.jsonl"
    folder = f"{shots}_shot{suffix}/" if shots > 0 else "zero_shot_generic/" if generic else ""
    return f"{base}/{folder}{name}"


def scenario_path(kind: str, model: str, scenario: str, n: int, temperature: float, chain_of_thought: bool = False, ending: str = "") -> str:
    """``kind`` is cache or output; ``ending`` as _eval or _eval_all."""
    thought = "_cot" if chain_of_thought and kind == "output" else ""
    return f"{kind}/{model}/{scenario}_{n}_{temperature}{thought}{ending}.json"


def results_path(samples: str) -> str:
    folder, _, name = samples.rpartition("/")
    return f"{folder or '.'}/results/{name.rsplit('.', 1)[0]}_eval_results.json"


def write_partitioned(df: DataFrame, path: str, model: str, mode: str, shots: int) -> None:
    """The same names as partition columns, so that readers prune by them."""
    named = df.withColumns({"model": F.lit(model), "mode": F.lit(mode), "num_shots": F.lit(shots)})
    named.write.mode("append").partitionBy("model", "mode", "num_shots").parquet(path)


def register_dataset(spark, entries: dict[str, dict], path: str) -> None:
    """A registry of data sets (name, file, format, columns) as JSON rows."""
    rows = [(name, e.get("file_name"), e.get("formatting"), e.get("columns", {}), bool(e.get("ranking", False))) for name, e in entries.items()]
    spark.createDataFrame(rows, "name string, file_name string, formatting string, columns map<string,string>, ranking boolean").coalesce(1).write.mode("overwrite").json(path)
