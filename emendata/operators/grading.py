"""Grading: folding test codes to verdicts, and the reward of an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed codes of test results, and the constants of the reward.
PASSED, WRONG, TIME_LIMIT, RUN_TIME, COMPILATION, UNKNOWN = 1, -2, -3, -4, -1, -5
EXECUTION_WEIGHT, SIMILARITY_WEIGHT, FAILING_REWARD = 0.1, 1.0, -0.2
MOST_TESTS = 5


def reward(passes: Column, differences: list[Column]) -> Column:
    """A floor for failing edits; else a constant, less how much further the edit is than the canonical one.

    ``differences`` are metric(edit) - metric(canonical) of distances; nulls count as no difference. A
    similarity has to be turned into a distance first.
    """
    total = F.lit(0.0)
    for d in differences:
        total = total - F.coalesce(d, F.lit(0.0))
    return F.when(F.coalesce(passes, F.lit(0)) != 1, F.lit(FAILING_REWARD)).otherwise(EXECUTION_WEIGHT + SIMILARITY_WEIGHT * total)


def fails_every_test(status: Column, run: Column, failures: Column, errors: Column) -> Column:
    """Whether a corrupted program fails all tests that ran; none run counts as failing, a timeout does not."""
    return (status == "fail") & (F.coalesce(run, F.lit(0)) == 0) | (status == "fail") & (failures + errors == run)


def fold_status(status: Column, has_details: Column) -> Column:
    """A pass that comes with failure details is a failure."""
    return F.when((status == "pass") & has_details, F.lit("fail")).otherwise(status)


def longest_tests(tests: Column, most: int = MOST_TESTS, lists: bool = False) -> Column:
    """The tests of longest input (characters, or elements of ``lists``), equal lengths in their order; all if these are few."""
    size = F.size if lists else F.length

    def chosen(ts: Column) -> Column:
        # sizes and places are sorted, as one number each, and the chosen tests fetched by their places
        numbered = F.transform(ts, lambda t, i: F.when(F.size(ts) > most, -size(t["input"])).otherwise(F.lit(0)).cast("long") * F.lit(1 << 32) + i)
        return F.transform(F.slice(F.sort_array(numbered), 1, most), lambda x: F.get(ts, x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))

    # a lambda binds the list, which an expression would make anew wherever it stands
    return F.get(F.transform(F.array(tests), chosen), F.lit(0))


def normalise_tests(text: Column) -> Column:
    """array<struct<input,output,fn_name>> from the three JSON shapes: list, list with plural keys, dict of lists."""
    one = "struct<input:string,output:string,inputs:string,outputs:string,fn_name:string>"
    listed = F.transform(F.from_json(text, f"array<{one}>"), lambda t: F.struct(F.coalesce(t["input"], t["inputs"]).alias("input"), F.coalesce(t["output"], t["outputs"]).alias("output"), t["fn_name"].alias("fn_name")))
    parallel = F.from_json(text, "struct<inputs:array<string>,outputs:array<string>,fn_name:string>")
    zipped = F.transform(F.arrays_zip(parallel["inputs"].alias("input"), parallel["outputs"].alias("output")), lambda t: F.struct(t["input"].alias("input"), t["output"].alias("output"), parallel["fn_name"].alias("fn_name")))
    return F.when(F.startswith(F.trim(text), F.lit("[")), listed).otherwise(zipped)


def parallel_tests(tests: Column) -> Column:
    """The inverse: struct<inputs, outputs>."""
    return F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs"))


def complexity_deltas(df: DataFrame, codes: tuple[str, ...] = ("canonical", "corrupted", "llm")) -> DataFrame:
    """Differences of both complexities for each pair of codes; null where either is unknown."""
    pairs = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :]]
    return df.withColumns({f"{kind}_{a}_{b}": F.col(f"{kind}_{a}") - F.col(f"{kind}_{b}") for kind in ("cyclomatic", "cognitive") for a, b in pairs})
