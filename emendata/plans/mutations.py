"""Queries about program mutation: one program for each mutator and draw, with the row's own names, and what it must become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mutate
from .tables import table

#: (mutator, draw, body before, body after); None: the mutator does not apply. NAME stands for a name of the row.
CASES = (
    ("comparison_operators", 0, "return NAME < 3", "return NAME <= 3"),
    ("comparison_operators", 0, "return NAME in a or NAME <= 3", "return NAME in a or NAME < 3"),
    ("comparison_operators", 0, "return 1 > NAME >= 3", "return 1 >= NAME >= 3"),
    ("comparison_operators", 0, "return NAME >= 3", "return NAME > 3"),
    ("comparison_operators", 0, "return NAME == a", "return NAME != a"),
    ("comparison_operators", 0, "return NAME != a", "return NAME == a"),
    ("comparison_operators", 0, "return NAME is a", None),
    ("comparison_operators", 0, "def f(a=3 < 4):\n    return NAME < a", None),  # the arguments must stay
    ("range_bounds", 0, "return range(NAME)", "return range(NAME - 1)"),
    ("range_bounds", 1, "return range(NAME)", "return range(NAME + 1)"),
    ("range_bounds", 0, "return range(a, NAME)", "return range(a, NAME - 1)"),
    ("range_bounds", 1, "return range(a, NAME)", "return range(a + 1, NAME)"),
    ("range_bounds", 0, "return range(a, NAME, 2)", None),
    ("sort_order", 0, "return sorted(NAME, reverse=True)", "return sorted(NAME, reverse=False)"),
    ("sort_order", 0, "return NAME.sort_values(ascending=False)", "return NAME.sort_values(ascending=True)"),
    ("sort_order", 0, "return sorted(NAME)", "return sorted(NAME, reverse=False)"),
    ("sort_order", 0, "NAME.sort()", "NAME.sort(ascending=False)"),
    ("accumulator_init", 0, "NAME_total = 0", "NAME_total = 1"),
    ("accumulator_init", 0, "Count_NAME = []", "Count_NAME = [0]"),
    ("accumulator_init", 0, "NAME_sum = a = 0", None),
    ("accumulator_init", 0, "NAME = 0", None),
    ("arithmetic_operators", 0, "return NAME + a", "return NAME - a"),
    ("arithmetic_operators", 0, "return NAME - a", "return NAME + a"),
    ("arithmetic_operators", 0, "return NAME * a", "return NAME // a"),
    ("arithmetic_operators", 0, "return NAME // a", "return NAME / a"),
    ("arithmetic_operators", 0, "return NAME % a", None),
    ("edge_case_guards", 0, "if not NAME:\n        return a", "if NAME:\n        return a"),
    ("edge_case_guards", 0, "if NAME == 0:\n        return a", "if NAME == 1:\n        return a"),
    ("edge_case_guards", 0, "if len(NAME) > 1:\n        return a", "if len(NAME) > 0:\n        return a"),
    ("edge_case_guards", 0, "if NAME > 2:\n        return a", None),
    ("list_indexing", 0, "return NAME[0]", "return NAME[1]"),
    ("list_indexing", 0, "return NAME[a + 1]", "return NAME[a]"),
    ("list_indexing", 0, "return NAME[a - 1]", "return NAME[a]"),
    ("list_indexing", 0, "return NAME[a]", None),
    ("list_indexing", 0, "return NAME[-1]", None),
    ("function_call_name", 0, "return mean(NAME)", "return median(NAME)"),
    ("function_call_name", 0, "return NAME.max()", "return NAME.min()"),
    ("function_call_name", 0, "return sum(NAME)", "return len(NAME)"),
    ("remove_copy_calls", 0, "return NAME.copy().b", "return NAME.b"),
    ("remove_copy_calls", 0, "return NAME.copy(deep=True)", None),
    ("boolean_constants", 0, "return NAME(True)", "return NAME(False)"),
    ("boolean_constants", 0, "return NAME(False)", "return NAME(True)"),
    ("numeric_constants", 0, "return NAME + 7", "return NAME + 8"),
    ("numeric_constants", 1, "return NAME + 7", "return NAME + 6"),
    ("numeric_constants", 0, "return NAME + 0.5", "return NAME + 0.6"),
    ("numeric_constants", 1, "return NAME + 0.5", "return NAME + 0.4"),
    ("numeric_constants", 0, "return NAME + 1", None),
    ("slice_bounds", 0, "return NAME[3:]", "return NAME[4:]"),
    ("slice_bounds", 1, "return NAME[3:]", "return NAME[5:]"),
    ("slice_bounds", 0, "return NAME[a:3]", "return NAME[a:4]"),
    ("slice_bounds", 0, "return NAME[:-1]", None),
    ("conditional_inversion", 0, "return NAME and a", "return not NAME and a"),
    ("conditional_inversion", 0, "return not NAME or a", "return not NAME or not a"),
    ("conditional_inversion", 0, "return not NAME or not a", None),
    ("range_step", 0, "return range(NAME)", "return range(NAME, 2)"),
    ("range_step", 0, "return range(a, NAME)", "return range(a, NAME, 2)"),
    ("range_step", 0, "return range(a, NAME, 3)", "return range(a, NAME, 4)"),
    ("range_step", 0, "return range(NAME, 0, -1)", None),
    ("min_max_usage", 0, "return min(NAME)", "return max(NAME)"),
    ("min_max_usage", 0, "return NAME.max()", "return NAME.min()"),
    ("abs_usage", 0, "return abs(NAME - a) * 2", "return (NAME - a) * 2"),
    ("abs_usage", 0, "return NAME - a", "return abs(NAME - a)"),
    ("abs_usage", 0, "NAME(a + 1)\n    return abs(a)", "NAME(a + 1)\n    return a"),
    ("append_extend", 0, "NAME.append(a)", "NAME.extend([a])"),
    ("append_extend", 0, "NAME.extend([a, 1])", "NAME.append(a)"),
    ("append_extend", 0, "NAME.extend(a)", None),
    ("enumerate_start", 0, "return enumerate(NAME)", "return enumerate(NAME, start=1)"),
    ("enumerate_start", 0, "return enumerate(NAME, start=1)", "return enumerate(NAME, start=0)"),
    ("enumerate_start", 0, "return enumerate(NAME, start=5)", "return enumerate(NAME, start=1)"),
    ("break_to_continue", 0, "for NAME in a:\n        if NAME:\n            break\n        break", "for NAME in a:\n        if NAME:\n            continue\n        break"),
    ("dict_get_default", 0, "return NAME.get(a)", "return NAME.get(a, 1)"),
    ("dict_get_default", 0, "return NAME.get(a, 1)", "return NAME.get(a, 0)"),
    ("dict_get_default", 0, "return NAME.get(a, 7)", "return NAME.get(a, 1)"),
    ("dict_get_default", 0, "return NAME.get(a, 'x')", None),
    ("string_lower_upper", 0, "return NAME.lower()", "return NAME.upper()"),
    ("string_lower_upper", 0, "return NAME.upper()", "return NAME.lower()"),
    ("strip_variant", 0, "return NAME.strip()", "return NAME.rstrip()"),
    ("strip_variant", 0, "return NAME.rstrip()", "return NAME.strip()"),
    ("strip_variant", 0, "return NAME.lstrip()", "return NAME.strip()"),
    ("join_separator", 0, "return ''.join(NAME)", "return ' '.join(NAME)"),
    ("join_separator", 0, "return ' '.join(NAME)", "return ''.join(NAME)"),
    ("join_separator", 0, "return '-'.join(NAME)", "return ','.join(NAME)"),
    ("sorted_toggle_key_len", 0, "return sorted(NAME)", "return sorted(NAME, key=len)"),
    ("sorted_toggle_key_len", 0, "NAME.sort(key=a, reverse=True)", "NAME.sort(reverse=True)"),
    ("set_vs_list_cast", 0, "return set(NAME)", "return list(NAME)"),
    ("set_vs_list_cast", 0, "return list(NAME)", "return set(NAME)"),
    ("round_to_int", 0, "return round(NAME)", "return int(NAME)"),
    ("round_to_int", 0, "return int(NAME)", "return round(NAME)"),
    ("comp_filter_remove", 0, "return [x for x in NAME if x if a]", "return [x for x in NAME if a]"),
    ("comp_filter_remove", 0, "return {x: 1 for y in NAME for x in y if x}", "return {x: 1 for y in NAME for x in y}"),
    ("comp_filter_remove", 0, "return any((x for x in NAME if x))", None),
    ("find_vs_index", 0, "return NAME.find(a)", "return NAME.index(a)"),
    ("find_vs_index", 0, "return NAME.index(a)", "return NAME.find(a)"),
    ("any_all_swap", 0, "return any(NAME)", "return all(NAME)"),
    ("any_all_swap", 0, "return all(NAME)", "return any(NAME)"),
    ("zip_arg_order", 0, "return zip(NAME, a, 3)", "return zip(a, NAME, 3)"),
    ("zip_arg_order", 0, "return zip(NAME)", None),
    ("len_range_endpoint", 0, "return range(len(NAME))", "return range(len(NAME) + 1)"),
    ("len_range_endpoint", 1, "return range(len(NAME))", "return range(len(NAME) - 1)"),
    ("len_range_endpoint", 0, "return range(1, len(NAME))", None),
    ("negative_indexing_shift", 0, "return NAME[-1]", "return NAME[-2]"),
    ("negative_indexing_shift", 0, "return NAME[-3:]", "return NAME[-4:]"),
    ("negative_indexing_shift", 0, "return NAME[1:-2]", "return NAME[1:-3]"),
    ("dict_items_variant", 0, "return NAME.items()", "return NAME.keys()"),
    ("dict_items_variant", 1, "return NAME.items()", "return NAME.values()"),
    ("dict_items_variant", 0, "return NAME.keys()", "return NAME.items()"),
    ("dict_items_variant", 1, "return NAME.values()", "return NAME.keys()"),
    ("none_equality_operator", 0, "return NAME == None", "return NAME is None"),
    ("none_equality_operator", 0, "return NAME is not None", "return NAME != None"),
    ("none_equality_operator", 0, "return NAME < a", None),
)
#: (family, body before, body after, mutations): programs on which the order of the mutations does not matter.
CHAINS = (
    ("base", "return NAME < a", "return NAME <= a", "comparison_operators"),
    ("base", "return NAME(True) < a", "return NAME(False) <= a", "boolean_constants,comparison_operators"),
    ("base", "return NAME.copy()[0]", "return NAME[1]", "list_indexing,remove_copy_calls"),
    ("base", "return NAME", None, ""),
    ("extra", "return any(zip(NAME.lower(), a.find('x')))", "return all(zip(a.index('x'), NAME.upper()))", "any_all_swap,find_vs_index,string_lower_upper,zip_arg_order"),
    ("extra", "return NAME < a", None, ""),
    ("both", "return NAME.get(a) if a else round(NAME.strip())", "return NAME.get(a, 1) if a else int(NAME.rstrip())", "dict_get_default,round_to_int,strip_variant"),
    ("both", "return NAME < any(a)", "return NAME <= all(a)", "any_all_swap,comparison_operators"),
)
HEAD = "def f(a, NAME=None):\n    "


def _program(body: str | None) -> str | None:
    return body if body is None or body.startswith("def ") else HEAD + body


def _over(spark: SparkSession, sf_dir: str, rows: list[tuple], ddl: str) -> DataFrame:
    """One of the rows for each document, by doc_id."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {ddl}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).cast("int").alias("case_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("own"))
    return docs.join(F.broadcast(cases), "case_id")


def mutation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutator by itself."""
    rows = _over(spark, sf_dir, [(m, d, _program(b)) for m, d, b, _ in CASES], "mutator string, draw int, program string")
    ready = rows.select("doc_id", "mutator", "draw", F.replace("program", F.lit("NAME"), F.col("own")).alias("program"))
    return mutate.mutated_by(ready, "program", "mutator", "draw").select("doc_id", "mutator", "code")


def _chain(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Code and mutations, by name, of a family's chains."""
    rows = _over(spark, sf_dir, [(_program(before),) for f, before, _, _ in CHAINS if f == family], "program string")
    ready = rows.select("doc_id", "own", F.replace("program", F.lit("NAME"), F.col("own")).alias("program"))
    made = mutate.corrupt(ready, "program", "own", family=family)
    return made.select("doc_id", "mutated.code", F.array_join(F.array_sort("mutated.mutations"), ",").alias("mutations"), F.col("mutated.error").isNotNull().alias("failed"))


def corrupt_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, "base")


def corrupt_code_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, "extra")


def corrupt_code_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, "both")


def literal(value: str | float | None) -> str:
    """An SQL literal; line breaks as they are."""
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A table of literals, with the row's number as case_id."""
    body = ", ".join("(" + ", ".join(literal(v) for v in (i, *r)) + ")" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS cases(case_id, {names})"


def _chain_sql(family: str) -> str:
    rows = [(_program(after), mutations) for f, _, after, mutations in CHAINS if f == family]
    return f"SELECT doc_id, replace(code, 'NAME', 'n' || doc_id) AS code, mutations, code IS NULL AS failed FROM documents JOIN {values(rows, 'code, mutations')} ON doc_id % {len(rows)} = case_id"


QUERIES = {f.__name__: f for f in (mutation_rules, corrupt_code, corrupt_code_extra, corrupt_code_both)}
ORACLES = {
    "mutation_rules": f"SELECT doc_id, mutator, replace(code, 'NAME', 'n' || doc_id) AS code FROM documents JOIN {values([(m, _program(after)) for m, _, _, after in CASES], 'mutator, code')} ON doc_id % {len(CASES)} = case_id",
    "corrupt_code": _chain_sql("base"),
    "corrupt_code_extra": _chain_sql("extra"),
    "corrupt_code_both": _chain_sql("both"),
}
