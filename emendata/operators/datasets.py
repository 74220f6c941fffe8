"""Training data: corrupted rows, rejection sampling, the best few, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from .relational import best_and_worst, top_per_group

BEST = 3
MOST_CHARACTERS = 2000


def usable_edits(rows: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    return rows.filter(F.col("corrupted_answer").isNotNull() & (F.char_length("corrupted_answer") < most))


def accepted(samples: DataFrame, reward: str = "execution_reward") -> DataFrame:
    """Rejection sampling: only completions that pass."""
    return samples.filter(F.col(reward) == 1)


def within_tokens(rows: DataFrame, tokens: Column, most: int = 8192) -> DataFrame:
    return rows.filter(F.size(tokens) <= most)


def chat_records(rows: DataFrame, problem: str, corrupted: str, answer: str) -> DataFrame:
    message = prompts.fenced_message(F.col(problem), F.col(corrupted), line_break=False)
    return rows.select(prompts.chat_record(message, F.col(answer)).alias("conversations"), F.lit(prompts.SYSTEM_PROMPT).alias("system"))


def best_samples(rows: DataFrame, group: str = "problem_spec", by: str = "levenshtein", position: str = "_pos", n: int = BEST) -> DataFrame:
    """The n closest samples of each problem, equal ones in their order."""
    return top_per_group(rows, group, [F.col(by), F.col(position)], n)


def preference_pairs(rows: DataFrame, group: str = "problem_spec", by: str = "levenshtein", position: str = "_pos") -> DataFrame:
    """(instruction, input, chosen, rejected) of problems whose closest and farthest sample differ but share the corrupted code."""
    pairs = best_and_worst(rows, group, by, position)
    same = pairs.filter((F.col("best.corrupted_answer") == F.col("worst.corrupted_answer")) & (F.col(f"best.{by}") < F.col(f"worst.{by}")))
    message = prompts.fenced_message(F.col(group), F.col("best.corrupted_answer"), line_break=False)
    return same.select(F.lit(prompts.SYSTEM_PROMPT).alias("instruction"), message.alias("input"), F.col("best.completion").alias("chosen"), F.col("worst.completion").alias("rejected"))


def environment_rows(rows: DataFrame) -> DataFrame:
    """(question, answer, info, task) for reinforcement learning, fewest mutations first."""
    info = F.struct(F.lit("edits").alias("dataset_type"), F.col("tests"), F.col("correct_answer").alias("canonical_solution"), F.col("corrupted_answer").alias("corrupted_solution"))
    shaped = usable_edits(rows).select(prompts.fenced_message(F.col("problem_spec"), F.col("corrupted_answer")).alias("question"), F.col("correct_answer").alias("answer"), info.alias("info"), F.lit("minimal-edit").alias("task"), F.coalesce(F.size("applied_mutations"), F.lit(0)).alias("_n"))
    return shaped.orderBy("_n").drop("_n")
