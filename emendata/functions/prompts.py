"""Prompt assembly as string expressions. The texts are fixed values: they must equal those that models saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# System prompts.
SYSTEM_PROMPT = """You are a Python Expert specializing in code analysis and debugging. When provided with a problem statement, your task is to fix the code while preserving as much of the original code as possible.
Do not change the function signature, default arguments, or docstring. Use the docstring to understand the requirements of the function.
IMPORTANT: Try to preserve the original code and the logic of the original code as much as possible."""
GENERIC_SYSTEM_PROMPT = """You are a Python Expert specializing in code analysis and debugging. When provided with a problem statement, your task is to fix the code.
Do not change the function signature, default arguments, or docstring. Use the docstring to understand the requirements of the function."""
FEW_SHOT_SYSTEM_PROMPT = """You are a Python Expert specializing in code analysis and debugging. When provided with a problem statement and example solutions, your task is to fix the code.

You will be shown several examples of code problems and their solutions. For each example, carefully analyze:
1. What issues were identified in the original code
2. How the solution fixed those issues
3. The style and structure of the solution

When fixing the target code:
- Follow the same debugging and problem-solving approach shown in the examples
- Match the coding style, structure, and patterns demonstrated
- Try to preserve the original code and the logic of the original code as much as possible

The examples are carefully chosen to guide you in fixing similar types of issues. Use them as a reference for how to approach and structure your solution."""
CORRUPTION_SYSTEM_PROMPT = """
You are a Python Expert specializing in code analysis and debugging. You will be provided with a problem statement, a correct solution, and the test cases. Your task is to create a subtly incorrect version of the solution such that the test cases fail:

Requirements for the corrupted solution:
1. Introduce exactly one logical bug that makes the solution incorrect
2. The bug should be subtle and not immediately obvious from reading the code
3. Prefer bugs that could realistically be made by a programmer (e.g., off-by-one errors, incorrect operators, swapped variables)
4. Changes must be minimal - modify as few lines of code as possible
5. Maintain the original function signature, default arguments, and overall structure
6. Preserve all existing comments and docstrings
7. The bug should not cause runtime errors or exceptions
8. Do not leave any comments or hints in the code about where the bug is that would help the user identify the bug

Guidelines for selecting bugs:
- Focus on logic/algorithmic errors rather than syntax errors
- Consider edge cases where the bug might manifest
- The bug should be discoverable through testing
- Avoid obvious mistakes like incorrect variable names or syntax errors
- Try to make the bug as subtle as possible
- Do not make changes to the error message or print statements
- When someone is provided with your corruption, they should not need to have access to the test cases to identify the bug

First, think step by step and come up with an approach to generate the corrupted solution.
Then, output the corrupted solution in a code block, maintaining exact formatting and whitespace of the original code except for your specific changes. Remember to try to limit the number of changes you make to the code that still causes the test cases to fail."""
# The pieces of the user message.
TASK = "I am trying to implement a function with the following specifications:\n"
SO_FAR = "The function I have written so far is:\n"
TESTS = "The test cases are:\n"
ASK = "What is wrong? Fix and complete my function."
ASK_MINIMAL = "What is wrong? Fix and complete my function but keep as much of the original code as possible."
WRAP = "Wrap your response in ```python and ```"
EXAMPLES = "\n\nHere are some examples to guide your approach:\n"


def full_solution(prompt: Column, body: Column) -> Column:
    return F.concat(prompt, F.lit("\n"), body)


def corruption_request(problem: Column, solution: Column, tests: Column) -> Column:
    """The request to break a solution; CORRUPTION_SYSTEM_PROMPT goes with it."""
    return F.concat(F.lit("Problem Statement:\n"), problem, F.lit("\n\nCorrect Solution:\n"), solution, F.lit("\n\nTest Code:\n"), tests)


def user_message(problem: Column, corrupted: Column, minimal: bool = False, tests: Column | None = None) -> Column:
    """The request to fix a function; the tests' part only where there is one."""
    shown = F.lit("") if tests is None else F.when(F.coalesce(tests, F.lit("")) != "", F.concat(F.lit(TESTS), tests, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(TASK), problem, F.lit(".\n\n" + SO_FAR), corrupted, F.lit(" \n\n"), shown, F.lit((ASK_MINIMAL if minimal else ASK) + WRAP))


def fenced_message(problem: Column, corrupted: Column, line_break: bool = True) -> Column:
    """The request with the code in a fence; the two training sets differ in a line break before its end."""
    if line_break:
        return F.concat(F.lit(TASK), problem, F.lit(".\n\n" + SO_FAR + "```python\n"), corrupted, F.lit("\n```\n" + WRAP))
    return F.concat(F.lit(TASK), problem, F.lit(".\n\n" + SO_FAR + "```python\n"), corrupted, F.lit(" ```\n\n" + WRAP))


def shot(number: Column, problem: Column, corrupted: Column, canonical: Column, tests: Column | None = None) -> Column:
    """One worked example."""
    shown = F.lit("") if tests is None else F.coalesce(F.concat(F.lit("\n\n**The test cases are:**\n"), tests), F.lit(""))
    return F.concat(F.lit("\n## Example "), number.cast("string"), F.lit("\n\n**Problem Statement:**\n"), problem, F.lit("\n\n**Problematic Code:**\n```python\n"), corrupted, F.lit("\n```"), shown, F.lit("\n\n**Fixed Solution:**\n```python\n"), canonical, F.lit("\n```\n"))


def with_shots(questions: DataFrame, n: int, order: str, problem: str, corrupted: str, canonical: str) -> DataFrame:
    """The questions after the first n, each with ``shots``: the first n as worked examples in one string.

    The examples are n rows whatever the table's size, so they are broadcast.
    """
    first = questions.orderBy(order).limit(n)
    numbered = first.select(order, F.struct(F.col(order), F.col(problem), F.col(corrupted), F.col(canonical)).alias("q"))
    rows = numbered.agg(F.array_sort(F.collect_list("q")).alias("q"))
    texts = F.transform("q", lambda q, i: shot(i + 1, q[problem], q[corrupted], q[canonical]))
    shots = rows.select(F.array_join(texts, "\n").alias("shots"), F.array_max(F.transform("q", lambda q: q[order])).alias("_last"))
    return questions.join(F.broadcast(shots), F.col(order) > F.col("_last")).drop("_last")


def system_prompt(shots: Column, generic: bool = False) -> Column:
    plain = F.lit(GENERIC_SYSTEM_PROMPT if generic else SYSTEM_PROMPT)
    return F.when(F.coalesce(shots, F.lit("")) == "", plain).otherwise(F.concat(F.lit(FEW_SHOT_SYSTEM_PROMPT + EXAMPLES), shots))


def chat_record(human: Column, answer: Column) -> Column:
    """A list of turns {from, content}."""
    return F.array(F.struct(F.lit("user").alias("from"), human.alias("content")), F.struct(F.lit("assistant").alias("from"), answer.alias("content")))


def thinking_suffix(prompt: Column, thinking: bool) -> Column:
    return F.concat(prompt, F.lit(" \\think" if thinking else " \\nothink"))


def is_reasoning_model(name: Column, marks: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("|".join(marks))


def clean_problem(text: Column, dropped: tuple[str, ...]) -> Column:
    """Without some fixed sentences and without white space at the ends."""
    for sentence in dropped:
        text = F.replace(text, F.lit(sentence), F.lit(""))
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def strip_fence(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"^\s*```[a-z]*\n?", ""), r"\n?```\s*\z", ""), r"^\s+|\s+\z", "")
