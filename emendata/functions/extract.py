"""Text extraction as expressions: they stay in generated code and need no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of fenced blocks, thought marks and answers.
CLOSED_FENCE = r"(?im)^```(?:python)?\s*\n([\s\S]*?)\n```"
OPEN_FENCE = r"(?im)^```(?:python)?\s*\n([\s\S]*)\z"
ANY_FENCE = r"```(?:\w+)?\n([\s\S]*?)```"
DOCSTRING = r"(def\s+[^:]+:\s*)(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')\s*\n"
THOUGHT_ENDS = ("</think>", "</thought>")
ANSWER, ANSWER_END = "[ANSWER]", "[/ANSWER]"
TRUNCATED = "...(truncated) ..."
THINKING = {"low": 1024, "medium": 8192, "high": 24576}


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python's strip()."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def after_thought(text: Column) -> Column:
    """What follows the last mark that ends a thought."""
    for mark in THOUGHT_ENDS:
        text = F.substring_index(text, mark, -1)
    return text


def longest_block(text: Column) -> Column:
    """The longest closed block (the first of equal ones), else what an open fence begins, else empty."""
    body = after_thought(strip(text))
    blocks = F.transform(F.regexp_extract_all(body, F.lit(CLOSED_FENCE), F.lit(1)), strip)
    longest = F.reduce(blocks, F.lit(None).cast("string"), lambda best, b: F.when(best.isNull() | (F.length(b) > F.length(best)), b).otherwise(best))
    return F.when(F.size(blocks) > 0, longest).otherwise(strip(F.regexp_extract(body, OPEN_FENCE, 1)))


def first_two_fences(text: Column, tag: str = "```") -> Column:
    """What the first two lines with a mark enclose, else nothing."""
    lines = F.split(text, "\n", -1)
    marks = _marked(lines, tag)
    return F.when(F.size(marks) >= 2, _between(lines, F.get(marks, F.lit(0)), F.get(marks, F.lit(1)))).otherwise(F.lit(""))


def last_block(text: Column) -> Column:
    """The last closed block of any language, null without one."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(ANY_FENCE), F.lit(1)), F.lit(-1)))


def block_after_thought(text: Column) -> Column:
    return last_block(F.substring_index(text, THOUGHT_ENDS[0], -1))


def _marked(lines: Column, mark: str, any_case: bool = False) -> Column:
    """Numbers of the lines that hold a mark."""
    shown = (lambda x: F.lower(x)) if any_case else (lambda x: x)
    return F.filter(F.transform(lines, lambda x, i: F.when(F.contains(shown(x), F.lit(mark)), i)), lambda i: i.isNotNull())


def _between(lines: Column, first: Column, last: Column) -> Column:
    """The lines between two of them, up to the end where the last is null; empty without a first."""
    stop = F.coalesce(last, F.size(lines))
    return F.when(first.isNull(), F.lit("")).otherwise(F.array_join(F.slice(lines, first + 2, stop - first - 1), "\n"))


def between_last_fences(text: Column, style: str | None = None) -> Column:
    """The last python block, to the end where it is not closed; else what the last two fence lines enclose, or nothing.

    Style "base" gives all of the text, and "llama" what the last two lines with PYTHON] enclose where there are two.
    """
    if style == "base":
        return strip(text)
    lines = F.split(text, "\n", -1)
    fences = _marked(lines, "```")
    if style == "llama":
        tags = _marked(lines, "PYTHON]")
        marks = F.when(F.size(tags) >= 2, tags).otherwise(fences)
        return _between(lines, F.try_element_at(marks, F.lit(-2)), F.try_element_at(marks, F.lit(-1)))
    begin = F.try_element_at(_marked(lines, "```python", any_case=True), F.lit(-1))
    closed = F.try_element_at(F.filter(fences, lambda i: i > begin), F.lit(1))
    return F.when(begin.isNotNull(), _between(lines, begin, closed)).otherwise(_between(lines, F.try_element_at(fences, F.lit(-2)), F.try_element_at(fences, F.lit(-1))))


def assert_line(text: Column) -> Column:
    """The last line that begins with assert; without one the first python block, else what the first two fence lines enclose."""
    lines = F.split(text, "\n", -1)
    asserts = F.filter(lines, lambda line: F.startswith(line, F.lit("assert")))
    fences = _marked(lines, "```")
    begin = F.try_element_at(F.array_sort(F.concat(_marked(lines, "```python"), _marked(lines, "```Python"))), F.lit(1))
    first = F.coalesce(begin, F.try_element_at(fences, F.lit(1)))
    last = F.try_element_at(F.filter(fences, lambda i: i > first), F.lit(1))
    block = F.when(last.isNull(), F.lit("")).otherwise(_between(lines, first, last))
    return F.coalesce(F.try_element_at(asserts, F.lit(-1)), block)


def execution_answer(text: Column, steps: bool = False) -> Column:
    """What follows the first ==, up to the end mark or else the line's end; with ``steps`` within the answer part only."""
    inside = F.when(F.contains(text, F.lit(ANSWER)), strip(F.get(F.split(text, r"\[ANSWER\]", -1), F.lit(1)))).otherwise(text) if steps else text
    right = F.when(F.contains(inside, F.lit("==")), strip(F.get(F.split(inside, "==", -1), F.lit(1)))).otherwise(inside)
    ended = F.when(F.contains(right, F.lit(ANSWER_END)), F.get(F.split(right, r"\[/ANSWER\]", -1), F.lit(0))).otherwise(F.get(F.split(right, "\n", -1), F.lit(0)))
    return strip(ended)


def truncate_middle(text: Column, length: int = 300) -> Column:
    """Head, mark and tail of texts that are longer than ``length``."""
    half = length // 2
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(TRUNCATED), F.right(text, F.lit(half))))


def truncate(text: Column, length: int = 1000) -> Column:
    return F.left(text, F.lit(length))


def docstring(code: Column) -> Column:
    return strip(F.regexp_extract(code, DOCSTRING, 2))


def _effort(minimal: bool) -> str:
    return f"_({'minimal|' if minimal else ''}low|medium|high)$"


def effort_suffix(model: Column, minimal: bool = False) -> Column:
    """low, medium or high (or minimal) where a model's name ends so, else null."""
    found = F.regexp_extract(model, _effort(minimal), 1)
    return F.when(found != "", found)


def model_base(model: Column, minimal: bool = False) -> Column:
    return F.regexp_replace(model, _effort(minimal), "")


def thinking_budget(model: Column) -> Column:
    """Tokens to think for models that count them, null without a suffix."""
    effort = effort_suffix(model)
    budget = F.lit(None).cast("int")
    for name, tokens in THINKING.items():
        budget = F.when(effort == name, F.lit(tokens)).otherwise(budget)
    return budget


def sse_text(body: Column) -> Column:
    """The joined deltas of a server-sent event stream."""
    lines = F.filter(F.split(body, "\r?\n", -1), lambda line: F.startswith(line, F.lit("data: ")) & (F.trim(line) != "data: [DONE]"))
    deltas = F.transform(lines, lambda line: F.get_json_object(F.substring(line, 7, 1 << 30), "$.choices[0].delta.content"))
    return F.array_join(F.filter(deltas, lambda d: d.isNotNull()), "")


def changed_lines(report: Column) -> Column:
    """How many lines a structural diff report names: lines "a-b:" or "a:" after colour codes, as a set."""
    plain = F.regexp_replace(report, "\u001b\\[[0-9;]*m", "")
    heads = F.filter(F.split(plain, "\n", -1), lambda line: line.rlike(r"^\d+(\s*-\s*\d+)?:"))
    ranges = F.transform(heads, lambda h: F.sequence(F.regexp_extract(h, r"^(\d+)", 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract(h, r"^\d+\s*-\s*(\d+)", 1), F.lit("")), F.regexp_extract(h, r"^(\d+)", 1)).cast("int")))
    return F.size(F.array_distinct(F.flatten(ranges)))
