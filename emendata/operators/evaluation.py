"""Evaluation of a solutions table: variants, pairs, metrics in long form, complexity, aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as code_functions

#: Fixed names: pairs as (name, reference, prediction), and what each variant does to a program.
PAIRS = (("canonical_vs_corrupted", "corrupted_solution", "canonical_solution"), ("llm_vs_corrupted", "corrupted_solution", "solution"), ("llm_vs_canonical", "canonical_solution", "solution"))
VARIANTS = ("", "no_comments_", "body_", "body_no_comments_")
METRICS = ("levenshtein", "normalized_levenshtein", "line_distance", "normalized_line_distance", "bleu", "rouge_1", "rouge_2", "rouge_l", "meteor", "chrf", "codebleu", "diffsitter", "normalized_diffsitter")
#: Rows of metrics that Python holds at a time.
SLICE = 10_000
LONG = "task_id string, _line long, pair string, variant string, metric string, value double"


@lru_cache(maxsize=4096)
def _metrics(reference: str, prediction: str) -> tuple[float, ...]:
    """METRICS of one pair of texts, tokenised once; the structural diff is the library's own, -1 where a side does not parse."""
    a, b = code_functions.code_tokens(reference), code_functions.code_tokens(prediction)
    x, y = ([line.strip() for line in text.split("\n")] for text in (reference, prediction))
    tokens, lines = code_functions.sequence_distance(a, b), code_functions.sequence_distance(x, y)
    distances = (float(tokens), tokens / max(len(a), len(b), 1), float(lines), lines / max(len(x), len(y), 1))
    overlaps = (code_functions.sentence_bleu(a, b), code_functions.rouge_n(reference, prediction, 1), code_functions.rouge_n(reference, prediction, 2), code_functions.rouge_l(reference, prediction), code_functions.meteor(reference, prediction), code_functions.chrf(reference, prediction), code_functions.codebleu(reference, prediction))
    leaf_lines, most = code_functions.changed_leaf_lines(reference, prediction), max(len(reference.splitlines()), len(prediction.splitlines()))
    return (*distances, *overlaps, float(leaf_lines), -1.0 if leaf_lines < 0 else leaf_lines / max(most, 1))


def _variant(text: str, variant: str) -> str:
    if variant.startswith("body_"):
        text = code_functions.function_body(text)
    return code_functions.standardise(text) if variant.endswith("no_comments_") else text


def similarity_long(solutions: DataFrame) -> DataFrame:
    """LONG: every metric of every pair and variant. A missing or empty side gives no rows, an empty body zeros."""
    columns = ["task_id", F.col("_line").alias("line"), "solution", "corrupted_solution", "canonical_solution"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, names = [], ["task_id", "_line", "pair", "variant", "metric", "value"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                if len(rows) >= SLICE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
                for pair, ref, pred in PAIRS:
                    reference, prediction = getattr(r, ref), getattr(r, pred)
                    if not reference or not prediction:
                        continue
                    for v in VARIANTS:
                        a, b = _variant(reference, v), _variant(prediction, v)
                        values = _metrics(a, b) if a and b else (0.0,) * len(METRICS)
                        rows += [(r.task_id, r.line, pair, v, m, x) for m, x in zip(METRICS, values, strict=True)]
        yield pd.DataFrame(rows, columns=names)

    return solutions.select(*columns).mapInPandas(run, LONG)


def diff_rows(solutions: DataFrame) -> DataFrame:
    """(task_id, _line, pair, type, content, row) of the structured diffs of the three pairs."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pair"), F.col(a).alias("before"), F.col(b).alias("after")) for p, a, b in PAIRS])
    each = solutions.select("task_id", "_line", F.inline(pairs)).filter((F.coalesce("before", F.lit("")) != "") & (F.coalesce("after", F.lit("")) != ""))
    return each.select("task_id", "_line", "pair", F.posexplode(code_functions.diff_of("before", "after")).alias("row", "d")).select("task_id", "_line", "pair", "row", "d.type", "d.content")


def complexity_rows(solutions: DataFrame) -> DataFrame:
    """Both complexities of the three programs and their differences; nulls where a program does not parse."""
    from .grading import complexity_deltas

    named = {"canonical": "canonical_solution", "corrupted": "corrupted_solution", "llm": "solution"}
    found = solutions.select("task_id", "_line", *[code_functions.complexity_of(c).alias(n) for n, c in named.items()])
    flat = found.select("task_id", "_line", *[F.col(f"{n}.{k}").alias(f"{k}_{n}") for n in named for k in ("cyclomatic", "cognitive")])
    return complexity_deltas(flat)


def complexity_means(rows: DataFrame) -> DataFrame:
    """(measure, mean) of the twelve measures of complexity_rows(); unknown values are skipped."""
    measures = [c for c in rows.columns if c.startswith(("cyclomatic_", "cognitive_"))]
    means = rows.agg(*[F.avg(c).alias(c) for c in measures])
    return means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("mean")) for c in measures])))


def summarise(long: DataFrame) -> DataFrame:
    """(pair, variant, metric, mean, n): missing values are skipped, the sentinel -1 is not."""
    return long.groupBy("pair", "variant", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def corpus_scores(solutions: DataFrame) -> DataFrame:
    """(pair, variant, codebleu, bleu) over all rows: counts are summed on the executors before either formula.

    The pair of canonical and corrupted code has the two variants without bodies, the others all four.
    """
    columns = ["solution", "corrupted_solution", "canonical_solution"]
    names = code_functions.CODEBLEU_PARTS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], dict[str, float]] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                forms = {c: {v: _variant(text, v) for v in VARIANTS} for c in columns if (text := getattr(r, c))}
                for i, (pair, ref, pred) in enumerate(PAIRS):
                    for v in VARIANTS if i else VARIANTS[:2]:
                        if ref in forms and pred in forms and (a := forms[ref][v]) and (b := forms[pred][v]):
                            total = sums.setdefault((pair, v), dict.fromkeys(names, 0.0))
                            for k, x in code_functions.codebleu_parts(a, b).items():
                                total[k] += x
        yield pd.DataFrame([(*key, *(total[n] for n in names)) for key, total in sums.items()], columns=["pair", "variant", *names])

    partial = solutions.select(*columns).mapInPandas(run, "pair string, variant string, " + ", ".join(f"{n} double" for n in names))
    sums = partial.groupBy("pair", "variant").agg(*[F.sum(n).alias(n) for n in names])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            yield pd.DataFrame({"pair": frame["pair"], "variant": frame["variant"], "codebleu": [code_functions.codebleu_of_parts(r) for r in rows], "bleu": [_micro_bleu(r) for r in rows]})

    return sums.mapInPandas(score, "pair string, variant string, codebleu double, bleu double")


def _micro_bleu(parts: dict) -> float:
    """BLEU from summed counts, smoothed as for one pair."""
    if not parts["plain_right1"]:
        return 0.0
    shares = [(parts[f"plain_right{n}"] or 0.1) / (parts[f"plain_total{n}"] or 1.0) for n in range(1, 5)]
    return math.prod(shares) ** 0.25 * (1.0 if parts["n_prediction"] > parts["n_reference"] else math.exp(1 - parts["n_reference"] / parts["n_prediction"]))
