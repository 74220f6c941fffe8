"""Pass@k: unbiased estimates, verdict folding, slices and merges. All of it is expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The k values that score reports use.
REPORTED_K = (1, 5, 10, 25, 50, 100, 150, 200)
DIFFICULTIES = ("easy", "medium", "hard")


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """Chance that k of n samples, c of them right, hold a right one.

    1 where n - c < k. Else 1 minus a product over n - c + 1 .. n, which is empty for c = 0: sequence() would
    count downwards there, so that case is answered before it.
    """
    k = F.lit(k) if isinstance(k, int) else k
    factors = F.sequence((n - c + 1).cast("long"), n.cast("long"))
    miss = F.aggregate(F.when(c > 0, factors).otherwise(F.array().cast("array<bigint>")), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def all_passed(codes: Column) -> Column:
    """Whether every test of an instance passed; no test at all counts as passed."""
    return F.forall(codes, lambda x: x > 0)


def verified(codes: Column) -> Column:
    """1 if there are results and all are 1: an empty result is a failure here."""
    return F.when((F.size(codes) > 0) & F.forall(codes, lambda x: x == 1), 1).otherwise(0)


def share_passed(graded: Column) -> Column:
    """Pass@1 of a row from its list of graded samples; null without samples."""
    return F.try_divide(F.size(F.filter(graded, lambda x: x)), F.size(graded))


def fold_codes(results: DataFrame, key: str, code: str) -> DataFrame:
    """(key, n, passed, all_passed, verified, pass_at_1) from one row for each code: counts, so nothing is gathered."""
    counts = results.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(code) > 0).alias("passed"), F.count_if(F.col(code) == 1).alias("_right"))
    every = F.when(F.col("_right") == F.col("n"), 1).otherwise(0)
    return counts.select(key, "n", "passed", (F.col("passed") == F.col("n")).alias("all_passed"), every.alias("verified"), (F.col("passed") / F.col("n")).alias("pass_at_1"))


def fold_generations(results: DataFrame, key: str = "question_id", codes: str = "codes") -> DataFrame:
    """(key, n, c) from one row for each generation with its list of test codes."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(all_passed(F.col(codes))).alias("c"))


def _estimates(counts: DataFrame, by: list[str], ks: tuple[int, ...]) -> DataFrame:
    """(by, n, k, p, m): the estimate for each k, once for every (n, c) that occurs, and how many rows have it.

    Rows are counted by (n, c) first, so that the estimates' work does not grow with the table.
    """
    alike = counts.groupBy(*by, "n", "c").agg(F.count(F.lit(1)).alias("m"))
    exploded = alike.select(*by, "n", "c", "m", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return exploded.withColumn("p", pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def metrics(counts: DataFrame, ks: tuple[int, ...] = (1, 5), gate: bool = True) -> DataFrame:
    """(k, pass_at_k) over (n, c) rows: the mean estimate; with the gate only for k that every row's n reaches."""
    scored = _estimates(counts, [], ks).groupBy("k").agg(F.min("n").alias("least"), (F.sum(F.col("p") * F.col("m")) / F.sum("m")).alias("pass_at_k"))
    return (scored.filter(F.col("least") >= F.col("k")) if gate else scored).select("k", "pass_at_k")


def by_slice(counts: DataFrame, slice_by: str, ks: tuple[int, ...] = REPORTED_K) -> DataFrame:
    """(slice, k, pass_at_k, problems) for every value of ``slice_by`` and, with a null slice, over all."""
    scored = _estimates(counts, [slice_by], ks)
    return scored.groupingSets([[F.col(slice_by), F.col("k")], [F.col("k")]], slice_by, "k").agg((F.sum(F.col("p") * F.col("m")) / F.sum("m")).alias("pass_at_k"), F.sum("m").alias("problems"))


def in_window(df: DataFrame, date: str = "contest_date", start: str | None = None, end: str | None = None, platform: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Rows within the inclusive dates; the end is midnight, so later times on that day fall out."""
    if start is not None:
        df = df.filter(F.col(date) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(date) <= F.to_timestamp(F.lit(end)))
    if platform is not None:
        df = df.filter(F.col("platform") == platform)
    if difficulty is not None:
        df = df.filter(F.col("difficulty") == difficulty)
    return df


def merge_averages(old: DataFrame, new: DataFrame, value: str, key: str) -> DataFrame:
    """(key, total, n, mean) from partial (key, total, n) tables: sums are kept, means are derived last."""
    both = old.select(key, value, "n").unionByName(new.select(key, value, "n"))
    return both.groupBy(key).agg(F.sum(value).alias(value), F.sum("n").alias("n")).withColumn("mean", F.try_divide(F.col(value), F.col("n")))


def merge_details(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both tables; where both have a key, the old value stands."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_has")), new.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_has"), F.col("_old")).otherwise(F.col("_new")).alias(value))


def mean_of_rows(graded: DataFrame, name: str = "graded") -> DataFrame:
    """One row: pass@1 in percent as the mean over rows of their share of right samples."""
    return graded.agg((F.avg(share_passed(F.col(name))) * 100).alias("pass_at_1"))


def execution_scores(results: DataFrame, key: str = "question_id") -> DataFrame:
    """Percent right for each problem from (key, generation, input, right); generations that quote the input are skipped.

    If all are skipped the problem's samples count as wrong.
    """
    used = F.count_if(~F.contains("generation", "input"))
    right = F.count_if(~F.contains("generation", "input") & F.col("right"))
    return results.groupBy(key).agg(used.cast("long").alias("n"), (F.coalesce(F.try_divide(right, used), F.lit(0.0)) * 100).alias("pass_at_1"))


def status_summary(verdicts: DataFrame, status: str = "status") -> DataFrame:
    """One row: totals, passes and pass@1 over rows (0 without rows)."""
    passed = F.count_if(F.col(status) == "pass")
    return verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(status).alias("evaluated"),
        passed.alias("passed"),
        F.count_if(F.col(status) == "fail").alias("failed"),
        F.coalesce(F.try_divide(passed, F.count(status)), F.lit(0.0)).alias("pass_at_1"),
    )
