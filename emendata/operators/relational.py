"""Joins, windows, sets and reshapes of the evaluation pipelines, each with the order made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unprocessed(candidates: DataFrame, done: DataFrame, keys: str | list[str] = "task_id") -> DataFrame:
    """Rows whose key is not done yet: the resumable runs' filter."""
    names = [keys] if isinstance(keys, str) else keys
    return candidates.join(done.select(*names).distinct(), names, "left_anti")


def all_processed(candidates: DataFrame, done: DataFrame, key: str = "task_id") -> bool:
    return unprocessed(candidates, done, key).isEmpty()


def known_tasks(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Samples with their problem's columns; samples of unknown problems fall out."""
    return samples.join(problems, key, "inner")


def ordinal(df: DataFrame, key: str, order: list[str], name: str = "completion_id") -> DataFrame:
    """A running number from 0 within each key, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def first_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate that combines before its shuffle."""
    return _edge_row(df, key, order, F.min_by)


def last_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: what a dictionary built in that order would keep."""
    return _edge_row(df, key, order, F.max_by)


def _edge_row(df: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``left`` with the columns of the first row of ``right`` that has its key; nulls without one."""
    return left.join(first_row(right, key, order), key, "left")


def top_per_group(df: DataFrame, group: str, by: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; give a tie-break in ``by``. Spark limits groups before the shuffle."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def best_and_worst(df: DataFrame, group: str, by: str, position: str) -> DataFrame:
    """(group, best, worst): the first of the least rows, and the last of the greatest, by position."""
    rest = F.struct(*[c for c in df.columns if c != group])
    at = F.struct(by, position)
    return df.groupBy(group).agg(F.min_by(rest, at).alias("best"), F.max_by(rest, at).alias("worst"))


def take_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def zip_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What a zip of two sorted lists does, as a join on the key they are sorted by."""
    return left.join(right, keys, "inner")


def with_responses(requests: DataFrame, responses: DataFrame, key: str = "custom_id", missing: str = "Result missing") -> DataFrame:
    """Every request with its response; a default where none came."""
    return requests.join(responses.select(key, "response"), key, "left").withColumn("response", F.coalesce("response", F.lit(missing)))


def scatter(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, position, value) for each element of a list column; empty lists give no rows."""
    return df.select(key, F.posexplode(values).alias("position", "value"))


def gather(df: DataFrame, key: str, position: str = "position", value: str = "value", name: str = "values") -> DataFrame:
    """The inverse of scatter(): values in the order of their positions."""
    pairs = F.array_sort(F.collect_list(F.struct(position, value)))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias(name))


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) from one column for each metric."""
    return df.unpivot(keys, metrics, "metric", "value")


def mean_metrics(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each metric; nulls are skipped, sentinel numbers are not."""
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def metric_difference(long: DataFrame, pair: str, minuend: str, subtrahend: str, keys: list[str]) -> DataFrame:
    """(keys, metric, difference) of two pairs, for metrics that both have."""
    a = long.filter(F.col(pair) == minuend).select(*keys, "metric", F.col("value").alias("_a"))
    b = long.filter(F.col(pair) == subtrahend).select(*keys, "metric", F.col("value").alias("_b"))
    return a.join(b, [*keys, "metric"]).select(*keys, "metric", (F.col("_a") - F.col("_b")).alias("difference"))


def union_with_origin(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("_origin", F.lit(0)).unionByName(second.withColumn("_origin", F.lit(1)), allowMissingColumns=True)


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A shuffle that depends on the key and the seed only, so it is the same on every run and cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def split_by_key(df: DataFrame, key: str, tenths: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: all rows of a key go to the same side."""
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(10))
    return df.filter(part >= tenths), df.filter(part < tenths)


def edge_split(df: DataFrame, order: list[str], n: int = 100, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) where the test side is the first or last n rows by ``order``, a key; at most half of all rows.

    Only the test side is sorted, and as a top-n; its keys are few whatever the table's size.
    """
    n = min(n, df.count() // 2)
    test = df.orderBy(*[F.desc(c) if last else F.asc(c) for c in order]).limit(n)
    return df.join(F.broadcast(test.select(*order)), order, "left_anti"), test


def usage_totals(samples: DataFrame, by: list[str]) -> DataFrame:
    """Token sums, requests and means; rows with an error or without usage do not count."""
    usable = samples.filter(F.col("error").isNull() & F.col("total_tokens").isNotNull())
    return usable.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("requests"), F.avg("total_tokens").alias("mean_tokens"))


def cache_split(prompts: DataFrame, cache: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a prompt hits when the cache holds n outputs for it; of several such entries the greatest outputs."""
    usable = cache.filter(F.size("outputs") == n).groupBy(F.sha2("prompt", 256).alias("_key")).agg(F.max("outputs").alias("outputs"))
    keyed = prompts.withColumn("_key", F.sha2("prompt", 256))
    return keyed.join(usable, "_key").drop("_key"), keyed.join(usable, "_key", "left_anti").drop("_key")
