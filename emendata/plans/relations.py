"""Queries about joins, windows, sets and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, relational
from .tables import rounded, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def task_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.known_tasks(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


def completion_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.ordinal(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"])
    return rows.withColumn("completion_id", F.col("completion_id").cast("long"))


def first_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first = relational.first_row(events, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))
    last = relational.last_row(events, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"))
    return first.join(last, "user_id")


def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return relational.first_match(customers, orders, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "c_mktsegment", "o_orderkey")


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return relational.top_per_group(events, "user_id", [F.col("value"), F.col("event_id")], 3)


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    pairs = relational.best_and_worst(events, "user_id", "value", "event_id")
    same = pairs.filter((F.col("best.event_type") == F.col("worst.event_type")) & (F.col("best.value") < F.col("worst.value")))
    return same.select("user_id", F.col("best.event_id").alias("chosen"), F.col("worst.event_id").alias("rejected"))


def preference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("problem_spec"), F.col("lang").alias("corrupted_answer"), F.sha2("text", 256).alias("completion"), F.col("n_chars").alias("levenshtein"), F.col("doc_id").alias("_pos"))
    return datasets.preference_pairs(rows).select(F.col("input").alias("prompt"), "chosen", "rejected")


def sort_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    keyed = orders.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return relational.take_first(keyed, ["n_lines", "o_orderkey"], 100)  # the limit is what is asked for


def metric_unpivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = relational.to_long(table(spark, sf_dir, "lineitem").select("l_returnflag", *MEASURES), ["l_returnflag"], MEASURES)
    return relational.mean_metrics(long, ["l_returnflag"]).select("l_returnflag", "metric", rounded(F.col("mean"), 4).alias("mean"), "n")


def metric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metric_unpivot_mean(spark, sf_dir).select(F.col("l_returnflag").alias("pair"), "metric", F.col("mean").alias("value"))
    return relational.metric_difference(means, "pair", "A", "R", []).select("metric", rounded(F.col("difference"), 4).alias("difference"))


def union_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parted by a hash of their language: each language's rows come back from one side only, and all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = relational.union_with_origin(*relational.split_by_key(docs.filter(F.col("lang").isNotNull()), "lang", 3))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"), F.count_distinct("_origin").alias("sides"))


def edge_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last hundred documents (or half of them) as test sides, and their rows in a seeded order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    out = None
    for last in (False, True):
        train, test = relational.edge_split(docs, ["doc_id"], 100, last)
        both = relational.union_with_origin(train, test).select("doc_id", F.col("_origin").cast("long").alias("origin"), F.lit(last).alias("last"))
        out = both if out is None else out.union(both)
    return relational.seeded_order(out, "doc_id", 7)


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("corrupted_answer"))
    return datasets.usable_edits(rows).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.char_length("corrupted_answer").cast("long").alias("n_characters"), "quality")


def explode_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.coalesce("role", F.lit("")).alias("value"))
    lists = relational.gather(rows, "conv_id")
    back = relational.scatter(lists, "conv_id", "values")
    again = relational.gather(back, "conv_id")
    return again.select("conv_id", F.array_join("values", ">").alias("roles"))


def zip_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return relational.zip_by_key(left, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"])


def batch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("custom_id"))
    responses = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("custom_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("response"))
    return relational.with_responses(requests, responses)


def prompt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    cache = turns.filter("turn = 0").groupBy(F.col("text").alias("prompt")).agg(F.collect_list(F.lit("x")).alias("outputs"))
    hits, misses = relational.cache_split(turns.select("conv_id", "turn", F.col("text").alias("prompt")), cache, 1)
    tagged = hits.select("conv_id", "turn", F.lit("hit").alias("outcome")).union(misses.select("conv_id", "turn", F.lit("miss").alias("outcome")))
    return tagged


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ \n]+)"), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("completion_tokens"), words.alias("prompt_tokens"), F.when(F.col("lang") == "es", F.lit("failed")).alias("error"))
    usage = relational.usage_totals(rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")), ["source"])
    return usage.select("source", "prompt_tokens", "completion_tokens", "total_tokens", "requests", rounded(F.col("mean_tokens")).alias("mean_tokens"))


QUERIES = {f.__name__: f for f in (resume_anti_join, task_inner_join, completion_ordinal, first_last_per_key, first_match_join, topk_per_group, preference_pairs, preference_records, sort_by_difficulty, metric_unpivot_mean, metric_difference, union_split, edge_splits, length_filter, explode_regroup, zip_results, batch_responses, prompt_cache, token_usage)}

_MEANS = "means AS (SELECT l_returnflag, metric, round(avg(value), 4) AS mean, count(value) AS n FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY 1, 2)"
ORACLES = {
    "resume_anti_join": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "task_inner_join": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "completion_ordinal": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS completion_id FROM conversations",
    "first_last_per_key": """
        SELECT user_id, max(event_id) FILTER (WHERE a = 1) AS first_event, max(event_type) FILTER (WHERE a = 1) AS first_type, max(event_id) FILTER (WHERE b = 1) AS last_event, max(event_type) FILTER (WHERE b = 1) AS last_type
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) GROUP BY 1""",
    "first_match_join": """
        SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey""",
    "topk_per_group": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) <= 3",
    "preference_pairs": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS b FROM events)
        SELECT x.user_id, x.event_id AS chosen, y.event_id AS rejected FROM r x JOIN r y ON x.user_id = y.user_id AND x.a = 1 AND y.b = 1 WHERE x.event_type = y.event_type AND x.value < y.value""",
    "preference_records": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS b FROM documents)
        SELECT 'I am trying to implement a function with the following specifications:' || chr(10) || x.source || '.' || chr(10) || chr(10) || 'The function I have written so far is:' || chr(10) || '```python' || chr(10) || x.lang || ' ```' || chr(10) || chr(10) || 'Wrap your response in ```python and ```' AS prompt,
            sha256(x.text) AS chosen, sha256(y.text) AS rejected
        FROM r x JOIN r y ON x.source = y.source AND x.a = 1 AND y.b = 1 WHERE x.lang = y.lang AND x.n_chars < y.n_chars""",
    "sort_by_difficulty": "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY n_lines, o_orderkey LIMIT 100",
    "metric_unpivot_mean": f"WITH {_MEANS} SELECT * FROM means",
    "metric_difference": f"WITH {_MEANS} SELECT a.metric, round(a.mean - r.mean, 4) AS difference FROM means a JOIN means r ON a.metric = r.metric WHERE a.l_returnflag = 'A' AND r.l_returnflag = 'R'",
    "union_split": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum, 1::BIGINT AS sides FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "edge_splits": """
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS b, least(100, count(*) OVER () // 2) AS n FROM documents)
        SELECT doc_id, (CASE WHEN last THEN b ELSE a END <= n)::BIGINT AS origin, last FROM r, (VALUES (FALSE), (TRUE)) l(last)""",
    "length_filter": "SELECT doc_id, length(text) AS n_characters, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE length(text) < 2000",
    "explode_regroup": "SELECT conv_id, string_agg(coalesce(role, ''), '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1",
    "zip_results": "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)",
    "batch_responses": "SELECT doc_id AS custom_id, coalesce('quality ' || quality, 'Result missing') AS response FROM documents LEFT JOIN labels USING (doc_id)",
    "prompt_cache": """
        WITH cache AS (SELECT text FROM conversations WHERE turn = 0 AND text IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
        SELECT conv_id, turn, CASE WHEN text IN (SELECT text FROM cache) THEN 'hit' ELSE 'miss' END AS outcome FROM conversations WHERE text IS NOT NULL""",
    "token_usage": r"""
        WITH x AS (SELECT source, lang, n_chars AS completion, len(regexp_extract_all(coalesce(text, ''), '[^ \n]+')) AS prompt FROM documents)
        SELECT source, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens, sum(prompt + completion)::BIGINT AS total_tokens, count(*) AS requests, round(avg(prompt + completion), 6) AS mean_tokens
        FROM x WHERE lang IS DISTINCT FROM 'es' GROUP BY 1""",
}
