"""Queries about pass@k, verdicts and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading, passk, relational
from .tables import COUNTS, PASS_AT_K, graded_counts, rounded, table


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = graded_counts(spark, sf_dir)
    ks = F.explode(F.array(F.lit(1), F.lit(5))).alias("k")
    return counts.select("question_id", "n", "c", ks).select("question_id", "k", rounded(passk.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"))


def pass_at_k_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("difficulty"))
    joined = graded_counts(spark, sf_dir).join(orders, "question_id")
    scores = passk.by_slice(joined, "difficulty")
    return scores.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "k", rounded(F.col("pass_at_k")).alias("pass_at_k"), F.col("problems").cast("long").alias("problems"))


def pass_metrics_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passk.metrics(graded_counts(spark, sf_dir), (1, 2, 5), gate=True).select("k", rounded(F.col("pass_at_k")).alias("pass_at_k"))


def score_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderdate").alias("contest_date"), F.col("o_orderstatus").alias("platform"), F.col("o_orderpriority").alias("difficulty"))
    chosen = passk.in_window(orders, start="1994-01-01", end="1996-12-31", platform="O")
    joined = graded_counts(spark, sf_dir).join(chosen, "question_id")
    one = passk.pass_at_k(F.col("n"), F.col("c"), 1)
    return joined.groupBy("difficulty").agg(F.count(F.lit(1)).alias("problems"), rounded(F.avg(one)).alias("pass_at_1"))


def pass_at_1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.when(F.col("l_returnflag") != "R", 1).otherwise(-2).alias("code"))
    return passk.fold_codes(lines, "question_id", "code").select("question_id", "n", rounded(F.col("pass_at_1")).alias("pass_at_1"), "all_passed")


def verdict_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", -2).otherwise(1).alias("code"))
    return passk.fold_codes(lines, "l_orderkey", "code").select("l_orderkey", "all_passed", F.col("verified").cast("long").alias("verified"))


def eval_merge_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("key"), "l_quantity")
    cut = F.col("l_shipdate") < F.to_timestamp(F.lit("1995-06-17"))
    part = lambda rows: rows.groupBy("key").agg(F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"))
    merged = passk.merge_averages(part(lines.filter(cut)), part(lines.filter(~cut)), "total", "key")
    return merged.select("key", "n", rounded(F.col("mean")).alias("mean"))


def eval_merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus")
    part = lambda rows: rows.groupBy("key").agg(F.min("o_orderkey").alias("value"))
    return passk.merge_details(part(orders.filter("o_orderstatus = 'F'")), part(orders.filter("o_orderstatus <> 'F'")), "key", "value")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail")
    summary = passk.status_summary(rows.withColumn("status", status))
    return summary.select("total", "evaluated", "passed", "failed", rounded(F.col("pass_at_1")).alias("pass_at_1"))


def execution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull()).select(F.col("conv_id").alias("question_id"), F.col("text").alias("generation"), F.lit("The").alias("input"), (F.length("text") % 2 == 0).alias("right"))
    return passk.execution_scores(rows).select("question_id", "n", rounded(F.col("pass_at_1")).alias("pass_at_1"))


def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    further = F.col("n_chars") / 100000.0 - 0.05
    value = grading.reward(F.col("quality"), [further, F.when(F.col("toxic") == 1, F.lit(0.25))])
    return rows.select("doc_id", rounded(value).alias("reward"))


def test_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest five of each document's lines, and the two longest lists of its words by line; ties in their order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    tests = F.transform("lines", lambda x, i: F.struct(x.alias("input"), i.alias("output")))
    lists = F.transform("lines", lambda x, i: F.struct(F.split(x, " ", -1).alias("input"), i.alias("output")))
    places = lambda c: F.array_join(F.transform(c, lambda t: t["output"].cast("string")), ",")
    return docs.select("doc_id", places(grading.longest_tests(tests)).alias("by_characters"), places(grading.longest_tests(lists, 2, lists=True)).alias("by_elements"))


def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    plural = F.concat(F.lit('[{"inputs": "'), k, F.lit('", "outputs": "'), F.col("event_type"), F.lit('"}]'))
    parallel = F.concat(F.lit('{"inputs": ["'), k, F.lit('", "0"], "outputs": ["'), F.col("event_type"), F.lit('", "x"]}'))
    text = F.when(F.col("event_id") % 2 == 0, plural).otherwise(parallel)
    tests = events.select("event_id", grading.normalise_tests(text).alias("tests"))
    return tests.select("event_id", F.posexplode("tests").alias("position", "t")).select("event_id", F.col("position").cast("long").alias("position"), "t.input", "t.output")


QUERIES = {f.__name__: f for f in (pass_at_k, pass_at_k_by_difficulty, pass_metrics_gated, score_date_window, pass_at_1_rows, verdict_folding, eval_merge_weighted, eval_merge_details, status_summary, execution_scores, reward, test_selection, json_normalise)}

ORACLES = {
    "pass_at_k": f"WITH {COUNTS}, x AS (SELECT *, unnest([1, 5]) AS k FROM counts) SELECT question_id, k, round(CAST({PASS_AT_K} AS DOUBLE), 6) AS pass_at_k FROM x",
    "pass_at_k_by_difficulty": f"""
        WITH {COUNTS}, x AS (SELECT c.*, o_orderpriority AS difficulty, unnest([1, 5, 10, 25, 50, 100, 150, 200]) AS k FROM counts c JOIN orders ON question_id = o_orderkey),
        p AS (SELECT difficulty, k, CAST({PASS_AT_K} AS DOUBLE) AS p FROM x)
        SELECT coalesce(difficulty, 'all') AS difficulty, k, round(avg(p), 6) AS pass_at_k, count(*) AS problems FROM p GROUP BY GROUPING SETS ((difficulty, k), (k))""",
    "pass_metrics_gated": f"""
        WITH {COUNTS}, x AS (SELECT *, unnest([1, 2, 5]) AS k FROM counts)
        SELECT k, round(avg(CAST({PASS_AT_K} AS DOUBLE)), 6) AS pass_at_k FROM x GROUP BY k HAVING min(n) >= k""",
    "score_date_window": f"""
        WITH {COUNTS}, x AS (SELECT c.*, o_orderpriority AS difficulty, 1 AS k FROM counts c JOIN orders ON question_id = o_orderkey
            WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_orderstatus = 'O')
        SELECT difficulty, count(*) AS problems, round(avg(CAST({PASS_AT_K} AS DOUBLE)), 6) AS pass_at_1 FROM x GROUP BY 1""",
    "pass_at_1_rows": "SELECT l_orderkey AS question_id, count(*) AS n, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END), 6) AS pass_at_1, bool_and(l_returnflag <> 'R') AS all_passed FROM lineitem GROUP BY 1",
    "verdict_folding": "SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS all_passed, CAST(bool_and(l_returnflag <> 'R') AS BIGINT) AS verified FROM lineitem GROUP BY 1",
    "eval_merge_weighted": "SELECT l_returnflag AS key, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "eval_merge_details": """
        WITH a AS (SELECT o_custkey AS key, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
        b AS (SELECT o_custkey AS key, min(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
        SELECT coalesce(a.key, b.key) AS key, coalesce(a.v, b.v) AS value FROM a FULL JOIN b ON a.key = b.key""",
    "status_summary": """
        SELECT count(*) AS total, count(quality) AS evaluated, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 0) AS failed,
            round(count(*) FILTER (WHERE quality = 1) / count(quality)::DOUBLE, 6) AS pass_at_1 FROM documents LEFT JOIN labels USING (doc_id)""",
    "execution_scores": """
        SELECT conv_id AS question_id, count(*) FILTER (WHERE NOT contains(text, 'The')) AS n,
            round(coalesce(100.0 * count(*) FILTER (WHERE NOT contains(text, 'The') AND length(text) % 2 = 0) / nullif(count(*) FILTER (WHERE NOT contains(text, 'The')), 0), 0.0), 6) AS pass_at_1
        FROM conversations WHERE text IS NOT NULL GROUP BY 1""",
    "reward": """
        SELECT doc_id, round(CASE WHEN quality = 1 THEN 0.1 - (n_chars / 100000.0::DOUBLE - 0.05) - CASE WHEN toxic = 1 THEN 0.25 ELSE 0 END ELSE -0.2 END, 6)::DOUBLE AS reward
        FROM documents JOIN labels USING (doc_id)""",
    "test_selection": """
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > 5 THEN -length(line) END, i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > 2 THEN -len(string_split(line, ' ')) END, i) AS b FROM x)
        SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY a) FILTER (WHERE a <= 5) AS by_characters, string_agg(i::VARCHAR, ',' ORDER BY b) FILTER (WHERE b <= 2) AS by_elements FROM r GROUP BY 1""",
    "json_normalise": """
        WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
        SELECT event_id, 0::BIGINT AS position, k AS input, event_type AS output FROM e
        UNION ALL SELECT event_id, 1::BIGINT, '0', 'x' FROM e WHERE event_id % 2 <> 0""",
}
