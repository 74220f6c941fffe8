"""Queries about programs. One of a few programs is laid over each document, with a name of the row's own in it.

What the SQL expects of each program is worked out by hand from the rules.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, registry, similarity
from ..operators import evaluation
from ..streaming import resume
from . import texts
from .mutations import values
from .tables import PASS_AT_K, TURN_PAIRS, rounded, table, turn_pairs, work_folder

SOLUTIONS = "canonical_solution string, corrupted_solution string, solution string"
#: (canonical, corrupted, answer); NAME stands for v and three digits.
EDITS = (("NAME = 1", "NAME = 2", "NAME = 1"), ("NAME = 1  # c", "NAME = 2", None))
DIFFS = (
    ("def f(NAME):\n    x = 1\n    return NAME + x", "def f(NAME):\n    x = 1\n    return NAME - x", "def f(NAME):\n    return NAME + 1"),
    ("NAME = 1", "NAME = 1", ""),
)
COMPLEX = (
    ("def g(NAME, b): return NAME and b", "def h(NAME): return [x for x in NAME if x]", "def ("),
    ("def f(NAME, b):\n if NAME and b:\n  for x in NAME: return x\n return 0", "try:\n NAME()\nexcept E:\n b()\nfinally:\n c()", "x = NAME if b else c"),
)
#: (program, in standard form, its body, tokens)
FORMS = (
    ("def f(NAME, b):\n    # note\n    return NAME+b\n", "def f(NAME, b):\n    return NAME + b", "def f(NAME, b):\n    return NAME + b", 14),
    ("def f(NAME):\n    '''Doc.'''\n    x = 'a # b'  # c\n    return x\n", 'def f(NAME):\n    """Doc."""\n    x = \'a # b\'\n    return x', "    x = 'a # b'\n    return x", 16),
    ("def f(NAME):\n    'only'\n", "def f(NAME):\n    \"\"\"only\"\"\"", "", 9),
)
#: (response, the program in it)
RESPONSES = (
    (" NAME = 1\n", "NAME = 1"),
    ("Hi\n```python\nNAME=1\n```\nand\n```\nlonger = NAME\n```\n", "longer = NAME"),
    ("say\n```python\nNAME(", "NAME("),
    ("<think>\n```python\nlonger = 12345678\n```\n</think>\n```python\nNAME=1\n```", "NAME=1"),
    ("plain text NAME, no code", ""),
    ("so\n```\nNAME1\n```\n```\nNAME2\n```", "NAME1"),
)


def _over(spark: SparkSession, sf_dir: str, rows: tuple, ddl: str) -> DataFrame:
    """(task_id, _line, the columns): one of the rows for each document, by doc_id."""
    names = [x.split(" ")[0] for x in ddl.split(", ")]
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {ddl}")
    own = F.concat(F.lit("v"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).cast("int").alias("case_id"), own.alias("own"))
    return docs.join(F.broadcast(cases), "case_id").select(F.col("doc_id").cast("string").alias("task_id"), F.col("doc_id").alias("_line"), *[F.replace(n, F.lit("NAME"), F.col("own")).alias(n) for n in names])


def structured_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diff_rows(_over(spark, sf_dir, DIFFS, SOLUTIONS)).select("task_id", "pair", F.col("row").cast("long").alias("row"), "type", "content")


def code_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.complexity_rows(_over(spark, sf_dir, COMPLEX, SOLUTIONS)).drop("_line")


def complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluation.complexity_means(evaluation.complexity_rows(_over(spark, sf_dir, COMPLEX, SOLUTIONS)))
    return means.select("measure", rounded(F.col("mean")).alias("mean"))


def standardize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, [f[:1] for f in FORMS], "program string")
    return rows.select("task_id", code.standardise_code("program").alias("standard"), code.body_of("program").alias("body"), F.size(code.tokenise_code("program")).cast("long").alias("n_tokens"))


def response_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [r[:1] for r in RESPONSES], "response string").select("task_id", code.code_of_response("response").alias("code"))


def similarity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.similarity_long(_over(spark, sf_dir, EDITS, SOLUTIONS)).select("task_id", "pair", "variant", "metric", rounded(F.col("value")).alias("value"))


def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarise(evaluation.similarity_long(_over(spark, sf_dir, EDITS, SOLUTIONS))).select("pair", "variant", "metric", rounded(F.col("mean")).alias("mean"), "n")


def corpus_codebleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.corpus_scores(_over(spark, sf_dir, EDITS, SOLUTIONS)).select("pair", "variant", rounded(F.col("codebleu"), 9).alias("codebleu"), rounded(F.col("bleu"), 9).alias("bleu"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join("reference", " ").alias("a"), F.array_join("prediction", " ").alias("b"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", rounded(code.rouge_l_of("a", "b")).alias("rouge_l"))


def meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", rounded(code.meteor_of("a", "b")).alias("meteor"))


def codebleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, EDITS, SOLUTIONS)
    return rows.select("task_id", rounded(code.codebleu_of("corrupted_solution", "canonical_solution")).alias("codebleu"), rounded(code.codebleu_of("canonical_solution", "solution")).alias("of_answer"))


def diff_rows_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs in SQL, by the table function: a document's words as numbered lines against those with the first replaced and the sixth gone."""
    registry.register(spark)
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   "), " "), lambda w: w != "")
    lines = F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(": "), w))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("before"), F.concat(F.array_join(F.concat(F.array(F.lit("new")), F.slice(lines, 2, 4), F.slice(lines, 7, 1 << 30)), "\n"), F.lit("\n")).alias("after"))
    return spark.sql("SELECT doc_id, row, type, content FROM {rows}, LATERAL diff_rows(before, after)", rows=rows)


def functions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of turns in SQL, by the names of the functions."""
    registry.register(spark)
    rows = turn_pairs(spark, sf_dir)
    text = """
        SELECT conv_id, turn, token_distance(reference, prediction) AS distance, round(bleu(reference, prediction), 6) AS bleu,
            round(pass_at_k(size(reference), least(size(prediction), size(reference)) div 2, 3), 6) AS chance,
            output_equal(array_join(reference, ' '), concat(' ', array_join(reference, ' '), '\n')) AS same,
            all_verified(transform(prediction, x -> 1)) AS verified
        FROM {rows}"""
    return spark.sql(text, rows=rows)


#: What stands before a word's synonym in meteor_synonyms.
MARK = "zz9"


def meteor_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves with every word replaced; words that begin with a to m have the new word as a synonym."""
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    rows = table(spark, sf_dir, "conversations").filter(F.trim("text") != "").select("conv_id", "turn", words.alias("words"))
    texts = rows.select("conv_id", "turn", F.array_join("words", " ").alias("a"), F.array_join(F.transform("words", lambda w: F.concat(F.lit(MARK), w)), " ").alias("b"))
    known = rows.select(F.explode("words").alias("synonym")).distinct().filter("synonym RLIKE '^[a-m]'").select(F.concat(F.lit(MARK), "synonym").alias("word"), "synonym")
    return similarity.meteor(texts, ["conv_id", "turn"], "a", "b", known).select("conv_id", "turn", rounded(F.col("meteor")).alias("meteor"))


#: Batches of the streams, the days of event time that each covers, and the horizon within which a key is given once.
BATCHES, DAYS, HORIZON = 4, 8, 7


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the batch in which they arrive: that of their days, the next for some of its last hours, the last for a few of the first days."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    days = F.datediff("ts", F.lit("2024-01-01"))
    batch = F.least(F.expr(f"int({BATCHES - 1})"), F.floor(days / DAYS)).cast("int")
    held = (days % DAYS == DAYS - 1) & (F.hour("ts") >= 12) & (F.col("event_id") % 3 == 0) & (batch < BATCHES - 1)
    lost = (batch == 0) & (F.col("event_id") % 11 == 5)
    return events.withColumn("arrives", F.when(lost, BATCHES - 1).when(held, batch + 1).otherwise(batch))


def streaming_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over files that keep arriving: the first event of each user and horizon, with late, lost and repeated ones."""
    arrivals, folder = _arrivals(spark, sf_dir), work_folder(spark, "stream")
    ddl = "task_id string, event_id long, ts timestamp"
    for batch in range(BATCHES):
        part = arrivals.filter(F.col("arrives") == batch).drop("arrives")
        part.union(part.filter("event_id % 7 = 1")).write.mode("append").json(f"{folder}/in")
        stream = resume.first_records(resume.new_records(spark, f"{folder}/in", ddl), horizon=datetime.timedelta(days=HORIZON))
        resume.append_batches(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(ddl).option("recursiveFileLookup", "true").json(f"{folder}/out").select("task_id", "event_id")


def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and hour, in the windows that the watermark has closed when the stream ends."""
    folder = work_folder(spark, "stream")
    table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).write.json(f"{folder}/in")
    stream = resume.counts_by_window(resume.new_records(spark, f"{folder}/in", "event_type string, ts timestamp"), "ts", "event_type")
    resume.append_batches(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.schema("begin timestamp, event_type string, n long").option("recursiveFileLookup", "true").json(f"{folder}/out")
    return rows.select(F.date_format("begin", "yyyy-MM-dd HH").alias("begin"), "event_type", "n")


QUERIES = {f.__name__: f for f in (structured_diff, code_complexity, complexity_summary, standardize_code, response_code, similarity_metrics, similarity_summary, corpus_codebleu, rouge_l, meteor, codebleu, diff_rows_by_name, functions_by_name, meteor_synonyms, streaming_resume, streaming_windows)}


def _joined(rows: list[tuple], names: str) -> str:
    return f"(SELECT doc_id, doc_id::VARCHAR AS task_id, 'v' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS own, cases.* FROM documents JOIN {values(rows, names)} ON doc_id % {len(rows)} = case_id)"


def _rows_of(rows: list[tuple], n: int, names: str) -> str:
    """Several rows for each document: the first column says for which of n programs."""
    return f"(SELECT doc_id::VARCHAR AS task_id, 'v' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS own, cases.* FROM documents JOIN {values(rows, 'program, ' + names)} ON doc_id % {n} = program)"


_DIFF_ROWS = [
    (0, "canonical_vs_corrupted", 0, "context", " def f(NAME):"), (0, "canonical_vs_corrupted", 1, "context", "     x = 1"), (0, "canonical_vs_corrupted", 2, "removed", "    return NAME - x"), (0, "canonical_vs_corrupted", 3, "added", "    return NAME + x"),
    (0, "llm_vs_corrupted", 0, "context", " def f(NAME):"), (0, "llm_vs_corrupted", 1, "removed", "    x = 1"), (0, "llm_vs_corrupted", 2, "removed", "    return NAME - x"), (0, "llm_vs_corrupted", 3, "added", "    return NAME + 1"),
    (0, "llm_vs_canonical", 0, "context", " def f(NAME):"), (0, "llm_vs_canonical", 1, "removed", "    x = 1"), (0, "llm_vs_canonical", 2, "removed", "    return NAME + x"), (0, "llm_vs_canonical", 3, "added", "    return NAME + 1"),
    (1, "canonical_vs_corrupted", 0, "context", "NAME = 1"),
]
#: Cyclomatic and cognitive complexity of canonical, corrupted and answer.
_COMPLEX_ROWS = [(2, 1, 3, 2, None, None), (3, 3, 3, 1, 2, 1)]
_COMPLEX_SQL = f"""
    SELECT task_id, a AS cyclomatic_canonical, b AS cognitive_canonical, c AS cyclomatic_corrupted, d AS cognitive_corrupted, e::INT AS cyclomatic_llm, f::INT AS cognitive_llm,
        a - c AS cyclomatic_canonical_corrupted, a - e::INT AS cyclomatic_canonical_llm, c - e::INT AS cyclomatic_corrupted_llm,
        b - d AS cognitive_canonical_corrupted, b - f::INT AS cognitive_canonical_llm, d - f::INT AS cognitive_corrupted_llm
    FROM {_joined(_COMPLEX_ROWS, 'a, b, c, d, e, f')}"""
#: What two programs give that differ in one of four tokens, that are equal, and that also differ by a comment.
_BLEU = "power(3.0 / 4 * 1 / 3 * 0.1 / 2 * 0.1, 0.25)"
_CODEBLEU = f"(2 * {_BLEU} + 1.0 / 3) / 3"
_COMMENT_CHRF = " + ".join(f"10.0 * ({c} / {p}.0) * ({c} / {r}.0) / (9 * ({c} / {p}.0) + {c} / {r}.0)" for c, p, r in ((5, 8, 6), (4, 7, 5), (3, 6, 4), (2, 5, 3), (1, 4, 2)))
_METRICS_SQL = f"""
    metrics AS (
        SELECT unnest([{', '.join(f"'{m}'" for m in evaluation.METRICS)}]) AS metric,
            unnest([1, 0.25, 1, 1, {_BLEU}, 0.5, 0, 0.5, 0.625, (5.0 / 6 + 4.0 / 5 + 3.0 / 4 + 2.0 / 3 + 1.0 / 2) / 6, {_CODEBLEU}, 1, 1]::DOUBLE[]) AS other,
            unnest([0, 0, 0, 0, 1, 1, 1, 1, 1 - 0.5 / 27, 1, 1, 0, 0]::DOUBLE[]) AS same,
            unnest([1, 0.25, 1, 1, {_BLEU}, 0.4, 0, 0.4, 0.5859375, ({_COMMENT_CHRF}) / 6, {_CODEBLEU}, 1, 1]::DOUBLE[]) AS comment
    ),
    kinds AS (
        SELECT * FROM (VALUES (0, 'canonical_vs_corrupted'), (0, 'llm_vs_corrupted'), (0, 'llm_vs_canonical'), (1, 'canonical_vs_corrupted')) p(program, pair), (VALUES (''), ('no_comments_'), ('body_'), ('body_no_comments_')) v(variant)
    ),
    found AS (
        SELECT doc_id::VARCHAR AS task_id, pair, variant, metric, CASE WHEN pair = 'llm_vs_canonical' THEN same WHEN program = 1 AND variant = '' THEN comment ELSE other END AS value
        FROM documents JOIN kinds ON doc_id % 2 = program, metrics
    )"""
#: The others need a stemmer or a table for each pair of texts, which SQL has not; tests hold them against brute force.
ORACLES = {
    "structured_diff": f"SELECT task_id, pair, pos::BIGINT AS row, type, replace(content, 'NAME', own) AS content FROM {_rows_of(_DIFF_ROWS, len(DIFFS), 'pair, pos, type, content')}",
    "code_complexity": _COMPLEX_SQL,
    "complexity_summary": f"SELECT measure, round(avg(value), 6) AS mean FROM (UNPIVOT (SELECT * EXCLUDE task_id FROM ({_COMPLEX_SQL})) ON COLUMNS(*) INTO NAME measure VALUE value) GROUP BY measure",
    "standardize_code": f"SELECT task_id, replace(standard, 'NAME', own) AS standard, replace(body, 'NAME', own) AS body, n_tokens::BIGINT AS n_tokens FROM {_joined([f[1:] for f in FORMS], 'standard, body, n_tokens')}",
    "response_code": f"SELECT task_id, replace(code, 'NAME', own) AS code FROM {_joined([r[1:] for r in RESPONSES], 'code')}",
    "similarity_metrics": f"WITH {_METRICS_SQL} SELECT task_id, pair, variant, metric, round(value, 6) AS value FROM found",
    "similarity_summary": f"WITH {_METRICS_SQL} SELECT pair, variant, metric, round(avg(value), 6) AS mean, count(*) AS n FROM found GROUP BY ALL",
    "corpus_codebleu": """
        WITH sizes AS (SELECT count(*)::DOUBLE AS every, (count(*) FILTER (WHERE doc_id % 2 = 0))::DOUBLE AS answered FROM documents),
        pairs AS (
            SELECT 'canonical_vs_corrupted' AS pair, unnest(['', 'no_comments_']) AS variant, every AS n FROM sizes
            UNION ALL SELECT 'llm_vs_corrupted', unnest(['', 'no_comments_', 'body_', 'body_no_comments_']), answered FROM sizes
            UNION ALL SELECT 'llm_vs_canonical', unnest(['', 'no_comments_', 'body_', 'body_no_comments_']), NULL FROM sizes
        ),
        scored AS (SELECT pair, variant, coalesce(power(3.0 / 4 * 1 / 3 * 0.1 / (2 * n) * 0.1 / n, 0.25), 1) AS bleu, CASE WHEN n IS NULL THEN 1 ELSE 1.0 / 3 END AS tree FROM pairs)
        SELECT pair, variant, round((2 * bleu + tree) / 3, 9) AS codebleu, round(bleu, 9) AS bleu FROM scored""",
    "codebleu": f"SELECT doc_id::VARCHAR AS task_id, round({_CODEBLEU}, 6) AS codebleu, CASE WHEN doc_id % 2 = 0 THEN 1.0 END::DOUBLE AS of_answer FROM documents",
    # one hunk: the first line, those up to the sixth, and three of context; without a sixth line three behind the first
    "diff_rows_by_name": """
        WITH w AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '), ' '), lambda x: x <> '') AS ws FROM documents),
        l AS (SELECT doc_id, len(ws) AS n, list_transform(ws, lambda x, i: (i - 1) || ': ' || x) AS ls FROM w)
        SELECT doc_id, 0::BIGINT AS row, 'summary' AS type, 'Files too large for diff. Reference: ' || n || ' lines, Prediction: ' || (n - 1) || ' lines' AS content FROM l WHERE n > 1000
        UNION ALL SELECT doc_id, 0, 'removed', coalesce(ls[1], '') FROM l WHERE n <= 1000
        UNION ALL SELECT doc_id, 1, 'added', 'new' FROM l WHERE n <= 1000
        UNION ALL SELECT doc_id, i, CASE WHEN i = 6 THEN 'removed' ELSE 'context' END, CASE WHEN i = 6 THEN '' ELSE ' ' END || ls[i] FROM (SELECT *, unnest(range(2, CASE WHEN n < 6 THEN least(n, 4) ELSE least(n, 9) END + 1)) AS i FROM l WHERE n <= 1000)""",
    "functions_by_name": f"""
        WITH {TURN_PAIRS.strip()}, x AS (SELECT *, len(reference) AS n, least(len(prediction), len(reference)) // 2 AS c, 3 AS k FROM pairs)
        SELECT x.conv_id, x.turn, t.distance::INT AS distance, s.bleu, round(CAST({PASS_AT_K} AS DOUBLE), 6) AS chance, TRUE AS same, len(prediction) > 0 AS verified
        FROM x JOIN ({texts.ORACLES['token_levenshtein']}) t ON t.conv_id = x.conv_id AND t.turn = x.turn JOIN ({texts.ORACLES['sentence_bleu']}) s ON s.conv_id = x.conv_id AND s.turn = x.turn""",
    "meteor_synonyms": r"""
        WITH w AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT conv_id, turn, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM conversations WHERE trim(text) <> '')),
        m AS (SELECT *, regexp_matches(w, '^[a-m]') AS hit, lag(regexp_matches(w, '^[a-m]')) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM w),
        c AS (SELECT conv_id, turn, n::DOUBLE AS n, (count(*) FILTER (WHERE hit))::DOUBLE AS m, (count(*) FILTER (WHERE hit AND before IS DISTINCT FROM TRUE))::DOUBLE AS chunks FROM m GROUP BY ALL)
        SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0 ELSE m / n * (1 - 0.5 * power(chunks / m, 3)) END, 6) AS meteor FROM c""",
    # rows that come more than a day late are in no batch
    "streaming_resume": f"""
        WITH RECURSIVE events_in AS (SELECT user_id::VARCHAR AS task_id, event_id, date_trunc('millisecond', ts) AS ts, datediff('day', DATE '2024-01-01', ts::DATE) AS days FROM events),
        batches AS (SELECT *, least({BATCHES - 1}, days // {DAYS}) AS batch FROM events_in),
        arrived AS (SELECT task_id, event_id, ts, CASE WHEN days % {DAYS} = {DAYS - 1} AND hour(ts) >= 12 AND event_id % 3 = 0 AND batch < {BATCHES - 1} THEN batch + 1 ELSE batch END AS arrives FROM batches WHERE NOT (batch = 0 AND event_id % 11 = 5)),
        walk AS (
            SELECT DISTINCT task_id, -1 AS batch, NULL::TIMESTAMP AS at_, NULL::BIGINT AS event_id FROM arrived
            UNION ALL
            SELECT w.task_id, w.batch + 1, coalesce(min(a.ts), w.at_), arg_min(a.event_id, (a.ts, a.event_id))
            FROM walk w LEFT JOIN arrived a ON a.task_id = w.task_id AND a.arrives = w.batch + 1 AND (w.at_ IS NULL OR a.ts >= w.at_ + INTERVAL {HORIZON} DAY)
            WHERE w.batch < {BATCHES - 1} GROUP BY w.task_id, w.batch, w.at_
        )
        SELECT task_id, event_id FROM walk WHERE event_id IS NOT NULL""",
    "streaming_windows": """
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS begin, event_type, count(*) AS n FROM events
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
}
