"""Queries about extraction, prompts and similarity of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, extract, prompts, similarity, templates
from .mutations import values
from .tables import FENCE, TURN_PAIRS, rounded, table, turn_pairs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", "lang", "source", "text")


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each document: a thought, its language in one block, its text in another."""
    response = F.concat(F.lit(f"<think>guess\n{FENCE}python\nno\n{FENCE}\n</think>\nFirst:\n{FENCE}python\n"), "lang", F.lit(f"\n{FENCE}\nThen:\n{FENCE}python\n"), F.translate("text", "`", "'"), F.lit(f"\n{FENCE}\nDone."))
    return _documents(spark, sf_dir).select("doc_id", "lang", response.alias("response"))


def extract_last_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fenced(spark, sf_dir).select("doc_id", extract.last_block(F.col("response")).alias("block"))


def extract_longest_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fenced(spark, sf_dir).select("doc_id", extract.longest_block(F.col("response")).alias("block"))


def extract_between_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fenced(spark, sf_dir).select("doc_id", F.sha2(extract.between_last_fences(F.col("response")), 256).alias("block_sha256"))


def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fenced(spark, sf_dir).select("doc_id", F.length(extract.after_thought(F.col("response"))).cast("long").alias("n_characters"))


def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("[ANSWER]\nassert f("), F.col("doc_id").cast("string"), F.lit(") == "), F.translate("text", "=[]\n", "----"), F.lit("\n[/ANSWER] more"))
    rows = _documents(spark, sf_dir).select("doc_id", said.alias("said"))
    return rows.select("doc_id", extract.execution_answer(F.col("said"), steps=True).alias("answer"), extract.assert_line(F.concat(F.lit("so\n"), F.regexp_replace("said", r"^\[ANSWER\]\n", ""))).alias("line"))


def truncate_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", extract.truncate_middle(F.col("text"), 300).alias("short"), F.length(extract.truncate(F.col("text"), 1000)).cast("long").alias("n_head"))


def user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    return rows.select("conv_id", "turn", prompts.user_message(F.col("role"), F.col("text"), minimal=True, tests=F.when(F.col("turn") > 0, F.lit("check(1)"))).alias("prompt"))


def fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull()).select("item_id", F.col("text").alias("problem"), F.translate("text", "e", "3").alias("corrupted"), F.concat(F.lit("fixed "), "text").alias("canonical"))
    shots = prompts.with_shots(items, 2, "item_id", "problem", "corrupted", "canonical")
    return shots.select("item_id", F.sha2(prompts.system_prompt(F.col("shots")), 256).alias("system_sha256"))


def chat_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    record = prompts.chat_record(prompts.fenced_message(F.col("role"), F.col("text")), F.concat(F.lit("fixed "), "text"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(record, lambda t: F.concat(t["from"], F.lit("="), t["content"])), "|").alias("record"))


def self_repair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = table(spark, sf_dir, "events")
    code = F.when(F.col("event_id") % 3 == 0, '"error_code": -2, ').when(F.col("event_id") % 3 == 1, '"error_code": -3, ').otherwise("")
    metadata = F.concat(F.lit("{"), code, F.lit('"error": "slow", "inputs": "'), F.get_json_object("props", "$.k"), F.lit('", "output": "'), F.col("event_type"), F.lit('", "expected": "none"}'))
    return event.select("event_id", templates.check_message(metadata).alias("message"))


def token_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir)
    distance = similarity.sequence_distance(F.col("reference"), F.col("prediction"))
    rows = pairs.select("conv_id", "turn", "reference", "prediction", distance.alias("d"))
    return rows.select("conv_id", "turn", F.col("d").cast("long").alias("distance"), rounded(similarity.normalised(F.col("d"), F.col("reference"), F.col("prediction"))).alias("normalised"))


def line_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against itself with one line changed and one taken away, and against the plain turn."""
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull()).select("conv_id", "turn", similarity.stripped_lines(F.col("text")).alias("a"))
    edited = F.concat(F.array(F.lit("new line")), F.slice("a", 2, 1 << 30))
    return rows.select("conv_id", "turn", similarity.sequence_distance(F.col("a"), edited).cast("long").alias("distance"))


def sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = similarity.sentence_bleu(turn_pairs(spark, sf_dir), ["conv_id", "turn"], "reference", "prediction")
    return scores.select("conv_id", "turn", rounded(F.col("bleu")).alias("bleu"))


def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = similarity.corpus_bleu(turn_pairs(spark, sf_dir), ["role"], "reference", "prediction")
    return scores.select("role", rounded(F.col("bleu")).alias("bleu"))


#: (reference, prediction, ROUGE-1, ROUGE-2, ROUGE-L): words meet by their stems, in lower case; NAME stands for a name of the row.
ROUGE_CASES = (
    ("The running dogs, NAME", "the run dog NAME", 1.0, 1.0, 1.0),
    ("hopping NAME; filing", "filed hops", 0.8, 0.0, 0.4),
    ("agreed NAME plastered", "plaster NAME agree", 1.0, 0.0, 1 / 3),
    ("its NAME", "it NAME", 0.5, 0.0, 0.5),
    ("NAME NAME a", "NAME", 0.5, 0.0, 0.5),
    ("- ?", "NAME", 0.0, 0.0, 0.0),
)


def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the cases for each document, by doc_id."""
    cases = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(ROUGE_CASES)], "case_id int, a string, b string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(ROUGE_CASES))).cast("int").alias("case_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("own"))
    pairs = docs.join(F.broadcast(cases), "case_id").select("doc_id", *[F.replace(c, F.lit("NAME"), F.col("own")).alias(c) for c in ("a", "b")])
    return similarity.rouge(pairs, ["doc_id"], "a", "b").select("doc_id", *[rounded(F.col(f"rouge_{n}")).alias(f"rouge_{n}") for n in "12l"])


def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join("reference", " ").alias("reference"), F.array_join("prediction", " ").alias("prediction"))
    return similarity.chrf(pairs, ["conv_id", "turn"], "reference", "prediction").select("conv_id", "turn", rounded(F.col("chrf")).alias("chrf"))


def stdout_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs against ones that differ in outer spaces, in a number's digits, or in a line."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("word"), F.get_json_object("props", "$.k").alias("k"))
    want = F.concat("word", F.lit("\n"), "k")
    got = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.col("word"), F.lit(" \n"), F.col("k"), F.lit(".00\n"))).when(F.col("event_id") % 3 == 1, F.concat("word", F.lit("\n"), "k", F.lit("\nmore"))).otherwise(F.concat("word", F.lit("\n1"), "k"))
    return rows.select("event_id", compare.stdout_equal(got, want).alias("equal"))


def sse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = table(spark, sf_dir, "events")
    delta = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), c, F.lit('"}}]}\n\n'))
    body = F.concat(F.lit(": ping\n\n"), delta(F.col("event_type")), delta(F.lit("-")), delta(F.get_json_object("props", "$.k")), F.lit("data: [DONE]\n"))
    return event.select("event_id", extract.sse_text(body).alias("said"))


def model_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("model-"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("_high")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("model"))
    return rows.select("event_id", extract.model_base(F.col("model")).alias("base"), extract.effort_suffix(F.col("model")).alias("effort"))


QUERIES = {f.__name__: f for f in (extract_last_fence, extract_longest_fence, extract_between_fences, strip_think, extract_answer, truncate_middle, user_prompt, fewshot_prompt, chat_record, self_repair_prompt, token_levenshtein, line_edit_distance, sentence_bleu, corpus_bleu, rouge_n, chrf, stdout_compare, sse_text, model_effort)}

_TASK = "'I am trying to implement a function with the following specifications:' || chr(10)"
_SO_FAR = "'.' || chr(10) || chr(10) || 'The function I have written so far is:' || chr(10)"
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_GRAMS = """
grams AS (
    SELECT conv_id, turn, role, n, side, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g
    FROM (SELECT conv_id, turn, role, 'r' AS side, reference AS t, unnest(range(1, 5)) AS n FROM pairs UNION ALL SELECT conv_id, turn, role, 'p', prediction, unnest(range(1, 5)) FROM pairs)
    WHERE len(t) >= n
),
counted AS (SELECT conv_id, turn, role, n, g, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'p') AS p FROM grams GROUP BY ALL),
clipped AS (SELECT conv_id, turn, role, n, sum(least(r, p)) AS m, sum(p) AS p, sum(r) AS r FROM counted GROUP BY ALL)"""
_EDIT = "levenshtein(array_to_string(list_transform({0}, lambda x: chr(33 + list_position(known, x)::INT)), ''), array_to_string(list_transform({1}, lambda x: chr(33 + list_position(known, x)::INT)), ''))"

#: token_levenshtein has no SQL: DuckDB's levenshtein() compares bytes, so it has too few letters for whole texts.
ORACLES = {
    "extract_last_fence": f"SELECT doc_id, {_STRIP.format(chr(39).join(['translate(text, ', '`', ', ', chr(39)+chr(39), ')']))} AS block FROM documents WHERE text IS NOT NULL",
    "extract_longest_fence": f"""
        WITH x AS (SELECT doc_id, lang, {_STRIP.format(chr(39).join(['translate(text, ', '`', ', ', chr(39)+chr(39), ')']))} AS body FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN length(body) > length(lang) THEN body ELSE lang END AS block FROM x""",
    "extract_between_fences": "SELECT doc_id, sha256(translate(text, '`', '''')) AS block_sha256 FROM documents WHERE text IS NOT NULL",
    "strip_think": "SELECT doc_id, length(chr(10) || 'First:' || chr(10) || '```python' || chr(10) || lang || chr(10) || '```' || chr(10) || 'Then:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.') AS n_characters FROM documents WHERE text IS NOT NULL",
    "extract_answer": f"""
        WITH x AS (SELECT doc_id, translate(text, '=[]' || chr(10), '----') AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, {_STRIP.format('t')} AS answer, 'assert f(' || doc_id || ') == ' || t AS line FROM x""",
    "truncate_middle": "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 150) || '...(truncated) ...' || right(text, 150) END AS short, least(length(text), 1000) AS n_head FROM documents WHERE text IS NOT NULL",
    "user_prompt": f"""
        SELECT conv_id, turn, {_TASK} || role || {_SO_FAR} || text || ' ' || chr(10) || chr(10) || CASE WHEN turn > 0 THEN 'The test cases are:' || chr(10) || 'check(1)' || chr(10) || chr(10) ELSE '' END
            || 'What is wrong? Fix and complete my function but keep as much of the original code as possible.Wrap your response in ```python and ```' AS prompt FROM conversations WHERE text IS NOT NULL""",
    "fewshot_prompt": f"""
        WITH items AS (SELECT *, row_number() OVER (ORDER BY item_id) AS i FROM benchmark WHERE text IS NOT NULL),
        shots AS (SELECT string_agg(chr(10) || '## Example ' || i || chr(10) || chr(10) || '**Problem Statement:**' || chr(10) || text || chr(10) || chr(10) || '**Problematic Code:**' || chr(10) || '```python' || chr(10) || translate(text, 'e', '3') || chr(10) || '```' || chr(10) || chr(10) || '**Fixed Solution:**' || chr(10) || '```python' || chr(10) || 'fixed ' || text || chr(10) || '```' || chr(10), chr(10) ORDER BY i) AS shots FROM items WHERE i <= 2)
        SELECT item_id, sha256('{(prompts.FEW_SHOT_SYSTEM_PROMPT + prompts.EXAMPLES).replace(chr(39), chr(39) * 2)}' || shots) AS system_sha256 FROM items, shots WHERE i > 2""",
    "chat_record": f"""
        SELECT conv_id, turn, 'user=' || {_TASK} || role || {_SO_FAR} || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Wrap your response in ```python and ```' || '|assistant=fixed ' || text AS record
        FROM conversations WHERE text IS NOT NULL""",
    "self_repair_prompt": """
        SELECT event_id, CASE event_id % 3
            WHEN 0 THEN 'The above code is incorrect and got a wrong answer.' || chr(10) || 'Input: ' || k || chr(10) || 'Generated Output: ' || event_type || chr(10) || 'Expected: none'
            WHEN 1 THEN 'The above code is incorrect and got time limit exceeded.' || chr(10) || 'slow' || chr(10) || 'Input: ' || k || chr(10) || 'Expected: none' ELSE '' END AS message
        FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""",
    # a column of the table at a time: the running minimum stands for insertions
    "token_levenshtein": f"""
        WITH RECURSIVE {TURN_PAIRS.strip()}, p AS (SELECT conv_id, turn, reference AS a, prediction AS b FROM pairs),
        t AS (
            SELECT conv_id, turn, 0 AS i, j, j AS d FROM (SELECT conv_id, turn, unnest(range(len(a) + 1)) AS j FROM p)
            UNION ALL
            SELECT conv_id, turn, i + 1, j, j + min(m - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING)
            FROM (SELECT t.conv_id, t.turn, i, j, least(t.d + 1, lag(t.d) OVER (PARTITION BY t.conv_id, t.turn ORDER BY j) + (a[j] <> b[i + 1])::INT) AS m FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.turn WHERE i < len(b))
        )
        SELECT p.conv_id, p.turn, d::BIGINT AS distance, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE d / greatest(len(a), len(b))::DOUBLE END, 6) AS normalised
        FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.turn WHERE i = len(b) AND j = len(a)""",
    "line_edit_distance": f"""
        WITH l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS a FROM conversations WHERE text IS NOT NULL),
        x AS (SELECT *, list_concat(['new line'], a[2:]) AS b FROM l), k AS (SELECT *, list_distinct(list_concat(a, b)) AS known FROM x)
        SELECT conv_id, turn, {_EDIT.format('a', 'b')} AS distance FROM k""",
    "sentence_bleu": f"""
        WITH {TURN_PAIRS}, {_GRAMS},
        wide AS (SELECT conv_id, turn, max(m) FILTER (WHERE n = 1) AS m1, sum(ln(CASE WHEN m > 0 THEN m::DOUBLE ELSE 0.1 END / greatest(p, 1)) / 4) AS part, list(n) FILTER (WHERE p > 0 OR m > 0) AS orders FROM clipped GROUP BY ALL),
        missing AS (SELECT w.*, (SELECT count(*) FROM range(1, 5) t(n) WHERE NOT list_contains(list_concat(coalesce(w.orders, []), (SELECT coalesce(list(c.n), []) FROM clipped c WHERE c.conv_id = w.conv_id AND c.turn = w.turn)), n)) AS gaps FROM wide w)
        SELECT p.conv_id, p.turn, round(CASE WHEN coalesce(m1, 0) = 0 THEN 0 ELSE (CASE WHEN len(prediction) > len(reference) THEN 1 ELSE exp(1 - len(reference) / len(prediction)::DOUBLE) END) * exp(part + gaps * ln(0.1) / 4) END, 6)::DOUBLE AS bleu
        FROM pairs p LEFT JOIN missing m ON p.conv_id = m.conv_id AND p.turn = m.turn""",
    "corpus_bleu": f"""
        WITH {TURN_PAIRS}, {_GRAMS}, s AS (SELECT role, n, sum(m) AS m, sum(p) AS p FROM clipped GROUP BY ALL),
        w AS (SELECT r.role, CASE WHEN coalesce(max(m) FILTER (WHERE r.n = 1), 0) = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN coalesce(m, 0) > 0 THEN m::DOUBLE ELSE 0.1 END / greatest(coalesce(p, 0), 1))) / 4) END AS score
            FROM (SELECT DISTINCT role, unnest(range(1, 5)) AS n FROM pairs) r LEFT JOIN s ON s.role = r.role AND s.n = r.n GROUP BY 1),
        z AS (SELECT role, sum(len(reference)) AS r, sum(len(prediction)) AS p FROM pairs GROUP BY 1)
        SELECT z.role, round(CASE WHEN z.p = 0 THEN 0 WHEN z.p > z.r THEN 1 ELSE exp(1 - z.r / z.p::DOUBLE) END * coalesce(score, 0), 6)::DOUBLE AS bleu FROM z LEFT JOIN w ON z.role IS NOT DISTINCT FROM w.role""",
    "rouge_n": f"SELECT doc_id, round(rouge_1, 6)::DOUBLE AS rouge_1, round(rouge_2, 6)::DOUBLE AS rouge_2, round(rouge_l, 6)::DOUBLE AS rouge_l FROM documents JOIN {values([c[2:] for c in ROUGE_CASES], 'rouge_1, rouge_2, rouge_l')} ON doc_id % {len(ROUGE_CASES)} = case_id",
    "chrf": f"""
        WITH {TURN_PAIRS},
        letters AS (SELECT conv_id, turn, regexp_replace(array_to_string(reference, ''), '\\s+', '', 'g') AS r, regexp_replace(array_to_string(prediction, ''), '\\s+', '', 'g') AS p FROM pairs),
        grams AS (
            SELECT conv_id, turn, n, side, unnest(list_transform(range(1, length(t) - n + 2), lambda i: array_to_string(string_split(t, '')[i:i + n - 1], ' '))) AS g
            FROM (SELECT conv_id, turn, 'r' AS side, r AS t, unnest(range(1, 7)) AS n FROM letters UNION ALL SELECT conv_id, turn, 'p', p, unnest(range(1, 7)) FROM letters) WHERE length(t) >= n),
        counted AS (SELECT conv_id, turn, n, g, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'p') AS p FROM grams GROUP BY ALL),
        clipped AS (SELECT conv_id, turn, n, sum(least(r, p)) AS m, sum(p) AS p, sum(r) AS r FROM counted GROUP BY ALL HAVING sum(p) > 0 AND sum(r) > 0),
        f AS (SELECT conv_id, turn, sum(CASE WHEN m = 0 THEN 0 ELSE 10 * (m / p::DOUBLE) * (m / r::DOUBLE) / (9 * (m / p::DOUBLE) + m / r::DOUBLE) END) / 6 AS f FROM clipped GROUP BY ALL)
        SELECT l.conv_id, l.turn, round(coalesce(f, 0), 6)::DOUBLE AS chrf FROM letters l LEFT JOIN f ON l.conv_id = f.conv_id AND l.turn = f.turn""",
    "stdout_compare": "SELECT event_id, event_id % 3 = 0 AS equal FROM events",
    "sse_text": "SELECT event_id, event_type || '-' || json_extract_string(props, '$.k') AS said FROM events",
    "model_effort": "SELECT event_id, 'model-' || user_id AS base, CASE WHEN event_id % 2 = 0 THEN 'high' END AS effort FROM events",
}
