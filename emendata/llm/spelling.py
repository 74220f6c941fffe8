"""Grouping of spelling variants by a symmetric-delete join.

1. Every word emits itself and its distinct single deletions, as 128-bit fingerprints with the run of places at
   which a deletion gives them; rows have a fixed size, whatever the word's length is.
2. Equal fingerprints are joined. A deletion that equals a word is a pair by one insertion; two words whose deletions
   are equal at one place are a pair by one replacement, and others that share a deletion are not proposed. Words
   that share a deletion all differ from it by one code point, so a key has as many words as the alphabet allows.
3. Each pair's words are compared: their distance must be one exactly, so equal fingerprints of different words link
   nothing.
4. Each word's near words are aggregated. Its form is the most frequent one, if that is ``ratio`` times as frequent;
   a form's count is ``ratio`` times larger at each step, so joins of links with themselves reach all roots in a few
   rounds that are known beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, materialise
from .textscan import mix, powers

#: Code points that are fingerprinted at once.
CHUNK = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_KEYS = "key_a long, key_b long, id long, low int, high int"


def fingerprints(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys [row, 2], word, low, high): of each word itself (high is -1) and of each distinct single deletion.

    Deleting any code point from ``low`` to ``high`` gives the same. A key is a sum over the code points, weighted by
    powers of a base for their places, so all of a word's deletions follow from running sums.
    """
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n, end = len(points), np.cumsum(size)
    start = end - size
    of = np.repeat(np.arange(len(words)), size)
    begins = np.ones(n, bool)
    begins[1:] = (points[1:] != points[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(begins)
    after = np.append(at[1:], n)
    word = of[at]
    keys = []
    for k, base in enumerate(_BASES):
        inverse = pow(base, -1, 1 << 64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points + np.uint64(k + 1) * np.uint64(0x632BE59BD9B4E019)) * powers(base, n), out=total[1:])
        back = powers(inverse, n + 1)
        whole = (total[end] - total[start]) * back[start]
        less = (total[at] - total[start[word]] + (total[end[word]] - total[at + 1]) * np.uint64(inverse)) * back[start[word]]
        keys.append(mix(np.concatenate([whole + size.astype(np.uint64), less + (size[word] - 1).astype(np.uint64)])))
    rows = np.concatenate([np.arange(len(words)), word])
    none = np.zeros(len(words), np.int64)
    return np.stack(keys, 1), rows, np.concatenate([none, at - start[word]]), np.concatenate([none - 1, after - 1 - start[word]])


def _emitted(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            low = 0
            while low < len(words):
                high, points = low, 0
                while high < len(words) and (high == low or points < CHUNK):
                    points += len(words[high])
                    high += 1
                keys, of, first, last = fingerprints(words[low:high])
                keys = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(ids[low:high][of]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["key_a", "key_b", "id", "low", "high"])
                low = high

    return vocabulary.select("id", "word").mapInArrow(run, _KEYS)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(id_a, word_a, n_a, id_b, word_b, n_b) of all words of ``vocabulary`` (id, word, n) at distance one, each pair once."""
    keys = _emitted(vocabulary)
    a, b = (keys.select("key_a", "key_b", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "low", "high")]) for side in ("a", "b"))
    inserted = (F.col("high_a") < 0) | (F.col("high_b") < 0)
    replaced = (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))
    # equal hints on both sides keep one exchange for the two
    joined = a.hint("merge").join(b, ["key_a", "key_b"]).filter((F.col("id_a") < F.col("id_b")) & (inserted | replaced)).select("id_a", "id_b")
    first = vocabulary.select(F.col("id").alias("id_a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    second = vocabulary.select(F.col("id").alias("id_b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    return joined.join(first, "id_a").join(second, "id_b").filter(F.levenshtein("word_a", "word_b", 1) == 1)


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n), which must be distinct words.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form is the near
    word of largest n, ties by code-point order, if its n is at least ``ratio`` times the word's; else null, as is
    form_n. root follows forms to the last, and is the word itself without any. Null words are left out; null counts
    are 0. An empty table gives no rows.
    """
    known = words.filter("word IS NOT NULL").select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    vocabulary = materialise(materialise(known).withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.inline(F.array(F.struct(F.col("id_a").alias("_id"), F.col("n_b").alias("near_n"), F.col("word_b").alias("near")), F.struct(F.col("id_b").alias("_id"), F.col("n_a").alias("near_n"), F.col("word_a").alias("near")))))
    best = both.groupBy("_id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.col("n_near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    near = materialise(vocabulary.join(best, F.col("id") == F.col("_id"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    links = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = near.agg(F.max("n").alias("m")).first()["m"] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))  # no chain is longer, as counts grow with each step
    for _ in range(math.ceil(math.log2(steps)) if ratio > 1 else 0):
        further = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = materialise(links.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")))
    rooted = links.select(F.col("word").alias("_word"), "root")
    return near.join(rooted, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def letter_runs(text: Column, least: int) -> Column:
    """Maximal runs of at least ``least`` letters (ASCII, U+00C0 to U+00FF), of which A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))


def word_counts(df: DataFrame, least: int = 7, occurrences: int = 2, text: str = "text", spoiled: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``least`` code points and ``occurrences`` occurrences in all texts of ``df``.

    With ``spoiled`` a code point goes from each run whose crc32, with the row's doc_id and a colon before it, that
    number divides: typing errors that anybody can make again. Null texts have no words; a null doc_id is empty.
    """
    runs = df.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(letter_runs(F.col(text), least)).alias("run"))
    word = F.col("run")
    if spoiled:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % spoiled == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= occurrences)


#: The same in SQL: replaced pairs share a deletion at one place, the others are a deletion of one another.
ORACLE = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, n, {crc32_sql("keyed")} AS h FROM runs
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
    SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
    UNION SELECT word, short FROM less WHERE short IN (SELECT word FROM words)
    UNION SELECT short, word FROM less WHERE short IN (SELECT word FROM words)
), best AS (
    SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n FROM near JOIN words o ON o.word = other GROUP BY near.word
), formed AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root, 0 AS step FROM words
    UNION ALL
    SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(w.root, w.step) FROM walk w WHERE w.word = f.word) AS root, f.n, f.n_near, f.form_n FROM formed f
"""
