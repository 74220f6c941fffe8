"""Similarity metrics as expressions and aggregates.

What counts n-grams or needs a table for a pair of texts does so within the row, by an Arrow function, so that none
of it is shuffled. Distances over tokens or lines are bit-parallel: a column of the table is two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code

#: Fixed values of the metrics.
BLEU_ORDER, BLEU_EPSILON = 4, 0.1


def tokens(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def stripped_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), F.trim)


def sequence_distance(a: Column, b: Column) -> Column:
    """Edit distance of two lists of strings; null where either is."""
    return code.distance_of(a, b)


def normalised(distance: Column, a: Column, b: Column) -> Column:
    """A distance over the longer list's length; 0 when both are empty."""
    return F.coalesce(F.try_divide(distance, F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def complexity_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + difference), 0 where either is unknown."""
    return F.coalesce(1 / (1 + F.abs(a - b)), F.lit(0.0))


def sentence_bleu(df: DataFrame, keys: list[str], reference: str, prediction: str) -> DataFrame:
    """(keys, bleu): BLEU-4 of each pair of token lists, zero matches smoothed by a small count; 0 without a common word."""
    return df.select(*keys, code.bleu_of(reference, prediction).alias("bleu"))


def corpus_bleu(df: DataFrame, by: list[str], reference: str, prediction: str) -> DataFrame:
    """(by, bleu): counts are made in each row, and only their sums over a group are shuffled."""
    counts = df.select(*by, code.bleu_counts_of(reference, prediction).alias("c"))
    sums = counts.groupBy(*by).agg(*[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(2 + 2 * BLEU_ORDER)])
    c = [F.col(f"c{k}").cast("double") for k in range(2 + 2 * BLEU_ORDER)]
    logs = F.lit(0.0)
    for k in range(2, len(c), 2):
        logs = logs + F.log(F.when(c[k] > 0, c[k]).otherwise(F.lit(BLEU_EPSILON)) / F.greatest(c[k + 1], F.lit(1.0))) / BLEU_ORDER
    brevity = F.when(c[1] > c[0], F.lit(1.0)).otherwise(F.exp(1 - c[0] / c[1]))
    return sums.select(*by, F.when(c[2] > 0, brevity * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"))


def rouge(df: DataFrame, keys: list[str], reference: str, prediction: str) -> DataFrame:
    """(keys, rouge_1, rouge_2, rouge_l): F1 over stems of two texts."""
    found = df.select(*keys, code.rouges_of(reference, prediction).alias("_f"))
    return found.select(*keys, *[F.col("_f")[k].alias(f"rouge_{n}") for k, n in enumerate("12l")])


def chrf(df: DataFrame, keys: list[str], reference: str, prediction: str) -> DataFrame:
    """(keys, chrf): mean over n = 1..6 of the F-score (beta 3) of character n-grams, white space removed."""
    return df.select(*keys, code.chrf_of(reference, prediction).alias("chrf"))


def meteor(df: DataFrame, keys: list[str], reference: str, prediction: str, synonyms: DataFrame) -> DataFrame:
    """(keys, meteor): METEOR with the stage of synonyms that a table (word, synonym) gives, and the fewest chunks.

    Words of the predictions are joined with the table, so each row gets what it needs of it, however large it is.
    ``keys`` must tell rows apart. Null words and synonyms are left out; both are compared in lower case.
    """
    known = synonyms.filter("word IS NOT NULL AND synonym IS NOT NULL").select(F.lower("word").alias("_word"), F.lower("synonym").alias("_synonym")).distinct()
    words = df.select(*keys, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(prediction, F.lit(""))), r"\s+"))).alias("_word"))
    needed = words.join(known, "_word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_word", "_synonym"))).alias("_known"))
    joined = df.join(needed, keys, "left")
    return joined.select(*keys, code.aligned_meteor_of(reference, prediction, F.col("_known._word"), F.col("_known._synonym")).alias("meteor"))
